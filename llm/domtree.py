"""A tolerant HTML reader that keeps what extraction needs: the tree of block elements and the runs of text in them.

Inline elements do not make nodes; their text belongs to the run around them. A run ends where a block element starts or
ends, and is a leaf. Elements that never hold text to read (scripts, styles, controls, embedded media, the
head) are left out with all they hold. Missing end tags are filled in as browsers do for paragraphs, list items and
table parts; end tags without a start are ignored. No step is recursive, and every step is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|\Z))"  # a comment
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)"  # a tag
    r"|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)",  # a declaration, an end tag without a name
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = RAW - {"xmp"} | frozenset("head noscript template svg select button datalist audio video object canvas option map".split())
BLOCKS = (
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption xmp"
).split()
CLOSES_P = frozenset(BLOCKS) - frozenset("html body caption dd dt li tbody td tfoot th thead tr legend".split())
#: A start tag on the left ends an open element on the right, as long as none of ``BORDER`` lies between.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")} | dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot"))
BORDER = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",)}
SCOPE = frozenset("html body table td th caption dialog".split())

#: Nesting beyond this is flattened, as browsers do.
DEEPEST = 512

TAGS = {name: k for k, name in enumerate([*BLOCKS, "#text"])}
TEXT = TAGS["#text"]
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}


class Page:
    """Nodes in page order: parent (-1 for the root), depth, tag number, attributes as written; for text leaves the
    text and the number of its characters that stand in links. What is nested deeper than ``DEEPEST`` elements hangs there."""

    def __init__(self, html: str):
        self.parent, self.depth, self.tag, self.attributes, self.text, self.linked = [-1, 0], [0, 1], [TAGS["html"], TAGS["body"]], ["", ""], ["", ""], [0, 0]
        self.open = [("html", 0), ("body", 1)]  # both are there, whether they are written or not
        self.known = dict.fromkeys(BLOCKS, 0)  # how many of each name are open
        self.run: list[str] = []
        self.run_links = 0
        self.link = 0  # how many blocks were open when the link began, 0 outside links
        self.read(html)
        self.flush()

    def read(self, html: str) -> None:
        at, size = 0, len(html)
        skip, nested = "", 0  # inside an element without text: its name, and how many of that name are open
        while at < size:
            found = TOKEN.search(html, at) if html.find("<", at) >= 0 else None
            stop = found.start() if found else size
            if stop > at and not skip:
                self.add(html[at:stop])
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name, ends = name.lower(), bool(found[1])
            if skip:
                if name in RAW and not ends and name != skip:
                    at = self.behind(html, at, name)
                elif name == skip:
                    nested += -1 if ends else 1
                    if not nested:
                        skip = ""
                elif skip == "head" and name == "body" or skip in ("option", "select", "button") and name in TAGS and ends:
                    skip = ""  # its end tag is missing
                    self.end(name) if ends else self.start(name, found[3])
                continue
            if not ends and name in RAW and name != "xmp":
                at = self.behind(html, at, name)
            elif not ends and name in HIDDEN:
                if name != "option" and not found[3].endswith("/"):
                    skip, nested = name, 1
            elif ends:
                self.end(name)
            else:
                self.start(name, found[3])

    @staticmethod
    def behind(html: str, at: int, name: str) -> int:
        """The place behind an element whose content is no markup."""
        end = _raw_end[name].search(html, at)
        if not end:
            return len(html)
        close = html.find(">", end.end())
        return close + 1 if close >= 0 else len(html)

    def add(self, text: str) -> None:
        text = unescape(text) if "&" in text else text
        self.run.append(text)
        if self.link:
            self.run_links += len(text)

    def node(self, tag: int, attributes: str = "", text: str = "", linked: int = 0) -> int:
        above = self.open[min(len(self.open), DEEPEST) - 1][1]
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.node(TEXT, "", text, min(self.run_links, len(text)))
            self.run, self.run_links = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name not in TAGS:
            if name == "br":
                self.run.append(" ")
            elif name == "a" and "href" in attributes:
                self.link = len(self.open)
            return
        self.flush()
        if name in ("html", "body"):
            if name == "body" and not self.attributes[1]:
                self.attributes[1] = attributes
            return
        if name in CLOSES_P:
            self.close(("p",), SCOPE)
        if name in ENDS:
            self.close(ENDS[name], BORDER.get(name, ("table",)))
        if name not in VOID:
            self.push(name, attributes)

    def push(self, name: str, attributes: str) -> None:
        self.open.append((name, self.node(TAGS[name], attributes)))
        self.known[name] += 1

    def end(self, name: str) -> None:
        if name not in TAGS:
            if name == "a":
                self.link = 0
            return
        self.flush()
        if name not in ("html", "body"):
            self.close((name,), () if name == "table" else SCOPE - {name} if name in SCOPE else SCOPE)

    def close(self, names, border) -> None:
        """End the innermost open element of one of the names, and all inside it, unless a border is met first."""
        if not any(self.known[name] for name in names):
            return
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k][0] in names:
                for name, _ in self.open[k:]:
                    self.known[name] -= 1
                del self.open[k:]
                if self.link > k:
                    self.link = 0
                return
            if self.open[k][0] in border:
                return


def attribute_words(attributes: str) -> dict[str, str]:
    """Attribute names (lower case) and their values; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out
