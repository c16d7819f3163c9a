"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element and every run of text is a node with two states, content or not. Its own potential comes from its
element, its class and id names, how much text it holds, how much of that is links, and where it stands; a table of
potentials for each kind of parent-child edge ties it to its parent. Messages pass up and down the tree
(``treemodel``), and the text of leaves whose marginal is above one half is the result. The weights are trained on
labelled pages (``labelled_pages``; their number is the parameter ``training_pages``).

Defined results: null and empty pages, and pages without text, give the empty string; character references
are decoded by the rules of HTML; white space (of any script) inside a block becomes one blank, a line break element
too; repeated rows and null ids are rows each; other columns are ignored; an empty table gives no row. A page is
read as a whole by one task.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import byte_slices, roomy, spread
from llm.domtree import TAGS, TEXT, Page, attribute_words
from llm.labelled_pages import labelled_pages
from llm.treemodel import Forest, fit

#: What names of classes and ids commonly say about a part of a page.
NAMES = {
    "article": "article|articlebody|post|entry|story|blogpost|hentry",
    "content": "content|text|body|main|maincontent",
    "menu": "nav|navbar|navigation|menu|breadcrumb|breadcrumbs|toc|pagination|pager|tabs",
    "head": "header|masthead|logo|top|topbar|branding|toolbar",
    "foot": "footer|bottom|copyright|colophon|legal|credits",
    "side": "sidebar|side|aside|widget|rail|related|recommended|teaser|teasers|popular|trending|more",
    "advert": "ad|ads|adv|advert|advertisement|adbox|adsense|sponsor|sponsored|promo|promotion|banner|commercial|outbrain|taboola",
    "notice": "cookie|cookies|consent|notice|gdpr|alert|popup|modal|overlay|message|warning|paywall|disclaimer|subscribe|subscription",
    "form": "form|search|newsletter|login|signup|register|signin|contact|survey",
    "comments": "comment|comments|commentlist|commentbody|reply|replies|respond|responses|discussion|disqus|feedback|reviews",
    "share": "share|sharing|social|tags|tag|byline|meta|author|follow|print",
}
_word = re.compile(r"[a-z]+")
_kind_of = {word: kind for kind, words in NAMES.items() for word in words.split("|")}
SEMANTIC = frozenset(TAGS[t] for t in ("nav", "aside", "footer", "header", "form", "menu", "dialog", "search"))
GENERIC = frozenset(TAGS[t] for t in ("div", "section", "article", "main", "center", "td", "body"))
EDGES = 10
TRAINING_PAGES = 800

_number: dict[str, int] = {}


def feature(name: str) -> int:
    """The number of a feature; all are numbered below, before any is used."""
    return _number[name]


def _register() -> None:
    steps = range(6)
    names = [f"tag {t}" for t in TAGS] + [f"above {t}" for t in TAGS] + [f"name {k}" for k in NAMES] + ["name none", "name other", "hidden", "itemprop body"]
    # on pages without an article or main element other signs count
    names += [f"{page} page {t}" for page in ("marked", "plain") for t in TAGS] + [f"plain page name {k}" for k in NAMES]
    for kind in ("part", "leaf"):
        names += [f"{kind} {what} {k}" for what in ("chars", "linked", "share", "place", "depth") for k in steps]
        names += [f"{kind} stop", f"{kind} no stop", f"{kind} sign"]
    for name in names:
        _number.setdefault(name, len(_number))


_register()
CHARS = np.array([1, 25, 80, 250, 1000])
LINKED = np.array([1e-9, 0.1, 0.3, 0.6, 0.95])
SHARE = np.array([1e-9, 0.02, 0.1, 0.3, 0.7])
PLACE = np.array([0.05, 0.2, 0.5, 0.8, 0.95])
DEPTHS = np.array([1, 2, 3, 5, 8])
STOPS = frozenset(".!?…。！？।\"'”)")


@lru_cache(maxsize=4096)
def attribute_features(attributes: str, marked: bool = True) -> tuple[int, ...]:
    """Features of the names an element goes by; ``marked`` if its page has an article or main element."""
    if not attributes:
        return (feature("name none"),)
    found = attribute_words(attributes)
    said = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    kinds = {_kind_of[w] for w in _word.findall(said) if w in _kind_of}
    out = [feature(f"name {k}") for k in sorted(kinds)] + [feature(f"plain page name {k}") for k in sorted(kinds) if not marked] or [feature("name other" if said.strip() else "name none")]
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        out.append(feature("hidden"))
    if "articlebody" in found.get("itemprop", "").lower():
        out.append(feature("itemprop body"))
    return tuple(out)


def edge_kinds(tag: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """What kind of edge leads to each node: text, plain block, container or named part; below the body, a container or else."""
    semantic, generic = (np.isin(tag, list(s)) for s in (SEMANTIC, GENERIC))
    child = np.select([tag == TEXT, semantic, generic], [0, 1, 2], 3)
    top = np.isin(tag, [TAGS["html"], TAGS["body"]])
    above = np.maximum(parent, 0)
    return child * 2 + (generic[above] & ~top[above]) + np.where(top[above] & (child == 2), 4, 0)


def page_forest(pages: list[Page]) -> Forest:
    """All pages as one forest with the features of their nodes."""
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    shift = np.repeat(np.cumsum(sizes) - sizes, sizes)
    tag = np.array([t for p in pages for t in p.tag], np.int64)
    depth = np.array([d for p in pages for d in p.depth], np.int64)
    parent = np.array([x for p in pages for x in p.parent], np.int64)
    parent = np.where(parent >= 0, parent + shift, -1)
    page = np.repeat(np.arange(len(pages)), sizes)
    chars = np.array([len(t) for p in pages for t in p.text], np.float64)
    linked = np.array([x for p in pages for x in p.linked], np.float64)
    total = np.bincount(page, chars, len(pages))[page]
    before = np.cumsum(chars) - chars
    before -= before[np.cumsum(sizes) - sizes][page] if len(pages) else 0
    leaf = tag == TEXT
    stops = np.array([t[-1:] in STOPS if t else False for p in pages for t in p.text], bool).astype(np.float64)
    sums = np.stack([chars, linked, stops * chars], 1)
    order = np.argsort(depth, kind="stable")
    cut = np.flatnonzero(np.diff(depth[order], prepend=-1, append=-1)) if len(tag) else np.zeros(1, np.int64)
    for a, b in reversed(list(zip(cut[1:-1].tolist(), cut[2:].tolist(), strict=True))):
        level = order[a:b]
        np.add.at(sums, parent[level], sums[level])
    text = np.maximum(sums[:, 0], 1)
    marked = (np.bincount(page[np.isin(tag, [TAGS["article"], TAGS["main"]])], minlength=len(pages)) > 0)
    signs = np.array([t.startswith("©") or "©" in t[:80] for p in pages for t in p.text], bool)

    def step(name, values, bounds):
        base = np.where(leaf, feature(f"leaf {name} 0"), feature(f"part {name} 0"))
        return base + np.searchsorted(bounds, values, "right")

    stop = sums[:, 2] > 0.4 * text
    both = lambda name: np.where(leaf, feature(f"leaf {name}"), feature(f"part {name}"))
    above = np.where(parent >= 0, tag[np.maximum(parent, 0)], TAGS["html"])
    dense = [
        feature("tag html") + tag, feature("above html") + above, np.where(marked[page], feature("marked page html"), feature("plain page html")) + tag, step("chars", sums[:, 0], CHARS), step("linked", sums[:, 1] / text, LINKED),
        step("share", sums[:, 0] / np.maximum(total, 1), SHARE), step("place", before / np.maximum(total, 1), PLACE), step("depth", depth, DEPTHS), np.where(stop, both("stop"), both("no stop")),
    ]
    more = [attribute_features(a, m) if t != TEXT else () for p, m in zip(pages, marked.tolist(), strict=True) for a, t in zip(p.attributes, p.tag, strict=True)]
    counts = len(dense) + np.array([len(m) for m in more], np.int64) + signs
    features = np.empty(int(counts.sum()), np.int64)
    first = np.cumsum(counts) - counts
    for k, column in enumerate(dense):
        features[first + k] = column
    at = first + len(dense)
    features[at[signs]] = feature("leaf sign")
    for m, place in zip(more, (at + signs).tolist(), strict=True):
        if m:
            features[place : place + len(m)] = m
    return Forest(parent, depth, edge_kinds(tag, parent), features, counts)


def node_labels(page: Page) -> list[int]:
    """Labels of the nodes of a labelled page: their own, or else that of the parent."""
    out: list[int] = []
    for parent, attributes in zip(page.parent, page.attributes, strict=True):
        own = attribute_words(attributes).get("data-label") if "data-label" in attributes else None
        out.append(int(own) if own is not None else out[parent] if parent >= 0 else 0)
    return out


def unlabelled(page: Page) -> Page:
    page.attributes = [re.sub(r'\s*data-label="\d"', "", a) for a in page.attributes]
    return page


@lru_cache(maxsize=4)
def train(training_pages: int = TRAINING_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge tables from that many labelled pages; bounded, so this runs where the job is planned."""
    pages = [Page(html) for html in labelled_pages(training_pages)]
    labels = np.array([y for p in pages for y in node_labels(p)], np.int64)
    return fit(page_forest([unlabelled(p) for p in pages]), labels, len(_number), EDGES)


def main_texts(htmls: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    pages = [Page(h) for h in htmls]
    content, _, _ = page_forest(pages).marginals(*model)
    out, at = [], 0
    for page in pages:
        own = content[at : at + len(page.tag)]
        at += len(page.tag)
        out.append("\n".join([t for t, p in zip(page.text, own.tolist(), strict=True) if t and p > 0.5]))
    return out


def extract_text(pages: DataFrame, training_pages: int = TRAINING_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: one row per row of ``pages``."""
    model = train(training_pages)
    rows = spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")))

    def work(batches):
        for batch in batches:
            html = batch.column(2).fill_null("")
            for a, b in byte_slices(html, 1 << 20):
                texts = main_texts(html.slice(a, b - a).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(roomy(work), "page_id long, url string, text string")
