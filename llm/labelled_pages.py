"""Labelled pages to train the extraction model on: page layouts as sites use them, filled with made-up words.

Elements carry the label of what they hold (``data-label``, 1 for the article, 0 for all else); elements without
one have that of their parent. Layouts differ in whether elements or class names say what a part is, in order and depth
of the parts, and in what is put into the article: adverts, share bars, link lists, forms, reader comments.
"""

from __future__ import annotations

import random

LETTERS = ("etaoinshrdlucmfwypvbgk", "еаоинтслвркдмупяыьгз", "的一是不了人在有我他这中大来上国", "eaniosrltducmpêéèçàñöüß")


class Maker:
    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        letters = self.rnd.choice(LETTERS)
        self.vocabulary = ["".join(self.rnd.choice(letters) for _ in range(self.rnd.randint(1, 10))) for _ in range(300)]
        self.named = self.rnd.random() < 0.75  # class names say what a part is
        self.meaning = self.rnd.random() < 0.65  # elements say it (nav, aside, footer)
        self.noise = self.rnd.choice(["", "", "", "###", "&amp;&amp;", "$$$", "%%%", "!!"])

    def one(self, *of):
        return self.rnd.choice(of)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rnd.choice(self.vocabulary) + (self.noise if self.noise and self.rnd.random() < 0.6 else "") for _ in range(self.rnd.randint(low, high)))

    def prose(self, low: int = 3, high: int = 90) -> str:
        out = []
        for _ in range(self.one(1, 1, 2, 3, 5)):
            text = self.words(low, max(low, high // 3)).capitalize()
            out.append(text + self.one(".", ".", ".", "!", "?", "", ", " + self.words(1, 4) + "."))
        text = " ".join(out)
        if self.rnd.random() < 0.15:
            text += f' <a href="/{self.words(1, 1)}">{self.words(1, 4)}</a> {self.words(1, 20)}.'
        return f"<b>{text}</b>" if self.rnd.random() < 0.1 else text

    def part(self, element: str, names: tuple, inner: str, label: int = 0, always: bool = False) -> str:
        """A part of the page by its element or a plain one, with or without a name."""
        tag = element if self.meaning or always else self.one("div", "div", "section")
        kind = f' {self.one("class", "class", "id")}="{self.one(*names)}{self.one("", "", "-1", " wide", "_box")}"' if names and (self.named or (tag == "div" and self.rnd.random() < 0.7)) else ""
        return f'<{tag}{kind} data-label="{label}">{inner}</{tag}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.rnd.randint(low, high))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.rnd.random() < 0.7 else self.one(" | ", " ", "<br>").join(items)

    def menu(self) -> str:
        return self.part("nav", ("nav", "menu", "main-menu", "navbar", "breadcrumbs", "site-nav"), self.links(), always=self.rnd.random() < 0.5)

    def advert(self) -> str:
        text = self.one(self.prose(), self.prose(2, 30), f'<a href="/x">{self.words(2, 8)}</a>', f"<p>{self.prose(2, 20)}</p>")
        return f'<{self.one("div", "div", "aside", "section")} class="{self.one("ad", "ads", "advert", "advertisement", "ad-box", "sponsored", "promo", "banner-ad")}" data-label="0">{text}</div>'.replace("<aside", "<div").replace("<section", "<div")

    def notice(self) -> str:
        inner = f"<p>{self.prose()}</p>" + self.one("", "<button>ok</button>", f'<a href="/p">{self.words(1, 3)}</a>')
        return f'<div {self.one("class", "id")}="{self.one("cookie-notice", "consent", "notice", "cookie-banner", "alert", "gdpr", "popup", "modal", "newsletter-box", "subscribe", "paywall-message")}" data-label="0">{inner}</div>'

    def form(self) -> str:
        return f'<form {self.one("", "class=search", "class=newsletter")} data-label="0"><label>{self.words(1, 4)}</label><input name="q"><p>{self.words(2, 14)}</p><button>{self.words(1, 2)}</button></form>'

    def site_header(self) -> str:
        return self.part("header", ("header", "site-header", "top", "masthead", "logo"), f"<div>{self.words(1, 4)}</div>" + self.one("", f"<p>{self.words(2, 9)}</p>", self.menu()))

    def footer(self) -> str:
        inner = self.one("&copy; ", "&copy; 2020 ", "") + self.words(1, 4) + self.one(" &middot; ", ". ", " ") + self.one(self.prose(2, 30), "", self.links())
        return self.part("footer", ("footer", "site-footer", "bottom", "copyright", "colophon"), self.one(inner, f"<p>{inner}</p>"), always=self.rnd.random() < 0.5)

    def sidebar(self) -> str:
        inner = "".join(self.one(f"<h3>{self.words(1, 4)}</h3>{self.links()}", f"<p>{self.prose(2, 30)}</p>", self.advert(), f"<h4>{self.words(1, 3)}</h4><p>{self.words(4, 25)}</p>") for _ in range(self.rnd.randint(1, 4)))
        return self.part("aside", ("sidebar", "side", "aside", "widget", "right-col sidebar", "related", "related-posts"), inner, always=self.rnd.random() < 0.5)

    def comments(self) -> str:
        each = []
        for _ in range(self.rnd.randint(1, 6)):
            body = f'<span class="author">{self.words(1, 2)}</span><p>{self.prose()}</p>' + self.one("", "<p>" + self.prose() + "</p>", '<a href="#">reply</a>')
            each.append(f'<{(t := self.one("div", "li", "article"))} class="{self.one("comment", "comment-body", "reply", "comment even")}">{body}</{t}>')
        return f'<{(t := self.one("section", "div", "ol"))} {self.one("id", "class")}="{self.one("comments", "comment-list", "commentlist", "disqus_thread", "user-comments", "discussion", "responses comments")}" data-label="0">{self.one("", "<h3>" + self.words(1, 3) + "</h3>")}{"".join(each)}{self.one("", self.form())}</{t}>'

    def share(self) -> str:
        return f'<div class="{self.one("share", "social", "share-bar", "tags", "byline-share")}" data-label="0">{self.links(2, 5)}</div>'

    def block(self) -> str:
        kind = self.rnd.random()
        if kind < 0.74:
            return f"<p>{self.prose(1, self.one(6, 40, 90, 260))}" + self.one("</p>", "</p>", "</p>", "")
        if kind < 0.82:
            return f"<h{(k := self.rnd.randint(2, 4))}>{self.words(1, 9)}</h{k}>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{self.prose(1, 25)}</li>" for _ in range(self.rnd.randint(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{self.one('', '<p>')}{self.prose()}</blockquote>"
        if kind < 0.94:
            return "<table><tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr></table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{self.words(2, 12)}</figcaption></figure>"
        return f"<div>{self.prose()}</div>"

    def article(self) -> str:
        inner = [self.one(f"<h1>{self.words(2, 10)}</h1>", f"<h1>{self.words(2, 10)}</h1>", f"<header><h1>{self.words(2, 10)}</h1></header>", "")]
        if self.rnd.random() < 0.3:
            inner.append(f"<p><b>{self.prose()}<br>")
        if self.rnd.random() < 0.1:  # verses, chats, tables of lines: many short blocks without a full stop
            tag = self.one("p", "p", "div", "li", "td")
            inner += [f"<{tag}>{self.words(1, 7)}</{tag}>" for _ in range(self.rnd.randint(30, 250))]
        else:
            inner += [self.block() for _ in range(self.one(1, 2, 3, 6, 12, 20))]
        for extra, share in ((self.advert, 0.2), (self.share, 0.25), (self.form, 0.1), (self.menu, 0.1), (self.sidebar, 0.12), (self.notice, 0.08)):
            if self.rnd.random() < share:
                inner.insert(self.rnd.randint(1, len(inner)), extra())
        if self.rnd.random() < 0.25:
            inner.append(self.comments())
        text = "".join(inner)
        shape = self.rnd.random()
        if shape < 0.45:
            return f'<article data-label="1"{self.one("", " class=post", " class=entry")}>{text}</article>'
        if shape < 0.6:
            return f'<main data-label="1">{text}</main>'
        name = self.one("content", "article", "post", "entry-content", "article-body", "story", "main-content", "post-content", "text")
        return f'<div {self.one("class", "id")}="{name}" data-label="1">{text}</div>' if shape < 0.95 else f'<table><tr><td data-label="1">{text}</td></tr></table>'

    def page(self) -> str:
        kind = self.rnd.random()
        if kind < 0.08:  # a fragment without any frame
            inner = "".join(self.block() for _ in range(self.rnd.randint(1, 5)))
            return self.one(f'<body data-label="1">{inner}</body>', f'<body data-label="1">{self.prose()}</body>', self.article(), self.article())
        before = [self.one(self.site_header, self.menu)(), *[x() for x in (self.menu, self.advert, self.notice, self.form) if self.rnd.random() < 0.4]]
        after = [x() for x in (self.comments, self.sidebar, self.advert, self.notice, self.form) if self.rnd.random() < 0.35] + [self.footer()]
        middle = self.article()
        if self.rnd.random() < 0.3:
            middle = f"<div{self.one('', ' class=wrapper', ' id=page', ' class=container')}>{self.one('', self.sidebar())}{middle}{self.one('', self.sidebar())}</div>"
        if self.rnd.random() < 0.2:
            middle = f"<main>{middle}{self.one('', self.comments())}</main>" if "<main" not in middle else middle
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{middle}{''.join(after)}" + self.one("</body></html>", "</body></html>", "")


def labelled_pages(n: int, seed: int = 20240917) -> list[str]:
    return [Maker(seed * 100_003 + i).page() for i in range(n)]
