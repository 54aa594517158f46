"""Labelled pages for the HTML model, made from rules: layouts of articles among boilerplate, with data-y="1" for content.

Words are random letters, so that only structure can be learned. Names of classes come from the lists below, or are random
letters too (made up anew each time), in content and in boxes that their tags or links tell apart, so that a name that wasn't
seen says nothing.
"""

from __future__ import annotations

import random
import re

BOXES = ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sidebar", "widget", "related", "share", "social", "breadcrumb", "menu", "navbar", "nav", "topbar", "cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login", "footer", "header", "masthead", "copyright", "legal", "disclaimer", "comments", "comment", "replies", "discussion", "pagination", "tags", "search", "skip", "toolbar", "recommended", "trending", "teaser")
MAINS = (("article", ""), ("main", ""), ("main", "content"), ("article", "post"), ("div", "content"), ("div", "article body"), ("div", "post entry"), ("div", "story text"), ("section", "main content"), ("section", "article"), ("div", "page body"))
PLAIN = ("", "", "wrapper", "container", "row", "col", "inner")
#: Words of class names that are told apart; any other counts as unknown.
NAMES = frozenset(w for n in (*BOXES, *(n for _, n in MAINS), *PLAIN, "site", "reply", "comment list") for w in re.split(r"[^a-z]+", n) if w)


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.made = ["".join(self.r.choices("abcdefghijklmnoprstuvw", k=self.r.randint(1, 9))) for _ in range(5000)]

    def words(self, low: int, high: int) -> str:
        made = self.r.choices(self.made, k=self.r.randint(low, high))
        return " ".join(made).capitalize() + "."

    def named(self, tag: str, name: str, inside: str, y: int) -> str:
        how = self.r.choice(("class", "class", "id"))
        name = name if how == "class" else name.replace(" ", "-")
        attrs = f' {how}="{name}"' if name else ""
        return f'<{tag}{attrs} data-y="{y}">{inside}</{tag}>'

    def letters(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnoprstuvw") for _ in range(self.r.randint(3, 11)))

    def formula(self) -> str:
        return f"<math><mi>{self.letters()[:1]}</mi><mo>=</mo><mn>{self.r.randint(1, 99)}</mn></math>"

    def links(self) -> str:
        items = [f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(self.r.randint(2, 8))]
        return f"<ul>{''.join(items)}</ul>"

    def prose(self, low: int, high: int) -> str:
        text = self.words(low, self.r.choice((high, high, 3 * high)))
        if self.r.random() < 0.3:
            text += f" {self.formula()}" if self.r.random() < 0.15 else f" <{(t := self.r.choice(('b', 'em', 'a')))}>{self.words(1, 4)}</{t}> {self.words(2, 9)}"
        return text

    def box(self) -> str:
        kind, r = self.r.randrange(11), self.r
        if kind == 0:
            return self.named("nav", r.choice(("", "", "menu", self.letters())), self.links(), 0)
        if kind == 1:
            tag = r.choice(("header", "footer", "aside"))
            inside = r.choice((self.links(), f"<p>{self.prose(3, 30)}</p>", self.prose(2, 25), f"<h2>{self.words(1, 5)}</h2><p>{self.prose(3, 20)}</p>"))
            return self.named(tag, r.choice(("", "", "site", self.letters())), inside, 0)
        if kind == 2:
            inside = f'<label data-y="0">{self.words(1, 3)}</label><input name="q"><p>{self.words(2, 12)}</p><button>{self.words(1, 2)}</button>'
            return self.named("form", r.choice(("", "", self.letters())), inside, 0)
        if kind == 3:
            items = "".join(self.named("div", r.choice(("comment", "reply", "")), f"<p>{self.prose(4, 60)}</p>", 0) for _ in range(r.choice((r.randint(1, 4), r.randint(3, 25)))))
            return self.named(r.choice(("div", "section", "ol")), r.choice(("comments", "comment list", "replies", "discussion")), f"<h3>{self.words(1, 3)}</h3>{items}", 0)
        if kind == 4:
            return f'<label data-y="0">{self.words(1, 3)}</label><input name="f">'
        if kind == 5:
            return self.named(r.choice(("video", "audio", "object", "canvas", "noscript")), "", r.choice((self.words(3, 12), f"<p>{self.words(3, 12)}</p>")), 0)
        if kind == 6:
            return self.named("div", r.choice(("comment", "reply", "comment", "notice", "ad", "share")), f"<p>{self.prose(2, 60)}</p>", 0)
        if kind == 7:
            return self.named(r.choice(("div", "ul", "section")), self.letters(), self.links() + self.links(), 0)
        inside = r.choice((self.links(), f"<p>{self.prose(3, 40)}</p>", self.prose(2, 30), f"<p>{self.prose(3, 25)}</p><p>{self.prose(3, 25)}</p>", f'<a href="#">{self.words(1, 6)}</a>'))
        return self.named(r.choice(("div", "div", "section", "aside", "p", "ul", "span")), r.choice(BOXES), inside, 0)

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.words(2, 9)}</h1>")
        for _ in range(r.choice((r.randint(1, 9), r.randint(1, 9), r.randint(10, 25), r.randint(25, 90)))):
            parts.append(r.choice((
                lambda: f"<p>{self.prose(1, 80)}</p>", lambda: f"<p>{self.prose(1, 5)}</p>", lambda: f"<p>{self.prose(8, 50)}",
                lambda: f"<h2>{self.words(1, 6)}</h2><p>{self.prose(3, 60)}</p>", lambda: f"<p><b>{self.prose(5, 40)}<br>",
                lambda: f"<ul>{''.join(f'<li>{self.prose(1, 12)}</li>' for _ in range(r.randint(2, 5)))}</ul>",
                lambda: f"<blockquote>{self.prose(4, 40)}</blockquote>", lambda: f"<pre>{self.words(3, 20)}</pre>",
                lambda: f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>",
                lambda: f'<div class="{r.choice(("para", "text", "section", ""))}">{self.prose(3, 50)}</div>',
                lambda: self.named(r.choice(("section", "div")), self.letters(), f"{f'<h3>{self.words(1, 5)}</h3>' * r.randrange(2)}<p>{self.prose(3, 50)}</p>" * r.randint(1, 2), 1),
                lambda: self.named(r.choice(("p", "h3", "blockquote", "pre", "figure", "dl", "details")), self.letters(), self.prose(2, 40), 1),
                lambda: f"<p>{self.prose(2, 30)}</p><p>{self.words(1, 3)} {self.formula()} {self.words(2, 9)}</p>",
            ))())
            if r.random() < 0.1:
                parts.append(self.box())
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        before = "".join(self.box() for _ in range(r.randint(0, 4)))
        after = "".join(self.box() for _ in range(r.randint(0, 4)))
        tag, name = r.choice((*MAINS, ("div", self.letters()), ("section", self.letters())))
        body = self.article()
        main = self.named(tag, name, body, 1) if r.random() < 0.9 else body
        if r.random() < 0.4:
            main = self.named("div", r.choice(PLAIN), main + (self.box() if r.random() < 0.4 else ""), 1)
        end = "</body></html>" if r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html data-y="1"><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body data-y="1">{before}{main}{after}{end}'


def labelled(n: int = 400, seed: int = 7) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
