"""Labelled pages for the extraction model: varied layouts in which ``data-main`` marks the article's blocks.

The pages are made from a seed, so that training is the same everywhere. Names of classes
follow common usage on the web; the words are invented.
"""

from __future__ import annotations

import random

_SYLLABLES = ("the", "an", "ter", "ou", "re", "ing", "lo", "mi", "é", "für", "que", "sta", "ne", "ro", "da", "ción", "um", "or")
_CONTAINERS = ("container", "wrap", "row", "col", "inner", "page", "layout", "grid", "")
_ARTICLES = (
    "<article>", "<main>", '<div class="content">', '<div class="post-body">', '<div id="story">', '<section class="article-text">',
    '<div class="entry">', '<div itemprop="articleBody">', '<article class="post">', "<div>", '<td class="main">',
)
#: Classes of what is not the article.
_AROUND = {
    "menu": ("menu", "navbar", "nav", "navigation", "breadcrumbs", "top-links", "tabs", "pagination"),
    "header": ("header", "site-header", "masthead", "topbar", "branding"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom"),
    "aside": ("sidebar", "side", "related", "widget", "recommended", "more-stories", "popular"),
    "notice": ("cookie-notice", "notice", "alert", "consent", "gdpr", "popup", "modal", "overlay", "paywall"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"),
    "form": ("search", "newsletter", "login", "signup", "subscribe", "contact-form"),
    "comments": ("comments", "comment", "discussion", "replies", "disqus", "reader-comments"),
    "share": ("share", "social", "toolbar", "tags", "byline-links"),
}
_OWN_TAG = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        out = ["".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(n)]
        return " ".join(out).capitalize()

    def prose(self, sentences: int) -> str:
        return " ".join(self.words(2, 18) + self.rng.choice("...,.!?") for _ in range(sentences))

    def links(self, low: int, high: int) -> str:
        item = lambda: f'<a href="/{self.rng.randint(1, 99)}">{self.words(1, 3)}</a>'
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(self.rng.randint(low, high))) + "</ul>"
        return self.rng.choice((" | ", " ", " &middot; ")).join(item() for _ in range(self.rng.randint(low, high)))

    def around(self, kind: str) -> str:
        """A part that is not the article."""
        rng, name = self.rng, self.rng.choice(_AROUND[kind])
        own = _OWN_TAG.get(kind)
        tag = own if own and rng.random() < 0.6 else rng.choice(("div", "div", "section"))
        attributes = "" if own == tag and tag not in ("section", "header") and rng.random() < 0.5 else f' {rng.choice(("class", "class", "id"))}="{name}"'
        if kind == "menu":
            body = self.links(3, 8)
        elif kind == "header":
            body = f"<div>{self.words(1, 4)}</div>" + (f"<p>{self.prose(1)}</p>" if rng.random() < 0.5 else self.links(2, 4))
        elif kind == "footer":
            body = rng.choice((f"&copy; {self.words(1, 3)} &middot; {self.prose(rng.randint(1, 3))}", f"<p>&copy; 20{rng.randint(10, 26)} {self.words(1, 4)}</p>", self.links(2, 6)))
        elif kind == "aside":
            body = f"<h3>{self.words(1, 4)}</h3>" + (self.links(2, 6) if rng.random() < 0.5 else f"<p>{self.prose(rng.randint(1, 4))}</p>")
        elif kind == "form":
            body = f'<label>{self.words(1, 4)}</label><input name="q"><button>{self.words(1, 2)}</button>' + (f"<p>{self.prose(1)}</p>" if rng.random() < 0.4 else "")
        elif kind == "comments":
            inner = rng.choice(('<div class="comment">', "<li>", '<article class="comment">', "<div>"))
            close = "</" + inner[1:].split()[0].rstrip(">") + ">"
            body = f"<h3>{self.words(1, 3)}</h3>" + "".join(f"{inner}<b>{self.words(1, 2)}</b><p>{self.prose(rng.randint(1, 4))}</p>{close}" for _ in range(rng.randint(1, 4)))
        elif kind == "share":
            body = self.links(2, 5)
        else:
            body = rng.choice((self.prose(rng.randint(1, 3)), f"<p>{self.prose(rng.randint(1, 2))}</p>", f"{self.words(2, 9)} <a href='#'>{self.words(1, 2)}</a>"))
        return f"<{tag}{attributes}>{body}</{tag}>"

    def block(self) -> str:
        """A part of the article."""
        rng, kind = self.rng, self.rng.random()
        if kind < 0.68:
            bold = rng.choice(("", "", "", "<b>", "<em>"))
            return f"<p data-main>{bold}{self.prose(rng.randint(1, 8))}{'<br>' if bold and rng.random() < 0.5 else ''}{'' if rng.random() < 0.3 else '</p>'}"
        if kind < 0.78:
            level = rng.choice("234")
            return f"<h{level} data-main>{self.words(1, 8)}</h{level}>"
        if kind < 0.86:
            return "<ul data-main>" + "".join(f"<li>{self.words(1, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.90:
            return f"<blockquote data-main><p>{self.prose(rng.randint(1, 3))}</p></blockquote>"
        if kind < 0.93:
            return f"<pre data-main>{self.words(2, 20)}</pre>"
        if kind < 0.96:
            return "<table data-main>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"
        return f"<div data-main>{self.prose(rng.randint(1, 6))}</div>"

    def page(self) -> str:
        rng = self.rng
        some = lambda kinds, p: "".join(self.around(k) for k in kinds if rng.random() < p)
        opening = rng.choice(_ARTICLES)
        closing = "</" + opening[1:].split()[0].rstrip(">") + ">"
        blocks = [f"<h1 data-main>{self.words(1, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 12)):
            blocks.append(self.block())
            if rng.random() < 0.12:
                blocks.append(self.around(rng.choice(("advert", "advert", "notice", "aside", "share", "form"))))
        if rng.random() < 0.15:
            blocks.append(self.around("comments"))
        article = opening + "".join(blocks) + closing
        before = some(("header", "menu", "notice", "advert", "form"), 0.5)
        after = some(("share", "comments", "aside", "advert", "footer"), 0.55)
        outer = rng.choice(_CONTAINERS)
        body = before + article + after
        if outer:
            body = f'<div class="{outer}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    writer = _Writer(random.Random(seed))
    return [writer.page() for _ in range(n)]
