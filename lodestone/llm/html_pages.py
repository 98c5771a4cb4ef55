"""Labelled pages to train the extractor on: made from page layouts, with the main text of each known.

A fixed number of pages is drawn from a seeded generator, so the training sample is bounded by its `pages`
parameter. Layouts range from semantic elements to nested plain boxes told apart by class names or by their
text alone, tables whose cells have no names, and pages without any boxes; comments and lines on rights may
stand within the main box.
"""

from __future__ import annotations

import html
import random

MAIN, REST = 1, 0
#: Class and id words that web pages use for what a box holds.
NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "main-menu", "toc", "pagination", "pager", "links"],
    "header": ["header", "masthead", "site-header", "page-header", "banner", "brand", "logo", "top"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon", "credits"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "more-stories", "rail", "tags", "side"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "alert", "gdpr", "message", "paywall", "warning", "popup", "modal", "subscribe"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad-slot", "banner-ad", "sponsor"],
    "form": ["form", "search", "login", "newsletter", "signup", "contact-form", "search-box", "subscribe-form"],
    "comments": ["comments", "comment", "comment-list", "reply", "discussion", "responses", "disqus", "user-comment", "reader-comments"],
    "share": ["share", "social", "social-links", "share-buttons", "follow", "toolbar"],
    "main": ["article", "content", "post", "entry", "story", "post-content", "entry-content", "article-body", "main", "main-content", "text", "body", "page-content"],
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section", "main": "article"}
SYLLABLES = ["th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve", "en er ch ei ie un sch ge be ver lich keit heit ung au ö ü ß", "en le re de tion ment qu é è ai ou eau eux tre ê ç", "de la os ar es ado ción ía ó ñ que en an ir"]
SHORT = ["Home", "About us", "Contact", "Log in", "Register", "Next", "Previous", "Share", "Tweet", "Privacy policy", "Terms of use", "Read more", "Menu", "Search", "Subscribe", "Reply", "Top"]


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.blocks: list[tuple[str, int]] = []
        self.parts = self.rng.choice(SYLLABLES).split()

    def words(self, low: int, high: int) -> str:
        rng, out = self.rng, []
        for _ in range(rng.randint(low, high)):
            word = "".join(rng.choice(self.parts) for _ in range(rng.choice((1, 1, 2, 3, 4))))
            if rng.random() < self.noise:
                word += rng.choice(("###", "&&&", "%%%", "***", "$$$"))
            out.append(word + rng.choice(("", "", "", "", "", ",", ".")))
        text = " ".join(out)
        return text[:1].upper() + text[1:]

    def text(self, text: str, label: int, tag: str, inner: str | None = None) -> str:
        """A block of its own; its characters are escaped here."""
        if text.strip():
            self.blocks.append((" ".join(text.split()), label))
        shown = inner.replace("@", html.escape(text, quote=False)) if inner else html.escape(text, quote=False)
        closing = "" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>"
        return f"<{tag}>{shown}{closing}"

    def box(self, kind: str, body: str) -> str:
        rng = self.rng
        tag = SEMANTIC.get(kind, "div") if rng.random() < self.semantic else rng.choice(("div", "div", "section", "td"))
        named = tag in ("div", "section", "td") and rng.random() < (0.97 if kind != "main" else 0.8)
        name = rng.choice(NAMES[kind]) + rng.choice(("", "", "-1", " box", " clearfix", "__inner"))
        attribute = f' {rng.choice(("class", "class", "id"))}="{name}"' if named else ""
        out = f"<{tag}{attribute}>{body}</{tag}>"
        return f"<table><tr>{out}</tr></table>" if tag == "td" else out

    def links(self, kind: str) -> str:
        rng = self.rng
        items = [rng.choice(SHORT) if rng.random() < 0.4 else self.words(1, 4 if kind == "menu" else 9) for _ in range(rng.randint(2, 8))]
        title = self.text(self.words(1, 3), REST, rng.choice(("h2", "h3", "h4", "p"))) if kind != "menu" and rng.random() < 0.6 else ""
        return self.box(kind, title + "<ul>" + "".join(self.text(x, REST, "li", '<a href="/x">@</a>') for x in items) + "</ul>")

    def plain(self, kind: str, low: int, high: int, most: int = 1) -> str:
        tags = ("p", "div", "span") if kind != "comments" else ("p", "div")
        return self.box(kind, "".join(self.text(self.words(low, high), REST, self.rng.choice(tags)) for _ in range(self.rng.randint(1, most))))

    def form(self) -> str:
        label = self.text(self.words(1, 6), REST, self.rng.choice(("label", "p", "h3")))
        return self.box("form", f'<form action="/s">{label}<input type="text" name="q"><button>' + self._button() + "</button></form>")

    def _button(self) -> str:
        text = self.rng.choice(SHORT)
        self.blocks.append((text, REST))
        return text

    def comments(self) -> str:
        rng = self.rng
        head = self.text(rng.choice(("Comments", self.words(1, 2))), REST, "h3") if rng.random() < 0.7 else ""
        body = ""
        for _ in range(rng.randint(1, 5)):

            body += f'<div class="{rng.choice(("comment", "reply", "comment-body", "c"))}">' + self.text(self.words(3, 60), REST, "p") + "</div>"
        return self.box("comments", head + body)

    def main(self) -> str:
        rng = self.rng
        out = self.text(self.words(3, 12), MAIN, rng.choice(("h1", "h1", "h2"))) if rng.random() < 0.9 else ""
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12, 20))):
            kind = rng.random()
            if kind < 0.72:
                inner = rng.choice((None, None, None, "<b>@<br>", "<em>@</em>", '<a href="/y">@</a> ', "@<br>"))
                if inner and inner.startswith("<a") and rng.random() < 0.7:
                    inner = None
                out += self.text(self.words(*rng.choice(((1, 4), (4, 25), (20, 90), (20, 90), (60, 300)))), MAIN, "p", inner)
            elif kind < 0.82:
                out += self.text(self.words(1, 8), MAIN, rng.choice(("h2", "h3", "h4")))
            elif kind < 0.9:
                tag = rng.choice(("ul", "ol"))
                out += f"<{tag}>" + "".join(self.text(self.words(2, 25), MAIN, "li") for _ in range(rng.randint(2, 6))) + f"</{tag}>"
            elif kind < 0.94:
                out += self.text(self.words(5, 40), MAIN, rng.choice(("blockquote", "pre", "figcaption", "td")))
            elif self.inserts:
                out += rng.choice((self.ad, self.share, lambda: self.links("side"), lambda: self.plain("notice", 3, 20)))()
        if rng.random() < 0.25:
            out += self.comments()
        if rng.random() < 0.1:
            out += self.rights()
        return out

    def ad(self) -> str:
        return self.plain("ad", 2, 30)

    def share(self) -> str:
        return self.box("share", "".join(self.text(self.rng.choice(SHORT), REST, self.rng.choice(("span", "a", "li", "div"))) for _ in range(1)))

    def rights(self) -> str:
        """A line on rights at the end, without a name around it."""
        rng = self.rng
        mark = rng.choice(("©", "Copyright", "Copyright ©", "(c)"))
        line = f"{mark} {rng.randint(1995, 2030)} {self.words(0, 4)}".strip() + rng.choice(("", ".", ". All rights reserved.", " All rights reserved"))
        return self.text(line, REST, rng.choice(("p", "p", "div", "small")))

    def bare(self, tag: str) -> str:
        """What a column or page without names may hold beside the main text."""
        rng = self.rng
        body = "".join(self.text(rng.choice((rng.choice(SHORT), self.words(1, 5))), REST, rng.choice(("li", "div", "p")), '<a href="/x">@</a>') for _ in range(rng.randint(2, 8)))
        if rng.random() < 0.4:
            body = f"<ul>{body}</ul>"
        return f"<{tag}>{body}</{tag}>" if tag else body

    def columns(self) -> str:
        """A page laid out as a table without names: the main text in one cell, links in the others."""
        rng = self.rng
        rows = f"<tr><td>{self.text(self.words(1, 4), REST, rng.choice(('b', 'span', 'div')))}</td></tr>" if rng.random() < 0.4 else ""
        left = self.bare("td") if rng.random() < 0.8 else ""
        cells = f"{left}<td>{self.main()}</td>"
        rows += f"<tr>{cells}{self.bare('td') if rng.random() < 0.5 or not left else ''}</tr>"
        if rng.random() < 0.5:
            rows += f"<tr><td>{self.rights()}</td></tr>"
        return f"<table>{rows}</table>"

    def naked(self) -> str:
        """A page without boxes: headline, paragraphs, and perhaps links before and a line on rights after them."""
        rng = self.rng
        out = self.bare(rng.choice(("", "div", "p"))) if rng.random() < 0.5 else ""
        out += self.main()
        return out + (self.rights() if rng.random() < 0.7 else "")

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        rng = self.rng
        self.semantic = rng.choice((0.0, 0.3, 0.9, 1.0))
        self.noise = rng.choice((0.0, 0.0, 0.0, 0.6))
        self.inserts = rng.random() < 0.5
        title = html.escape(self.words(2, 8), quote=False)
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        before = [lambda: self.links("menu"), lambda: self.plain("header", 1, 8), self.ad, lambda: self.plain("notice", 5, 40, 2), self.form, lambda: self.links("menu"), lambda: self.links("side"), self.share]
        after = [lambda: self.links("side"), self.ad, self.comments, self.comments, self.form, lambda: self.plain("footer", 2, 40, 2), lambda: self.links("footer"), self.share, lambda: self.plain("side", 3, 40, 3), lambda: self.plain("notice", 5, 40)]
        out = head
        self.layout = rng.choices(("boxes", "columns", "naked"), (0.7, 0.15, 0.15))[0]
        if self.layout != "boxes":
            out += self.columns() if self.layout == "columns" else self.naked()
            return out + rng.choice(("</body></html>", "")), self.blocks
        for make in rng.sample(before, rng.randint(0, 4)):
            out += make() + rng.choice(("", "", "<!-- x -->", "\n"))
        body = self.box("main", self.main())
        wrap = rng.random()
        if wrap < 0.3:
            body = f"<main>{body}</main>"
        elif wrap < 0.6:
            body = f'<div class="{rng.choice(("wrapper", "container", "page", "row", "layout"))}">{body}</div>'
        out += body
        for make in rng.sample(after, rng.randint(0, 5)):
            out += make() + rng.choice(("", "", "<!-- x -->", "\n"))
        return out + rng.choice(("</body></html>", "</body></html>", "")), self.blocks


def labelled_pages(pages: int, seed: int = 5, layout: str | None = None) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pairs of a page's html and its blocks, each with its label; of one layout (boxes, columns, naked), if named."""
    out, i = [], 0
    while len(out) < pages:
        maker = Maker(seed * 1_000_003 + i)
        made = maker.page()
        if layout in (None, maker.layout):
            out.append(made)
        i += 1
    return out
