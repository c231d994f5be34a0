"""Generated web pages with known main text, to fit and test the extraction trees.

Page parts are dealt at random into many layouts. ``data-y`` on an element says
whether the text in it is main text (1) or not (0).
"""

from __future__ import annotations

import random

#: Ways in which pages name their parts.
NAMES = {
    "ad": ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", ""],
    "nav": ["nav", "menu", "navbar", "main-menu", "site-nav", "breadcrumbs", ""],
    "side": ["sidebar", "widget", "rail", "secondary", "side", ""],
    "notice": ["cookie-notice", "consent", "alert", "notice", "popup", "gdpr-banner"],
    "comments": ["comments", "comment-list", "discussion", "replies", "disqus", "reader-comments"],
    "share": ["share", "social", "newsletter", "subscribe", "signup"],
    "related": ["related", "recommended", "trending", "more-stories"],
    "main": ["content", "post", "entry", "article-body", "story", "main", "", ""],
    "head": ["header", "masthead", "site-header", "topbar", ""],
    "foot": ["footer", "site-footer", "bottom", "copyright", ""],
}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = rng.choice(["etaoinshrdlu", "eaoinrstldcu", "äeinrstuüoßdl", "éeaisnrtulè"])
        self.words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(200)]

    def text(self, low: int, high: int, stops: bool = True) -> str:
        rng, out = self.rng, []
        for _ in range(rng.randint(low, high)):
            w = rng.choice(self.words)
            out.append(w + (rng.choice([".", ",", ".", "!", " &amp;", "?"]) if stops and rng.random() < 0.12 else ""))
        return (" ".join(out)).capitalize() + ("." if stops and rng.random() < 0.9 else "")

    def named(self, kind: str) -> str:
        name = self.rng.choice(NAMES[kind])
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"' if name else ""

    def tag(self, name: str, inside: str, y: int | None = None, attr: str = "") -> str:
        mark = "" if y is None else f' data-y="{y}"'
        return f"<{name}{attr}{mark}>{inside}</{name}>"

    def links(self, n: int, name: str = "ul") -> str:
        items = "".join(f'<li><a href="/{self.rng.choice(self.words)}">{self.text(1, 4, False)}</a></li>' for _ in range(n))
        return f"<{name}>{items}</{name}>"

    def nav(self) -> str:
        return self.tag(self.rng.choice(["nav", "nav", "div", "menu"]), self.links(self.rng.randint(3, 9)), 0, self.named("nav") or ' class="menu"')

    def ad(self) -> str:
        name = self.rng.choice([x for x in NAMES["ad"] if x])
        inside = self.text(4, 25)
        if self.rng.random() < 0.4:
            inside = f"<p>{inside}</p>"
        return self.tag(self.rng.choice(["div", "div", "aside", "section"]), inside, 0, f' class="{name}"')

    def side(self) -> str:
        inside = "".join(self.rng.choice([lambda: f"<h3>{self.text(1, 4, False)}</h3>" + self.links(3), lambda: f"<p>{self.text(5, 40)}</p>", self.ad])() for _ in range(self.rng.randint(1, 4)))
        name = self.rng.choice(["aside", "aside", "div"])
        return self.tag(name, inside, 0, f' class="{self.rng.choice([x for x in NAMES["side"] if x])}"' if name == "div" else self.named("side"))

    def notice(self) -> str:
        return self.tag(self.rng.choice(["div", "section", "dialog"]), self.tag("p", self.text(6, 40)) + "<button>OK</button>" * self.rng.randint(0, 1), 0, f' class="{self.rng.choice(NAMES["notice"])}"')

    def form(self) -> str:
        return self.tag("form", f"<label>{self.text(1, 4, False)}</label><input name=q><button>{self.text(1, 2, False)}</button>" + self.rng.choice(["", f"<p>{self.text(4, 20)}</p>"]), 0, self.named("share") if self.rng.random() < 0.5 else "")

    def share(self) -> str:
        return self.tag("div", self.rng.choice([self.links(3), f"<p>{self.text(4, 20)}</p>", self.text(3, 10)]), 0, f' class="{self.rng.choice(NAMES["share"])}"')

    def related(self) -> str:
        return self.tag(self.rng.choice(["div", "section"]), f"<h2>{self.text(1, 4, False)}</h2>" + self.links(self.rng.randint(2, 6)), 0, f' class="{self.rng.choice(NAMES["related"])}"')

    def comments(self) -> str:
        one = lambda: self.rng.choice(["<li><b>{}</b><p>{}</p></li>", "<div class=comment><p>{}</p><p>{}</p></div>", "<article class=comment><p>{}: {}</p></article>", "<li>{} {}</li>"]).format(self.text(1, 2, False), self.text(5, 80))
        inside = "".join(one() for _ in range(self.rng.randint(1, 7)))
        name = self.rng.choice(["section", "div", "ol"])
        return self.tag(name, (f"<h3>{self.text(1, 3, False)}</h3>" if name != "ol" else "") + inside, 0, f' {self.rng.choice(["class", "id"])}="{self.rng.choice(NAMES["comments"])}"')

    def header(self) -> str:
        inside = self.rng.choice([self.nav, lambda: f"<a href=/>{self.text(1, 3, False)}</a>", lambda: f"<p>{self.text(3, 12)}</p>", lambda: f"<h2>{self.text(1, 4, False)}</h2>" + self.nav()])()
        name = self.rng.choice(["header", "header", "div"])
        return self.tag(name, inside, 0, f' class="{self.rng.choice(["header", "masthead", "site-header", "topbar"])}"' if name == "div" else self.named("head"))

    def footer(self) -> str:
        inside = self.rng.choice([lambda: f"&copy; {self.text(1, 3)} &middot; {self.text(3, 40)}", lambda: f"<p>{self.text(3, 40)}</p>" + self.links(4), lambda: self.links(6), lambda: f"<p>&copy; {self.text(2, 8)}</p>"])()
        name = self.rng.choice(["footer", "footer", "div"])
        return self.tag(name, inside, 0, f' class="{self.rng.choice(["footer", "site-footer", "bottom", "copyright"])}"' if name == "div" else self.named("foot"))

    def block(self) -> str:
        rng = self.rng
        r = rng.random()
        if r < 0.62:
            return f"<p>{self.text(*rng.choice([(1, 3), (5, 40), (30, 160)]))}</p>"
        if r < 0.72:
            return f"<p><b>{self.text(2, 30)}<br>" if rng.random() < 0.7 else f"<p>{self.text(5, 40)}"
        if r < 0.80:
            return f"<h{(k := rng.randint(2, 4))}>{self.text(1, 9, False)}</h{k}>"
        if r < 0.86:
            name = rng.choice(["ul", "ol"])
            return f"<{name}>" + "".join(f"<li>{self.text(2, 25)}</li>" for _ in range(rng.randint(2, 6))) + f"</{name}>"
        if r < 0.90:
            return f"<blockquote>{self.text(5, 40)}</blockquote>"
        if r < 0.93:
            return f"<pre>{self.text(5, 40)}</pre>"
        if r < 0.96:
            return f"<figure><img src=x><figcaption>{self.text(3, 15)}</figcaption></figure>"
        return f'<p>{self.text(5, 30)} <a href="/x">{self.text(1, 5, False)}</a> {self.text(3, 30)}</p>'

    def article(self) -> str:
        rng = self.rng
        parts = [f"<h1>{self.text(2, 14)}</h1>"] if rng.random() < 0.9 else []
        parts += [self.block() for _ in range(rng.choice([1, 2, 3, 6, 12, 25]))]
        inside = list(parts)
        for extra in (self.ad, self.share, self.related, self.form, self.comments, self.side):
            if rng.random() < 0.12:
                inside.insert(rng.randint(1, len(inside)), extra())
        body = "".join(inside)
        style = rng.random()
        if style < 0.5:
            return self.tag("article", body, 1, self.named("main") if rng.random() < 0.4 else "")
        if style < 0.65:
            return self.tag("main", self.tag("article", body) if rng.random() < 0.5 else body, 1)
        if style < 0.75:
            return self.tag("main", self.tag("div", body, None, self.named("main")), 1)
        name = rng.choice([x for x in NAMES["main"] if x])
        return self.tag(rng.choice(["div", "section"]), body, 1, f' {rng.choice(["class", "id"])}="{name}"')

    def html(self) -> str:
        rng = self.rng
        maybe = lambda p, f: f() if rng.random() < p else ""
        title = self.text(2, 10, False)
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";track(0);</script></head><body>'
        before = [maybe(0.4, self.header), maybe(0.75, self.nav), maybe(0.1, lambda: "<!-- note -->"), maybe(0.45, self.ad), maybe(0.2, self.notice), maybe(0.15, self.form), maybe(0.15, self.side)]
        after = [maybe(0.3, self.side), maybe(0.25, self.comments), maybe(0.2, self.related), maybe(0.2, self.share), maybe(0.2, self.form), maybe(0.25, self.ad)]
        rng.shuffle(after)
        end = [maybe(0.85, self.footer), maybe(0.15, self.notice)]
        middle = "".join(before) + self.article() + "".join(after)
        if rng.random() < 0.25:
            middle = self.tag("div", middle, None, rng.choice(["", ' class="wrapper"', ' id="page"']))
        return head + middle + "".join(end) + ("</body></html>" if rng.random() < 0.9 else "")


def sample_page(seed: int) -> str:
    """The page of a seed."""
    return _Page(random.Random(seed)).html()
