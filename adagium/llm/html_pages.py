"""Generated pages with known main text, to train and to test the block labeller.

Words are drawn from random syllables, so only elements, their names, block
shapes and a small set of stock phrases tell main text from the rest.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "an ar at be ca che co da de di do el en er es et fa ge ha he in is it ka la le li lo ma me mi na ne no on or ou pa pe po qu ra re ri ro sa se si so ta te th ti to tra un ur va ve vi wa za eau été ión ñar sch ung keit öl ßen über łó ão çan".split()
#: Stock phrases of page furniture; X stands for a random word.
PHRASES = {
    "menu": ["Home", "About", "About us", "Contact", "News", "Blog", "Login", "Log in", "Sign up", "Search", "Archive", "X", "X", "X", "X X", "Products", "Help", "FAQ", "Menu", "Next", "Previous", "Startseite", "Accueil", "Inicio", "Kontakt"],
    "header": ["X X", "The X daily", "Welcome to X", "X - X news", "Skip to content", "Menu", "Search", "X.com"],
    "footer": ["© 2024 X. All rights reserved.", "© X X", "Copyright X", "Privacy policy | Terms of use", "Impressum", "Mentions légales", "Powered by X", "© x.example.org · X x x x.", "Contact us: X", "All rights reserved", "Follow us", "Terms", "Privacy"],
    "notice": ["We use cookies to improve your experience. X x x.", "This site uses cookies.", "Accept", "Accept all cookies", "Nous utilisons des cookies", "Diese Website verwendet Cookies.", "Please enable JavaScript", "You are using an outdated browser.", "Subscribe to keep reading", "Breaking: x x x"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Buy now X x", "X x x x x.", "Save 20% on X today!", "Nur heute: X", "X x x x x x x x."],
    "form": ["Subscribe", "Your e-mail", "Name", "Submit", "Send", "Password", "Enter your email to get our newsletter", "Search", "Leave a reply", "Post comment", "Sign up for X"],
    "side": ["Related articles", "Popular posts", "Recent comments", "Tags", "Most read", "X x x", "X x x x x", "Categories", "Archives", "See also X"],
    "comment": ["X x x x x x.", "X x x x x x x x x x x. X x x!", "Great post, X!", "X says:", "Reply", "3 comments", "Comments", "X x x x? X x x x x x.", "Posted by X at 10:23"],
    "share": ["Share", "Share on X", "Tweet", "Print", "Email this", "Like"],
}
#: Names under which page furniture stands in class and id.
NAMES = {
    "menu": ["nav", "menu", "navbar", "main-nav", "breadcrumb", "breadcrumbs", "top-menu", "navigation", "pagination", "pager"],
    "header": ["header", "site-header", "masthead", "topbar", "banner", "page-header", "branding"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "colophon", "bottom"],
    "notice": ["cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "message-bar", "cookie-notice"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad", "adsbox"],
    "form": ["newsletter", "subscribe", "search-form", "login", "signup", "search"],
    "side": ["sidebar", "aside", "related", "widget", "side-column", "recommended", "popular", "secondary"],
    "comment": ["comments", "comment-list", "comment", "disqus", "discussion", "responses", "reader-comments"],
    "share": ["share", "social", "share-buttons", "sharing", "toolbar"],
    "main": ["content", "main", "article", "post", "entry", "post-content", "entry-content", "article-body", "story", "text", "body-text", "page-content", "maincontent"],
    "plain": ["wrapper", "container", "row", "inner", "col", "page", "layout", "outer", "box", "site", "wrap"],
}
ELEMENTS = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "notice": ["div", "div", "dialog", "section", "aside", "p"], "ad": ["div", "div", "aside", "section", "p", "ins"], "form": ["form"], "side": ["aside", "aside", "div", "section"], "comment": ["section", "div", "ol"], "share": ["div", "ul", "p"]}


class Maker:
    def __init__(self, seed: str):
        self.rng = random.Random(seed)
        self.syllables = self.rng.sample(SYLLABLES, 18)
        self.main: set[str] = set()

    def one(self, items):
        return items[int(self.rng.random() * len(items))]

    def between(self, low: int, high: int) -> int:
        """low or more, below high."""
        return low + int(self.rng.random() * (high - low))

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        return "".join(self.one(self.syllables) for _ in range(self.between(1, 5)))

    def words(self, n: int, marks: bool = True) -> str:
        out = [self.word() for _ in range(n)]
        if out:
            out[0] = out[0].capitalize()
        if self.noisy:
            out = [w + self.one("!#$%&*+=?@^_~") * self.between(1, 5) if self.chance(0.6) else w for w in out]
        elif marks:
            out = [w + "," if self.chance(0.08) else w for w in out]
        return " ".join(out)

    noisy = False

    def odd(self) -> str:
        """Main text that doesn't look like prose."""
        w = self.word()
        return self.one([
            lambda: f"{w.capitalize()} " + f"{self.word()} " * self.between(1, 4) + (self.word() + " ") * self.between(3, 90),
            lambda: " | ".join(self.word() for _ in range(self.between(1, 30))) + " |",
            lambda: self.words(self.between(1, 12)).upper() + "!!",
            lambda: w.capitalize() + ".",
            lambda: (self.one([w, "The", "In", "We", "All"]).capitalize() + " ") * self.between(3, 60),
            lambda: f"{w[:2].capitalize()}. {self.word().capitalize()}.",
            lambda: self.words(self.between(2, 7)) + ".",
            lambda: f"{self.between(1, 99999)} {w} {self.between(1, 99)}",
        ])().strip()

    def prose(self) -> str:
        if self.chance(0.1):
            return self.odd()
        kind = self.rng.random()
        n = self.between(1, 6) if kind < 0.15 else self.between(6, 60) if kind < 0.7 else self.between(60, 300)
        out, left = [], n
        while left > 0:
            k = min(left, self.between(3, 16))
            out.append(self.words(k) + self.one([".", ".", ".", "?", "!", ""]))
            left -= k
        return " ".join(out)

    def phrase(self, kind: str) -> str:
        p = self.one(PHRASES[kind])
        if kind in ("ad", "side", "comment", "notice", "footer") and self.chance(0.35):
            p = p + " " + self.prose() if self.chance(0.5) else self.prose()
        return " ".join(self.word().capitalize() if w == "X" else self.word() if w == "x" else w for w in p.split(" "))

    def named(self, kind: str, p: float) -> str:
        if not self.chance(p):
            return ""
        return f' {self.one(["class", "class", "id"])}="{self.one(NAMES[kind])}"'

    def furniture(self, kind: str) -> str:
        tag = self.one(ELEMENTS[kind])
        certain = tag in ("nav", "header", "footer", "form", "aside")
        attr = self.named(kind, 0.5 if certain else 1.0)
        n = 1 if kind in ("notice", "ad") and self.chance(0.7) else self.between(1, 8)
        items = [html.escape(self.phrase(kind), quote=False) for _ in range(n)]
        link = {"menu": 0.95, "share": 0.9, "side": 0.6, "footer": 0.4, "header": 0.5}.get(kind, 0.15)
        items = [f'<a href="/{self.word()}">{x}</a>' if self.chance(link) else x for x in items]
        if kind == "form":
            inner = "".join(self.one([f"<label>{x}</label><input>", f"<button>{x}</button>", f"<p>{x}</p>", f"<div>{x}</div>"]) for x in items)
        elif tag in ("ul", "ol"):
            inner = "".join(f"<li>{x}</li>" for x in items)
        elif kind == "comment":
            inner = "".join(self.one([f'<div class="comment"><p>{x}</p></div>', f"<p>{x}</p>", f"<li>{x}</li>", f"<article><p>{x}</p></article>"]) for x in items)
        elif tag == "p":
            inner = " ".join(items)
        elif kind in ("menu", "side", "share") and self.chance(0.7):
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        else:
            inner = self.one(["".join(f"<p>{x}</p>" for x in items), "".join(f"<div>{x}</div>" for x in items), " ".join(items)])
        if kind in ("side", "comment", "menu") and self.chance(0.3):
            inner = f"<h{self.between(2, 5)}>{html.escape(self.phrase(kind), quote=False)}</h3>" + inner
        return f"<{tag}{attr}>{inner}</{tag}>"

    def kept(self, text: str) -> str:
        """Markup of a block of main text; its text is noted."""
        self.main.add(" ".join(text.split()))
        parts = text.split(" ")
        for _ in range(self.between(0, 3)):
            i = self.between(0, len(parts))
            t = self.one(["b", "i", "em", "strong", "span", 'a href="/x"', "code"])
            parts[i] = f"\0{t}\1{parts[i]}\0/{t.split(' ')[0]}\1"
        return html.escape(" ".join(parts), quote=False).replace("\0", "<").replace("\1", ">")

    def body(self) -> str:
        out = []
        if self.chance(0.85):
            title = self.odd() if self.chance(0.15) else self.words(self.between(1, 14), False) + self.one(["", "", "."])
            out.append(f"<h1>{self.kept(title)}</h1>")
        n = self.between(1, 9) if self.chance(0.85) else self.between(9, 60)
        for _ in range(n):
            r = self.rng.random()
            if r < 0.74:
                x = self.kept(self.prose())
                out.append(self.one([f"<p>{x}</p>", f"<p>{x}</p>", f"<p>{x}</p>", f"<p><i>{x}</p></i>", f"<p>{x}", f"<div>{x}<br></div>"]))
            elif r < 0.82:
                k = self.between(2, 4)
                out.append(f"<h{k}>{self.kept(self.words(self.between(1, 8), False))}</h{k}>")
            elif r < 0.88:
                t = self.one(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{self.kept(self.words(self.between(2, 20)))}</li>" for _ in range(self.between(2, 6))) + f"</{t}>")
            elif r < 0.91:
                out.append(f"<blockquote><p>{self.kept(self.prose())}</p></blockquote>")
            elif r < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.kept(self.words(2))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif r < 0.95:
                out.append(f"<pre>{self.kept(self.words(12))}</pre>")
            elif r < 0.96:
                out.append(self.one(["<p hidden>{}</p>", '<div style="display: none"><p>{}</p></div>', "<span style='visibility:hidden'>{}</span>"]).format(html.escape(self.prose(), quote=False)))
            else:
                out.append(self.furniture(self.one(["ad", "form", "share", "side", "ad", "notice"])))
        return "".join(out)

    def wrap(self, inner: str, levels: int) -> str:
        for _ in range(levels):
            inner = f"<div{self.named('plain', 0.7)}>{inner}</div>"
        return inner


def page(seed: str) -> tuple[str, set[str]]:
    """(html, texts of its main blocks) of one generated page."""
    m = Maker(seed)
    m.noisy = m.chance(0.08)
    style = m.rng.random()
    body = m.body()
    if style < 0.45:
        article = f"<article{m.named('main', 0.3)}>{body}</article>"
    elif style < 0.6:
        article = f"<main>{m.wrap(body, m.between(0, 2))}</main>"
    elif style < 0.9:
        article = f'<div {m.one(["class", "id"])}="{m.one(NAMES["main"])}">{body}</div>'
    else:
        article = m.wrap(body, m.between(0, 3))
    before = [m.furniture(k) for k in ("notice", "header", "menu", "ad", "form", "menu", "side") if m.chance(0.4)]
    after = [m.furniture(k) for k in ("share", "form", "comment", "side", "ad", "menu", "footer", "notice") if m.chance(0.4)]
    if m.chance(0.4):
        before = [m.furniture("menu"), m.furniture("ad")]
    if m.chance(0.4):
        after = [m.furniture("footer")]
    inside = m.wrap("".join([*before, article, *after]), m.between(0, 3))
    if m.chance(0.3):
        inside = "".join(before) + m.wrap(article, m.between(0, 3)) + "".join(after)
    head = [f"<title>{m.words(m.between(1, 9), False)}</title>", '<meta charset="utf-8">', "<style>.a > b { color: #222 } /* <div> */</style>", f'<script>window.{m.word().encode("ascii", "ignore").decode()}x = "<section>";</script>', '<link rel="icon" href="/i.png">']
    head = m.one(["<!DOCTYPE html>", "<!doctype html>\n", ""]) + f"<html{m.one(['', ' lang=\"xx\"'])}><head>" + "".join(x for x in head if m.chance(0.6)) + f"</head><body{m.named('plain', 0.3)}>"
    return head + inside + ("</body></html>" if m.chance(0.9) else ""), m.main
