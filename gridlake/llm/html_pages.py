"""Labelled training pages: seeded, generated HTML in many layouts, with every block marked as main text or not.

The invented words carry no meaning, so what a model can learn is structure: tags, names of classes, the usual
words of menus, notices and footers, lengths, links, and the order of blocks in a page.
"""

from __future__ import annotations

import numpy as np

#: First character of a generated block's text: main text or not.
MAIN, OTHER = "\ue001", "\ue000"

#: Fixed lists: usual names and words of page parts, by part.
NAMES = {
    "nav": ["nav", "menu", "navbar", "site-nav", "main-menu", "navigation", "topnav", "breadcrumbs", "tabs", "toolbar"],
    "header": ["header", "site-header", "masthead", "top", "banner", "logo", "page-header", "branding"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "page-footer", "legal", "credits"],
    "side": ["sidebar", "side", "widget", "aside", "related", "recommended", "popular", "tags", "archive", "secondary"],
    "notice": ["cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbox", "sponsor"],
    "form": ["form", "search", "login", "signup", "contact-form", "subscribe", "search-box"],
    "comments": ["comments", "comment-list", "replies", "discussion", "responses", "disqus", "comment-section", "reader-comments"],
    "share": ["share", "social", "sharing", "meta", "byline-tools", "social-links"],
    "main": ["content", "article", "post", "entry", "entry-content", "post-body", "main", "story", "article-body", "text", "body"],
}
WORDS = {
    "nav": "Home About Contact News Blog Products Services Login Register Search Menu Help FAQ Archive Start Über Kontakt Accueil Inicio",
    "header": "Welcome The official site Daily online magazine portal Your source for",
    "footer": "Copyright © 2024 All rights reserved Privacy Policy Terms of Service Imprint Impressum Sitemap Powered by Contact us",
    "side": "Related posts Recent articles Popular Tags Categories Most read Recommended for you Archives Read more Next Previous",
    "notice": "We use cookies to improve your experience Accept Decline By continuing you agree to our policy This site uses",
    "ad": "Advertisement Buy now Sale Free shipping Discount Offer Sponsored Click here Order today Limited",
    "form": "Name Email Password Message Submit Search Subscribe Your address Send Remember me",
    "comments": "Reply says Posted by at Leave a comment Report Like Comments",
    "share": "Share Tweet Print Email Facebook Posted on by min read Save",
}
_SYLLABLES = "an er in re st on th le me ti de ra co la os ie ch ve un be ge da no ri sa mo lu pi ka zu fo ta wi ex por que eau ung keit mente ción".split()


class PageMaker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high))))
        out = ["".join(self.one(_SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        if self.chance(0.04):
            out = [w for w in out[:12] for _ in range(int(self.rng.integers(5, 25)))]
        elif self.chance(0.04):
            out = [w.upper() + "!!" for w in out]
        if self.chance(0.85):
            out = [w + self.one([",", ".", ""]) if self.chance(0.15) else w for w in out]
            out[0] = out[0].title()
            out[-1] = out[-1].rstrip(",.") + "."
        elif self.chance(0.3):
            out = [w + self.one(["***", "%%%", "$$$", "###"]) for w in out]
        return " ".join(out)

    def usual(self, part: str, low: int, high: int) -> str:
        """Words of a page part, usual ones and invented ones."""
        if self.chance(0.45):
            return self.words(low, high)
        own = WORDS[part].split()
        return " ".join(self.one(own) if self.chance(0.7) else self.words(1, 1) for _ in range(int(self.rng.integers(low, high + 1))))

    def named(self, tag: str, part: str, inner: str) -> str:
        """An element of a part: its own HTML element, or a plain one with a name, or one with no hint at all."""
        if self.hints == 0:
            return f"<{tag}>{inner}</{tag}>"
        if self.hints == 1 and tag == "div":
            return f'<div class="{"".join(self.one(_SYLLABLES) for _ in range(2))}{int(self.rng.integers(99))}">{inner}</div>'
        kind = self.one(["class", "id"]) if self.chance(0.9) else "role"
        more = f" {self.one(_SYLLABLES)}" if self.chance(0.3) else ""
        return f'<{tag} {kind}="{self.one(NAMES[part])}{more}">{inner}</{tag}>'

    def item(self, mark: str, text: str, tag: str = "p") -> str:
        return f"<{tag}>{mark}{text}</{tag}>" if tag != "p" or self.chance(0.85) else f"<p>{mark}{text}"

    def links(self, part: str, low: int, high: int) -> str:
        own = [f'<a href="/{k}">{OTHER}{self.usual(part, 1, 3)}</a>' for k in range(int(self.rng.integers(low, high + 1)))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{a}</li>" for a in own) + "</ul>"
        return "".join(f"<div>{a}</div>" for a in own) if self.chance(0.5) else OTHER + " | ".join(own)

    def nav(self) -> str:
        inner = self.links("nav", 2, 9)
        return f"<nav>{inner}</nav>" if self.chance(0.6) else self.named("div", "nav", inner)

    def ad(self) -> str:
        text = self.item(OTHER, self.usual("ad", 3, 25), self.one(["p", "span", "div"])) if self.chance(0.5) else OTHER + self.usual("ad", 3, 25)
        return self.named(self.one(["div", "div", "aside", "section"]), "ad", text)

    def header(self) -> str:
        inner = self.item(OTHER, self.usual("header", 1, 7), self.one(["h1", "h2", "p", "div", "span"]))
        if self.chance(0.4):
            inner += self.item(OTHER, self.usual("header", 3, 10), self.one(["p", "span", "div"]))
        return f"<header>{inner}{self.nav() if self.chance(0.4) else ''}</header>" if self.chance(0.6) else self.named("div", "header", inner)

    def footer(self) -> str:
        inner = OTHER + self.usual("footer", 3, 20) if self.chance(0.5) else self.item(OTHER, self.usual("footer", 3, 20))
        if self.chance(0.4):
            inner += self.links("footer", 2, 6)
        return f"<footer>{inner}</footer>" if self.chance(0.65) else self.named("div", "footer", inner)

    def side(self) -> str:
        inner = self.item(OTHER, self.usual("side", 1, 4), self.one(["h2", "h3", "h4", "p"]))
        inner += self.links("side", 2, 8) if self.chance(0.7) else self.item(OTHER, self.words(5, 40))
        return f"<aside>{inner}</aside>" if self.chance(0.5) else self.named(self.one(["div", "section"]), "side", inner)

    def notice(self) -> str:
        inner = self.item(OTHER, self.usual("notice", 5, 30), self.one(["p", "div", "span"]))
        return self.named(self.one(["div", "section", "aside", "dialog"]), "notice", inner)

    def form(self) -> str:
        rows = "".join(self.one([f"<label>{OTHER}{self.usual('form', 1, 3)}</label><input name=x>",
                                 f"<p><label>{OTHER}{self.usual('form', 1, 3)}</label><textarea>x</textarea></p>",
                                 f"<div>{OTHER}{self.usual('form', 1, 3)}<input type=text></div>"])
                       for _ in range(int(self.rng.integers(1, 4))))
        return f"<form action=/x>{rows}<button>Send</button></form>" if self.chance(0.8) else self.named("div", "form", f"<form>{rows}</form>")

    def comments(self) -> str:
        tag = self.one(["div", "li", "article", "section"])
        own = ""
        for _ in range(int(self.rng.integers(1, 6))):
            by = self.item(OTHER, self.usual("comments", 1, 4), self.one(["span", "div", "h4", "cite", "p"])) if self.chance(0.6) else ""
            own += (f'<{tag} class="comment">' if self.chance(0.6) else f"<{tag}>") + by + self.item(OTHER, self.words(4, 60)) + f"</{tag}>"
        head = self.item(OTHER, self.usual("comments", 1, 3), self.one(["h2", "h3", "h4"])) if self.chance(0.6) else ""
        hints, self.hints = self.hints, 2  # without any name, comments cannot be told from the article
        out = self.named(self.one(["div", "section", "aside", "ul" if tag == "li" else "div"]), "comments", head + own)
        self.hints = hints
        return out

    def share(self) -> str:
        return self.named(self.one(["div", "p", "ul", "section"]), "share", OTHER + self.usual("share", 1, 6))

    def paragraph(self) -> str:
        text = self.words(1, 220)
        if self.chance(0.3):
            words = text.split(" ")
            k = int(self.rng.integers(len(words)))
            tag = self.one(["b", "i", "em", "strong", 'a href="/x"', "span", "code"])
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
            text = " ".join(words)
        if self.chance(0.15):
            return f"<p><b>{MAIN}{text}<br>"
        return self.item(MAIN, text)

    def article(self) -> str:
        own = []
        if self.chance(0.75):
            own.append(self.item(MAIN, self.words(2, 14), self.one(["h1", "h1", "h2"])))
        for _ in range(int(np.exp(self.rng.uniform(0, np.log(16))))):
            kind = self.rng.random()
            if kind < 0.78:
                own.append(self.paragraph())
            elif kind < 0.85:
                own.append(self.item(MAIN, self.words(1, 8), self.one(["h2", "h3", "h4"])))
            elif kind < 0.91:
                rows = "".join(f"<li>{MAIN}{self.words(1, 25)}</li>" for _ in range(int(self.rng.integers(2, 6))))
                own.append(self.one(["<ul>{}</ul>", "<ol>{}</ol>"]).format(rows))
            elif kind < 0.95:
                own.append(self.one([f"<blockquote>{self.item(MAIN, self.words(5, 60))}</blockquote>",
                                     f"<pre>{MAIN}{self.words(3, 40)}</pre>",
                                     f"<figure><img src=x><figcaption>{MAIN}{self.words(3, 15)}</figcaption></figure>"]))
            else:
                rows = "".join(f"<tr><td>{MAIN}{self.words(1, 3)}</td><td>{MAIN}{self.words(1, 6)}</td></tr>" for _ in range(3))
                own.append(f"<table>{rows}</table>")
        for part, p in ((self.ad, 0.15), (self.share, 0.12), (self.side, 0.08), (self.notice, 0.06), (self.form, 0.05)):
            if self.chance(p):
                own.insert(int(self.rng.integers(len(own) + 1)), part())
        inner = "".join(own)
        if self.chance(0.1):
            inner += self.comments()
        kind = self.rng.random()
        if kind < 0.5:
            return f"<article>{inner}</article>" if self.chance(0.7) else f"<main><article>{inner}</article></main>"
        if kind < 0.65:
            return f"<main>{inner}</main>"
        return self.named(self.one(["div", "section", "div"]), "main", inner)

    def page(self) -> str:
        self.hints = int(self.rng.choice([0, 1, 2, 2, 2, 2, 2]))
        before = [f() for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.nav, 0.8), (self.ad, 0.4), (self.side, 0.2),
                                   (self.form, 0.15), (self.share, 0.1)) if self.chance(p)]
        after = [f() for f, p in ((self.share, 0.15), (self.comments, 0.3), (self.side, 0.35), (self.ad, 0.25), (self.form, 0.2),
                                  (self.notice, 0.15), (self.footer, 0.85)) if self.chance(p)]
        if self.chance(0.5):
            self.rng.shuffle(before)
        body = "".join([*before, self.article(), *after])
        if self.chance(0.25):
            body = f'<div class="{self.one(["wrapper", "container", "page", "layout"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"
