"""Generated web pages whose article is known; the extractor is fitted on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SYLLABLES = "ba den ir lo mé nä os pu re sol ti und vé wa ción ing er ou ñe zu".split()
# Names that page templates commonly give to their parts.
_ARTICLE = ["<article>", "<article>", "<article>", '<article class="post">', "<main>", '<main id="main"><article>', '<div class="content">', '<div id="article-body">', '<div class="entry-content">', '<div class="story">', '<section class="post-body">', '<div class="main-text">', "<div>", "<td>"]
_MENUS = ["<nav>", '<nav class="menu">', '<div class="nav">', '<div id="navigation">', '<ul class="menu">', '<div class="breadcrumb">', '<header><nav>', '<div class="pagination">']
_SIDES = ["<aside>", '<div class="sidebar">', '<div id="related">', '<section class="related-posts">', '<aside class="widget">', '<div class="share">', '<div class="tags">', '<div class="author-bio">']
_ADS = ['<div class="ad">', '<div class="advert">', '<div id="banner-ad">', '<div class="sponsored">', '<div class="promo">', '<aside class="ads">', '<div class="ad-slot">']
_NOTICES = ['<div class="cookie-notice">', '<div id="cookie-banner">', '<div class="notice">', '<div role="dialog" class="consent">', '<div class="newsletter">', '<div class="alert">', '<div class="paywall">']
_COMMENTS = ['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="discussion">', '<div id="disqus-thread">', '<section class="responses">']
_FOOTERS = ["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">']
_HEADERS = ["<header>", '<div class="header">', '<div id="masthead">', '<header class="site-header">', '<div class="topbar">']


class _Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.parts: list[str] = []

    def pick(self, some):
        return some[int(self.rng.integers(len(some)))]

    def word(self) -> str:
        return "".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high))))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.pick([".", ".", ".", "!", "?"])

    def prose(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(1, most))))

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    @staticmethod
    def close(opening: str) -> str:
        return "".join(f"</{part.split()[0].rstrip('>')}>" for part in reversed(opening.split("<")[1:]))

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(int(self.rng.integers(2, 9)))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.chance(0.6) else self.pick([" | ", " ", " &middot; "]).join(items)

    def own(self, text: str) -> str:
        """A block of the article, with some inline markup, character references and line breaks."""
        w = text.split(" ")
        if self.chance(0.12):
            w[int(self.rng.integers(len(w)))] = self.pick(["&", "<b>", "a<b", "©", "\"x\"", "–"])
        self.parts.append(" ".join(w))
        w = [x.replace("&", "&amp;").replace("<", "&lt;").replace(">", self.pick(["&gt;", ">"])).replace("©", "&copy;").replace('"', "&quot;").replace("–", "&#8211;") for x in w]
        if len(w) > 1 and self.chance(0.4):
            i = int(self.rng.integers(len(w) - 1))
            w[i] = self.pick(["<b>{}</b>", "<em>{}</em>", '<a href="#">{}</a>', "<span class='x'>{}</span>", "<b>{}"]).format(w[i])
        out = " ".join(w)
        return out.replace(" ", self.pick(["<br>", " &nbsp; ", "\n  "]), 1) if self.chance(0.15) else out

    def short(self) -> str:
        """An article of a few words or one sentence, with or without elements of its own."""
        said = lambda: self.own(self.pick([self.words(1, 8), self.sentence(1, 8), self.sentence(), self.prose(3)]))
        kind = self.rng.random()
        if kind < 0.3:
            return said()
        head = f"<{h}>{said()}</{h}>" if (h := self.pick(["h1", "h2", ""])) else ""
        return head + "".join(f"<p>{said()}" + self.pick(["</p>", "</p>", "<br>", ""]) for _ in range(int(self.rng.integers(1, 3))))

    def article(self) -> str:
        out = []
        if self.chance(0.8):
            out.append(f"<h1>{self.own(self.words(3, 12).capitalize())}</h1>")
        for _ in range(int(self.rng.integers(1, 11))):
            kind = self.rng.random()
            if kind < 0.72:
                out.append(f"<p>{self.own(self.prose())}" + self.pick(["</p>", "</p>", "</p>", "<br>", ""]))
            elif kind < 0.8:
                out.append(f"<h2>{self.own(self.words(2, 7).capitalize())}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.own(self.sentence())}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{self.own(self.prose(3))}</p></blockquote>")
            elif kind < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{self.own(self.words(2, 6))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(self.ad())
        return "".join(out)

    def ad(self) -> str:
        o = self.pick(_ADS)
        return f"<!-- ad -->{o}{self.pick([self.prose(3), self.sentence(), f'<a href=#>{self.words(2, 8)}</a>'])}{self.close(o)}"

    def part(self, openings: list[str], body: str) -> str:
        o = self.pick(openings)
        return o + body + self.close(o)

    def comments(self) -> str:
        one = lambda: self.pick(["<div class='comment'><p>{}</p></div>", "<li class='comment'><b>{}</b><p>{}</p></li>", "<div class='reply'>{}</div>"])
        return self.part(_COMMENTS, f"<h3>{self.words(1, 3)}</h3>" + "".join(one().replace("{}", self.prose(4)) for _ in range(int(self.rng.integers(1, 6)))))

    def form(self) -> str:
        return f"<form action='/'><label>{self.words(1, 4)}</label><input><select><option>{self.word()}<option>{self.word()}</select><p>{self.sentence()}</p><button>{self.word()}</button></form>"

    def around(self) -> tuple[list[str], list[str]]:
        """What stands before and behind the article."""
        top, after = [], []
        if self.chance(0.5):
            top.append(self.part(_HEADERS, self.pick([self.words(1, 5), f"<h1>{self.words(1, 4)}</h1><p>{self.sentence()}</p>", self.links()])))
        if self.chance(0.8):
            top.append(self.part(_MENUS, self.links()))
        if self.chance(0.4):
            top.append(self.part(_NOTICES, self.pick([f"<p>{self.prose(3)}</p><button>{self.word()}</button>", self.sentence()])))
        if self.chance(0.1):
            top.append(self.part(["<noscript>"], self.pick([self.sentence(), f"<p>{self.sentence()}</p>"])))
        for _ in range(int(self.rng.integers(0, 3))):
            (top if self.chance(0.6) else after).append(self.ad())
        if self.chance(0.4):
            (top if self.chance(0.3) else after).append(self.part(_SIDES, self.pick([self.links(), f"<h3>{self.words(1, 3)}</h3>" + self.links(), f"<p>{self.sentence()}</p>"])))
        if self.chance(0.4):
            after.append(self.comments())
        if self.chance(0.3):
            (top if self.chance(0.3) else after).append(self.form())
        if self.chance(0.85):
            after.append(self.part(_FOOTERS, self.pick([f"&copy; {self.word()} &middot; {self.prose(3)}", self.links(), f"<p>{self.sentence()}</p>" + self.links()])))
        return top, after

    def page(self) -> str:
        kind = self.rng.random()
        if kind < 0.1:  # nothing but text
            return self.own(self.prose(6)) if self.chance(0.5) else self.short()
        top, after = ([], []) if kind < 0.2 else self.around()
        if kind > 0.98:  # no article
            return f"<html><body>{''.join(top + after)}</body></html>"
        text = self.short() if self.chance(0.3) else self.article()
        if kind < 0.35:  # no element of the article's own
            main = text
            if not text.startswith("<"):
                main = self.pick(["<p>", "<div>"]) + text
        else:
            o = self.pick(_ARTICLE)
            main = o + text + self.close(o)
            if o == "<td>":
                main = f"<table><tr>{main}</tr></table>"
        body = "".join(top) + main + "".join(after)
        if self.chance(0.3):
            body = f'<div class="wrapper">{body}</div>'
        if kind < 0.2 and self.chance(0.5):
            return body
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var t='</p>';</script></head><body>{body}" + ("</body></html>" if self.chance(0.8) else "")


def training_pages(count: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """Pages and the texts of their articles' blocks."""
    rng = np.random.default_rng(seed)
    for _ in range(count):
        maker = _Maker(rng)
        page = maker.page()
        yield page, set(maker.parts)
