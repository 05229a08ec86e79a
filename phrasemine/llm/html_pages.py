"""Labelled pages: a bounded, seeded set of pages of many layouts whose blocks are known to be article text or not.

The crawl has no labels, so the model learns from pages written here.  Words are drawn from syllables, so that
layout, not vocabulary, carries the label; boilerplate holds stock phrases where real pages do.  Layouts: elements and class names that
tell what a part is; divisions without telling names; bodies without any structure; layout tables.
"""

from __future__ import annotations

import random

_SYLLABLES = "an er the on re in al ti es or st en at ou ble ing tion de la que men ver ung sch ado ció ras pé lo mi".split()
#: Stock phrases of boilerplate.
STOCK = {
    "menu": ["Home", "About", "Contact", "News", "Sports", "Login", "Search", "Skip to content", "Archive"],
    "foot": ["© 2023 All rights reserved.", "Copyright {w}", "Privacy policy", "Terms of use", "&copy; {d} &middot; {s}", "Imprint", "Back to top"],
    "notice": ["We use cookies to improve your experience. Accept", "This site uses cookies.", "Your subscription has ended: {s}", "Please enable JavaScript to view this page.", "{s}", "Notice: {s}"],
    "advert": ["Advertisement", "Sponsored: {s}", "{s}", "Buy now: {s}", "{s} 50% off", "Promoted: {s}"],
    "side": ["Related stories", "Most read", "{s}", "Recommended for you", "Popular posts", "{t}"],
    "form": ["Subscribe to our newsletter", "Your email", "Sign up", "Send", "Leave a reply", "Name", "{s}"],
    "share": ["Share on Facebook", "Tweet", "Share this", "Follow us"],
    "comment": ["{s}", "{p}", "{p}", "{w} says: {s}", "{w} 3 hours ago", "Reply", "12 comments", "Great article! {s}", "I disagree. {p}"],
    "header": ["{t}", "{w} {w}", "The daily {w}", "{s}"],
}
NAMES = {
    "menu": ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "top-nav", "pagination"],
    "foot": ["footer", "site-footer", "page-foot", "copyright", "legal"],
    "notice": ["notice", "cookie-banner", "alert", "consent", "popup", "gdpr", "announcement", "paywall"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner"],
    "side": ["sidebar", "related", "widget", "rail", "recommended", "popular", "side"],
    "form": ["form", "newsletter", "subscribe", "search-form", "login", "signup", "contact-form"],
    "share": ["share", "social", "share-buttons", "follow"],
    "comment": ["comments", "comment", "comment-list", "responses", "discussion", "replies", "reader-comments"],
    "header": ["header", "site-header", "masthead", "top-bar", "branding", "logo"],
}
TAGS = {
    "menu": ["nav", "nav", "div", "ul"], "foot": ["footer", "footer", "div"], "notice": ["div", "section", "aside", "p", "dialog"], "advert": ["div", "aside", "section", "ins"],
    "side": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"], "share": ["div", "ul"], "comment": ["section", "div", "div", "ol", "article"], "header": ["header", "header", "div"],
}
BODY = ["content", "article-body", "post", "entry-content", "story", "main", "post-content", "text", "article"]


#: Layouts and how often each is written; how often a part of such a page has a telling class or id, and a telling element.
LAYOUTS = {"semantic": (40, 0.75, 1.0), "named": (16, 1.0, 0.0), "soup": (22, 0.1, 0.0), "plain": (12, 0.05, 0.0), "table": (10, 0.15, 0.0)}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.truth: list[tuple[str, int]] = []
        self.layout = self.r.choices(list(LAYOUTS), [w for w, *_ in LAYOUTS.values()])[0]
        _, self.named, self.telling = LAYOUTS[self.layout]
        self.bare = self.r.choice((0, 0, 0.1, 0.1, 0.9))  # paragraphs without a stop

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 3, b: int = 20) -> str:
        """Names, numbers, capitals and stock words stand in articles as well as around them."""
        r = self.r
        w = self.words(a, b).split()
        names, numbers, style = r.choice((0, 0.05, 0.3)), r.choice((0, 0, 0.04, 0.15)), r.random()
        w = [x.capitalize() if r.random() < names else f"{r.randint(0, 99999)}" if r.random() < numbers else x for x in w]
        if style < 0.04:
            w = [x.upper() + r.choice(("", "!!")) for x in w]
        elif style < 0.1:
            w.insert(r.randint(0, len(w)), r.choice(("v2.0", "a@b.example.com", "CC-BY", "10%", "(c)", "cookies", "search", "login", "comment", "https://x.example/y", "=", "share", "menu", "#1")))
        text = " ".join(x + ("," if r.random() < 0.1 and i < len(w) - 1 else "") for i, x in enumerate(w))
        return (text if style > 0.9 else text[:1].upper() + text[1:]) + r.choice(("." if style < 0.95 else "") + "...!?")

    def paragraph(self) -> str:
        text = " ".join(self.sentence(1, 20) for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))
        return text if self.r.random() > self.bare else text.rstrip(".!?") + self.r.choice(("", "", ",", "###", " |", "&"))

    def fill(self, s: str) -> str:
        s = s.replace("{s}", self.sentence(2, 14)).replace("{p}", self.paragraph()).replace("{t}", self.words(2, 7).capitalize()).replace("{d}", self.word() + ".example.com")
        while "{w}" in s:
            s = s.replace("{w}", self.word().capitalize(), 1)
        return s

    def mark(self, text: str, label: int) -> str:
        """Text of one block, with a marker word that tells its label."""
        return f"{'@Y' if label else '@N'}{len(self.truth)}@ {text}" if not self.truth.append((text, label)) else ""

    def attributes(self, kind: str, sure: bool = False) -> str:
        if not sure and self.r.random() < 0.25:
            return ""
        if self.r.random() > self.named and not (sure and self.layout == "semantic"):
            return self.r.choice(("", f' class="{self.word()}"', f" class={self.word()}{self.r.randint(1, 99)}", f' id="{self.word()}" style="margin:0"', f" data-k='{self.word()}>'"))
        name = self.r.choice(NAMES[kind])
        return f' {self.r.choice(("class", "class", "id"))}="{name}"' if self.r.random() < 0.8 else f' class="{self.word()} {name}"'

    def boilerplate(self, kind: str) -> str:
        r, tag = self.r, self.r.choice(TAGS[kind]) if self.telling else self.r.choice(("div", "div", "div", "ul" if kind in ("menu", "side", "share") else "section"))
        wrap = f"<{tag}{self.attributes(kind, sure=tag in ('div', 'ul', 'p', 'section', 'ol', 'ins', 'article'))}>"
        n = {"menu": r.randint(3, 8), "comment": r.randint(1, 8), "side": r.randint(2, 7), "form": r.randint(1, 5)}.get(kind, r.randint(1, 3))
        out = []
        if kind == "comment" and r.random() < 0.5:
            out.append(f"<{(h := r.choice(('h2', 'h3', 'h4', 'div', 'p')))}>{self.mark(r.choice(('Comments', f'{n} comments', f'Comments ({n})', f'{n} responses', 'What readers say', 'Discussion')), 0)}</{h}>")
        if kind in ("menu", "side") and tag != "ul" and r.random() < 0.3:  # links in a row, all in one block
            gap = r.choice((" | ", " &middot; ", " ", "<br>", "<br>\n", " - "))
            row = [f'<a href="/{self.word()}">{self.words(1, 3).capitalize()}</a>' for _ in range(n - 1)]
            out.append(gap.join([f'<a href="/">{self.mark(r.choice(STOCK["menu"]), 0)}</a>', *row]))
            n = 0
        for _ in range(n):
            if kind == "menu":
                t = self.mark(r.choice(STOCK["menu"]) if r.random() < 0.5 else self.word(), 0)
                out.append(f'<li><a href="/{self.word()}">{t}</a></li>' if tag != "div" or r.random() < 0.5 else f'<div><a href="#">{t}</a></div>')
                continue
            t = self.mark(self.fill(r.choice(STOCK[kind])), 0)
            if kind == "comment":
                inner = r.choice(("p", "div", "li", "blockquote"))
                out.append(f'<div class="{r.choice(("comment", "reply", self.word()))}"><{inner}>{t}</{inner}></div>' if r.random() < 0.6 else f"<{inner}>{t}</{inner}>")
            elif kind == "side":
                out.append(r.choice((f"<li><a href='/x'>{t}</a></li>", f"<h3>{t}</h3>", f"<p>{t}</p>")))
            elif kind == "form":
                out.append(r.choice((f"<label>{t}</label><input name=q>", f"<button>{t}</button>", f"<p>{t}</p>")))
            elif kind == "header":
                out.append(r.choice((f"<h1>{t}</h1>", f"<div>{t}</div>", f'<a href="/">{t}</a>', f"<p>{t}</p>")))
            else:
                out.append(t if n == 1 else r.choice((f"<p>{t}</p>", f"<div>{t}</div>", f"<a href='#'>{t}</a><br>" if r.random() < 0.3 else f"<p>{t}</p>")))
        end = "" if r.random() < 0.03 else f"</{tag}>"
        return wrap + "".join(out) + end

    def article(self) -> str:
        r = self.r
        kind = r.choice(("article", "article", "article", "main", "div", "section", "div")) if self.telling else "div"
        attrs = f' class="{r.choice(BODY)}"' if (kind in ("div", "section") or r.random() < 0.4) and r.random() < self.named else ""
        if not attrs and r.random() < 0.6:
            attrs = r.choice((f' class="{self.word()}"', f" id={self.word()}", f" lang=en title=it's"))
        title = self.words(2, 12).capitalize() + r.choice(("", "."))
        h = r.choice(("h1", "h1", "h1", "h2"))
        head = f"<{h}>{self.mark(title, 1)}</{h}>"
        if r.random() < 0.2 and self.telling:
            head = f"<header>{head}</header>"
        parts = [head] if r.random() < 0.9 else []
        junk = [k for k in ("advert", "share", "notice", "side", "form") if r.random() < 0.12]
        count = r.choice((0, 1, 1, 2, 3, 5, 8, 12, 20)) if self.telling else r.choice((2, 3, 4, 5, 8, 12, 20))
        flow = r.choice(("p", "p", "p", "div", "bare")) if not self.telling else "p"
        for i in range(count):
            x = r.random()
            p = self.paragraph()
            if x < 0.08:
                parts.append(f"<h2>{self.mark(self.words(1, 6).capitalize(), 1)}</h2>")
            elif x < 0.14:
                parts.append("<ul>" + "".join(f"<li>{self.mark(self.sentence(1, 12), 1)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.18:
                parts.append(f"<blockquote>{self.mark(p, 1)}</blockquote>")
            elif x < 0.21:
                parts.append(f"<pre>{self.mark(self.words(2, 9), 1)}</pre>")
            elif x < 0.24:
                parts.append("<table>" + "".join(f"<tr><td>{self.mark(self.words(1, 2), 1)}</td><td>{self.mark(str(r.randint(1, 999)), 1)}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.27:
                parts.append(f"<figure><img src=x><figcaption>{self.mark(self.sentence(), 1)}</figcaption></figure>")
            elif x < 0.32:
                parts.append(f"<p><strong>{self.mark(self.sentence(), 1)}</strong><br>")
            elif x < 0.42:
                parts.append(f"<p>{self.mark(p, 1)} <a href='/y'>{self.word()}</a> {self.sentence()}</p>")
            elif x < 0.47 or flow == "div":
                parts.append(f"<div>{self.mark(p, 1)}</div>")
            elif flow == "bare" and parts and parts[-1].endswith(">"):
                parts.append(self.mark(p, 1))
            else:
                parts.append(f"<p>{self.mark(p, 1)}" + ("</p>" if r.random() < 0.9 else ""))
            if junk and r.random() < 0.3:
                parts.append(self.boilerplate(junk.pop()))
        if r.random() < 0.15:
            parts.append(self.boilerplate("comment"))
        inner = "".join(parts)
        if self.layout == "plain":
            return inner
        if r.random() < 0.2:
            inner = f"<div class='{r.choice(BODY) if r.random() < self.named else self.word()}'>{inner}</div>"
        return f"<{kind}{attrs}>{inner}</{kind}>"

    def page(self) -> str:
        r = self.r
        before = [k for k, p in (("notice", 0.25), ("header", 0.45), ("menu", 0.8), ("advert", 0.5), ("form", 0.15), ("share", 0.1), ("side", 0.15)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("comment", 0.45), ("side", 0.4), ("form", 0.3), ("advert", 0.3), ("notice", 0.15), ("menu", 0.15), ("foot", 0.85)) if r.random() < p]
        first, text, last = "".join(self.boilerplate(k) for k in before), self.article(), "".join(self.boilerplate(k) for k in after)
        if self.layout == "table":
            row = r.choice(("<br>", " | ", "\n")).join(f"<a href=/{self.word()}>{self.words(1, 3).capitalize()}</a>" for _ in range(r.randint(2, 11)))
            menu = r.choice((self.boilerplate("menu"), row.replace(">", f">{self.mark('', 0)}", 1)))
            side = f"<td width=120>{menu}</td>" if r.random() < 0.8 else ""
            rail = f"<td>{self.boilerplate('side')}</td>" if r.random() < 0.5 else ""
            if r.random() < 0.4:
                last = last * r.randint(0, 1) + self.mark(self.fill(r.choice(STOCK["foot"])), 0)
            body = f"<table><tr><td colspan=3>{first}</td></tr><tr>{side}<td valign=top>{text}</td>{rail}</tr><tr><td colspan=3>{last}</td></tr></table>"
        else:
            body = first + text + last
        if r.random() < 0.2:
            body = f"<div id='{r.choice(('page', 'wrapper', 'container'))}'>{body}</div>"
        top = r.choice(("<script>if (1 < 2) { x = '<p>'; }</script>", "<style>a>b{c:d}</style>", "<link rel=x href=y>", "<noscript><p>no</p></noscript>"))
        return f"<!doctype html><html><head><title>{self.words(1, 5)}</title>{top}</head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages in which each block starts with a marker, @Y<k>@ in the article and @N<k>@ elsewhere."""
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]
