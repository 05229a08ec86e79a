"""HTML pages as sequences of DOM leaf blocks with features."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from operator import itemgetter

#: Elements whose content is raw text that no page shows; whose content is markup that is not shown as text; that end a
#: block; that never have content.
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
DROPPED = frozenset("template object svg math canvas select datalist audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first name ends where one of the others starts, unless one of LIMITS stands between.
CLOSED_BY = {
    "p": BLOCKS - {"button", "label", "option"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
}
LIMITS = {
    "p": frozenset({"button", "td", "th", "table", "caption"}), "li": frozenset({"ul", "ol", "menu"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tr": frozenset({"table"}),
    "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "option": frozenset({"datalist"}),
}
FORMATTING = frozenset("a b big code em font i mark s small span strike strong sub sup tt u".split())
LANDMARKS = frozenset("article main nav header footer aside form dialog".split())

#: Words in class, id and role attributes that tell what a part of a page is.
HINTS = {
    "comment": r"comment|respon[ds]|discuss|disqus|repl(?:y|ies)|feedback|review|guestbook|reader",
    "side": r"side|aside|rail|widget|related|recommend|popular|trending|more-?(?:stories|from)|tag|archive|complementary",
    "advert": r"(?:^|[^a-z])ads?(?:[^a-z]|$)|advert|sponsor|promo|banner|dfp|outbrain|taboola|affiliate|commercial",
    "menu": r"nav|menu|crumb|pag(?:er|inat)|skip|toc|tabs|toolbar",
    "foot": r"foot|copyright|legal|colophon|contentinfo|imprint",
    "head": r"head|masthead|brand|logo|topbar|top-bar",
    "notice": r"notice|cookie|consent|gdpr|alert|popup|modal|overlay|paywall|privacy|warning|announce|toast|dialog",
    "share": r"share|social|follow|twitter|facebook",
    "form": r"form|subscri|newsletter|login|signin|signup|search|register|input|contact",
    "byline": r"byline|author|dateline|publish|posted|meta|timestamp",
    "content": r"article|content|post|entry|story|main|body|text|prose|blog",
}
_HINTS = [(k, re.compile(v)) for k, v in HINTS.items()]
#: Words in a block's text that boilerplate of several languages uses; looked for in the lower-case text between two spaces.
PHRASES = {
    "rights": ("©", "(c)", "copyright", "all rights", "alle rechte", "tous droits", "derechos reservados"),
    "cookie": ("cookie", " consent", "privacy policy", "gdpr", "datenschutz"),
    "subscribe": ("subscri", "newsletter", "sign up", "signup", "sign in", "login", "log in", " register", " abonn", "anmelden", "suscr"),
    "advert": ("advertis", "sponsored", " promot", "anzeige", "publicit", "buy now", "shop now", "% off", "discount"),
    "reply": (" reply", " comment", "posted by", " says:", "antworten", "répondre", "responder", "upvote", " likes "),
    "share": (" share ", "tweet", "facebook", "follow us", " teilen", "partager", "compartir"),
    "nav": (" home ", " menu ", " search ", "skip to", "read more", "next page", "previous page", "back to top"),
    "when": (" minutes ago", " hours ago", " hour ago", " days ago", " day ago", " weeks ago"),
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*)?)?")
_BARE = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"\s*")
_FIRST = itemgetter(0)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    features: list[str] = field(default_factory=list)


class _Open:
    """An element with what its blocks need to know of its ancestors, so that no block walks up to the root."""

    __slots__ = ("tag", "up", "depth", "hidden", "tags", "hints", "inner", "inner_hints", "article", "near", "chars")

    def __init__(self, tag: str, up: "_Open | None", hints: tuple[str, ...] = (), hidden: bool = False):
        self.tag, self.up, self.chars = tag, up, 0
        if up is None:
            self.depth, self.hidden, self.tags, self.hints, self.inner, self.inner_hints, self.article = 0, hidden, frozenset(), frozenset(hints), "", (), ""
            self.near: dict[str, int] = {}
            return
        self.depth = up.depth + 1
        self.hidden = hidden or up.hidden
        self.tags = up.tags if tag in up.tags or tag in ("html", "body", "div", "span") else up.tags | {tag}
        self.hints = up.hints.union(hints) if hints else up.hints
        marks = tag in LANDMARKS or hints
        self.inner, self.inner_hints = (tag if tag in LANDMARKS else "div", hints) if marks else (up.inner, up.inner_hints)
        self.article = up.article
        if tag == "article":
            self.article = "article>article" if "article" in up.tags else ""
        elif tag in ("header", "footer") and "article" in up.tags:
            self.article = f"article>{tag}"
        # the nearest open element that the start of another may end
        self.near = up.near
        if tag in CLOSED_BY or any(tag in limit for limit in LIMITS.values()):
            self.near = {k: d for k, d in up.near.items() if tag not in LIMITS[k]}
            if tag in CLOSED_BY:
                self.near[tag] = self.depth


class _Reader:
    """Cursor over a page.  What is once sought in vain is not sought again, so a page is read in linear time."""

    def __init__(self, page: str):
        self.page, self.low, self.missing = page, None, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.missing.add(what)
        return i

    def end_tag(self, tag: str, at: int) -> int:
        """Just after the end tag of an element whose content is skipped; -1 if there is none."""
        if self.low is None:
            low = self.page.lower()
            self.low = low if len(low) == len(self.page) else re.sub("[A-Z]", lambda m: m[0].lower(), self.page)
        key = f"</{tag}"
        while key not in self.missing:
            i = self.low.find(key, at)
            if i < 0:
                self.missing.add(key)
                break
            at = i + len(key)
            if at >= len(self.page) or self.page[at] in " \t\n\r\f/>":
                end = self.find(">", at)
                return len(self.page) if end < 0 else end + 1
        return -1

    def attributes(self, at: int) -> tuple[int, dict[str, str], bool]:
        """(just after the tag or -1 if it does not end, attributes, whether it ends with a slash)."""
        page, found = self.page, {}
        while True:
            m = _ATTR.match(page, at)
            at = m.end()
            if at >= len(page) and not m[1]:
                return -1, found, False
            if m[1] is None:
                return at + 1, found, page[at - 1] == "/"  # only ">" is left
            name, value = m[1].lower(), ""
            if m[0].rstrip().endswith("="):
                quote = page[at : at + 1]
                if quote and quote in "\"'":
                    end = self.find(quote, at + 1)
                    if end < 0:  # a quote that never closes ends with the tag
                        end = self.find(">", at)
                        if end < 0:
                            return -1, found, False
                        value, at = page[at + 1 : end], end
                    else:
                        value, at = page[at + 1 : end], end + 1
                else:
                    b = _BARE.match(page, at)
                    value, at = b[0], b.end()
            found.setdefault(name, value)


def _named(attributes: dict[str, str]) -> tuple[tuple[str, ...], bool]:
    """What class, id and role say of an element, and whether it is hidden."""
    joined = " ".join(attributes[k] for k in ("class", "id", "role") if k in attributes).lower()
    hidden = "hidden" in attributes or "style" in attributes and bool(_HIDDEN.search(attributes["style"].lower()))
    return (tuple(k for k, p in _HINTS if p.search(joined)) if joined else ()), hidden


def _bucket(n: float, steps: tuple[float, ...]) -> int:
    return sum(n >= s for s in steps)


def _ratio(n: float, of: float) -> int:
    return _bucket(n / of if of else 0.0, (0.01, 0.1, 0.3, 0.6, 0.9))


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page in order: white space folded, character references decoded.

    Reads tags, comments and attributes as browsers do: a quoted attribute may hold > and <, an unquoted one may hold quotes, script and
    style end only at their end tags, a tag that the page breaks off is dropped.  Elements that are not shown are left out.
    """
    page = page or ""
    reader = _Reader(page)
    stack = [_Open("html", None)]
    count: dict[str, int] = {}
    nodes: list[_Open] = []
    found: list[tuple[str, int, _Open, bool]] = []
    parts: list[str] = []
    linked, link, formatted = 0, 0, False

    def flush() -> None:
        nonlocal linked, formatted
        if parts:
            text = " ".join("".join(parts).split())
            if text and not stack[-1].hidden:
                found.append((text, min(linked, len(text)), stack[-1], formatted))
                stack[-1].chars += max(0, len(text) - linked)
            parts.clear()
        linked, formatted = 0, False

    def add(raw: str) -> None:
        nonlocal linked
        t = html.unescape(raw)
        parts.append(t)
        if link:
            linked += len(t.strip())

    def close(depth: int) -> None:
        """Close all elements at this depth and below it."""
        nonlocal link
        for o in stack[depth:]:
            count[o.tag] -= 1
        del stack[depth:]
        if link > len(stack):
            link = 0

    at = 0
    while at < len(page):
        start = reader.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        after = page[start + 1 : start + 2]
        closing = after == "/"
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            if page.startswith("<!--", start):
                end = reader.find("-->", start + 2)
                at = len(page) if end < 0 else end + 3
            elif after in ("!", "?") or closing and start + 2 < len(page):
                end = reader.find(">", start + 1)
                at = len(page) if end < 0 else end + 1
            else:
                parts.append("<")
                at = start + 1
            continue
        tag = name[0].lower()
        at, attributes, slash = reader.attributes(name.end())
        if at < 0:
            break
        if closing:
            if tag == "a":
                link = 0
            elif tag in BLOCKS:
                flush()
                if count.get(tag):
                    depth = len(stack) - 1
                    while stack[depth].tag != tag:
                        depth -= 1
                    close(depth)
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW or tag in DROPPED:
            if not (slash and tag in DROPPED):
                end = reader.end_tag(tag, at)
                at = end if end >= 0 else len(page) if tag in ("script", "style") else at
            continue
        if tag == "a":
            link = len(stack) if "href" in attributes else 0
        if tag in FORMATTING:
            formatted |= tag in ("b", "strong", "em", "i") and not "".join(parts).strip()
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        for closed, by in CLOSED_BY.items():
            if tag in by and closed in stack[-1].near:
                close(stack[-1].near[closed])
        if tag in VOID or tag in ("html", "body"):
            continue
        node = _Open(tag, stack[-1], *_named(attributes))
        nodes.append(node)
        count[tag] = count.get(tag, 0) + 1
        stack.append(node)
    flush()
    for node in reversed(nodes):  # plain characters inside each element, descendants included
        node.up.chars += node.chars
    return _with_features(found, nodes)


def _core(nodes: list[_Open]) -> set[int]:
    """The elements, by identity, on the way down from the root to where most of the page's plain text stands together."""
    best: dict[int, _Open] = {}
    for node in nodes:
        rival = best.get(id(node.up))
        if rival is None or node.chars > rival.chars:
            best[id(node.up)] = node
    out: set[int] = set()
    at = nodes[0].up if nodes else None
    while at is not None and at.up is not None:
        at = at.up
    while at is not None and (child := best.get(id(at))) is not None and child.chars >= 0.5 * at.chars and child.tag not in ("p", "li", "td", "pre", "tr"):
        out.add(id(child))
        at = child
    return {id(at)} if out else set()


def _with_features(found: list[tuple[str, int, _Open, bool]], nodes: list[_Open]) -> list[Block]:
    first_h1 = next((i for i, (*_, o, _) in enumerate(found) if "h1" in o.tags), None)
    has_article = any("article" in o.tags or "main" in o.tags for *_, o, _ in found)
    total = sum(max(0, len(t) - k) for t, k, *_ in found)
    core, inside = _core(nodes), {}

    def in_core(o: _Open) -> bool:
        path = []
        while o is not None and id(o) not in inside:
            path.append(o)
            if id(o) in core:
                break
            o = o.up
        value = bool(o is not None and (id(o) in core or inside.get(id(o))))
        for x in path:
            inside[id(x)] = value
        return value

    size = [_bucket(len(t.split()), (2, 4, 8, 15, 30, 60)) for t, *_ in found]
    out = []
    for i, (text, linked, o, formatted) in enumerate(found):
        up = o.up or o
        f = ["bias", f"leaf={o.tag}", f"parent={up.tag if o.up else '-'}"]
        f += [f"in={t}" for t in sorted(o.tags)]
        f += [f"hint={h}" for h in sorted(o.hints)]
        if o.inner:
            f.append(f"inner={o.inner}")
            f += [f"inner_hint={h}" for h in o.inner_hints]
        if o.article:
            f.append(o.article)
        words, low = text.split(), text.lower()
        near = f" {low} "
        f.append(f"words={size[i]}")
        f.append(f"before={size[i - 1] if i else '-'}")
        f.append(f"next={size[i + 1] if i + 1 < len(found) else '-'}")
        links = _ratio(linked, len(text))
        f.append(f"links={links}")
        f.append(f"words={size[i]}&links={links}")
        ends = "." if text[-1] in ".!?…。\"”'" else ":" if text[-1] in ":;," else "-"
        f.append(f"end={ends}")
        f.append(f"words={size[i]}&end={ends}")
        f.append(f"commas={_bucket(text.count(','), (1, 3))}")
        f.append(f"upper={_ratio(sum(map(str.isupper, map(_FIRST, words))), len(words))}")
        f.append(f"digits={_ratio(sum(map(text.count, '0123456789')), len(text))}")
        # a stock phrase says little in a long paragraph
        said = [k for k, phrases in PHRASES.items() if any(map(near.__contains__, phrases))]
        f += [f"says={k}&words={min(size[i] // 2, 2)}" for k in said] + [f"says={k}" for k in said if size[i] < 4]
        if formatted:
            f.append("bold")
        f.append("h1=" + ("none" if first_h1 is None else "before" if i < first_h1 else "at" if i == first_h1 else "after"))
        f.append(f"page_has_article={has_article}&inside={'article' in o.tags or 'main' in o.tags}")
        if not has_article:
            f.append(f"core={in_core(o) if core else '-'}")
            f.append(f"share={_bucket(up.chars / total if total else 0, (0.02, 0.1, 0.3, 0.6, 0.9))}")
            f.append(f"place={_bucket(i / len(found), (0.1, 0.3, 0.7, 0.9))}")
        if i == 0:
            f.append("first")
        if i == len(found) - 1:
            f.append("last")
        out.append(Block(text, f))
    return out
