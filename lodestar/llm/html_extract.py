"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes, in time that grows with its length alone, the sequence of its leaf
blocks: stretches of text between block-level tags, each with its open ancestors. Features of the ancestors'
tags, class and id words and of the text's shape score each block; a chain of
two states (drop, keep) with learned transitions is decoded by Viterbi. The
weights are learned from labelled pages by gradient ascent on the conditional
likelihood; without others, the pages of :func:`labelled_pages` are used.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map

# HTML element classes by name.
INLINE = frozenset(
    (
        "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
        "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics"
    ).split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())  # text up to the closing tag, or the page's end
SKIPPED = frozenset("template svg select".split())  # elements that hold no text of a page
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div article section main body aside nav footer header form blockquote".split())
SECTIONS = frozenset("nav header footer aside form article main section figure dialog head button fieldset menu address details".split())
# Words of class and id names, by what they tell.
BOILERPLATE_WORDS = (
    "ad ads advert advertisement adbox banner sponsor sponsored promo promoted promotion menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar header masthead logo "
    "footer copyright legal bottom colophon sidebar aside widget rail related popular trending recommended recommendations more notice notices cookie cookies consent gdpr alert "
    "warning popup modal overlay newsletter subscribe subscription form search login signup register share sharing social comment comments commentlist reply replies respond "
    "discussion disqus feedback pagination pager tags skip disclaimer paywall hidden"
).split()
CONTENT_WORDS = "article content post entry story main body text maintext articlebody storybody page blog news".split()
_BOILERPLATE = frozenset(BOILERPLATE_WORDS)
_KNOWN = _BOILERPLATE | frozenset(CONTENT_WORDS)

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag whose quoted values hold no angle brackets; all others go to :meth:`Scanner.tag_end`.
_PLAIN_REST = re.compile(r"""[^<>"']*+(?:(?:"[^"<>]*+"|'[^'<>]*+')[^<>"']*+)*+>""")
_QUOTE_OR_END = re.compile(r"""[>"']""")
#: Elements open at once; those that would be deeper stand beside each other, as in browsers.
DEEPEST = 512
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: Weights are kept by hashed feature.
DIMS = 1 << 12


class Node:
    """An open element: its tag, its parent, and what the features of its blocks take from its ancestors."""

    __slots__ = ("near", "section", "slots", "tag", "up", "within")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.up, self.slots = tag, parent, None
        known = [w for w in _words(attrs) if w in _KNOWN] if attrs and tag not in ("html", "body") else []
        bad = any(w in _BOILERPLATE for w in known)
        new = {f"in:{tag}", *(f"word:{w}" for w in known), *(("under-boilerplate",) if bad else ())}
        within = parent.within if parent else frozenset()
        self.within = within if new <= within else within | new
        self.section = tag if tag in SECTIONS else parent.section if parent else "none"
        self.near = (*(f"near:{w}" for w in known), "near-boilerplate" if bad else "near-content") if known else parent.near if parent else ()

    def features(self) -> tuple[int, ...]:
        """Slots of the features of the path down to this element."""
        if self.slots is None:
            own = {*self.within, *self.near, f"section:{self.section}", f"up0:{self.tag}", *((f"up1:{self.up.tag}",) if self.up else ())}
            self.slots = tuple(sorted({_slot(f) for f in own}))
        return self.slots


class Block:
    """A leaf block: its text, the element that it stands in (None outside of all), and how many of its characters are links."""

    __slots__ = ("link", "node", "text")

    def __init__(self, text: str, node: Node | None, link: int):
        self.text, self.node, self.link = text, node, link


def _words(attrs: str) -> tuple[str, ...]:
    """The words of the names that an element has, in class, id and role."""
    return _cached_words(attrs) if len(attrs) < 500 else _cached_words.__wrapped__(attrs)


@lru_cache(maxsize=4096)
def _cached_words(attrs: str) -> tuple[str, ...]:
    names = " ".join(x for m in _NAMED.finditer(attrs) for x in m.groups() if x)
    return tuple(w.lower() for w in _WORD.findall(names))


class Scanner:
    """Ends of tags in a page, each found in time that adds up to the page's length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()  # places outside of quotes from which no tag ends
        self.closing: dict[int, int] = {}  # of an opening quote
        self.gap = (0, -1)  # a stretch, and the quote or end that follows it
        self.unclosed: set[str] = set()

    def next_mark(self, at: int) -> int:
        """The next quote or tag end, -1 if there is none."""
        low, high = self.gap
        if not low <= at <= high:
            if at > max(self.last.values()):
                return -1
            self.gap = (at, _QUOTE_OR_END.search(self.page, at).start())
        return self.gap[1]

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose attributes begin here, past its ``>``; -1 if never.

        A ``>`` in quotes does not end it, but where quotes are left open the next one does.
        """
        page = self.page
        if m := _PLAIN_REST.match(page, at):
            return m.end()
        seen, k = [], at
        while k not in self.dead:
            seen.append(k)
            mark = self.next_mark(k)
            if mark < 0:
                break
            c = page[mark]
            if c == ">":
                return mark + 1
            if mark >= self.last[c]:
                break
            if mark not in self.closing:
                self.closing[mark] = page.find(c, mark + 1)
            k = self.closing[mark] + 1
        self.dead.update(seen)
        return page.find(">", at) + 1 if at <= self.last[">"] else -1

    def close(self, name: str, at: int) -> int:
        """Where the next closing tag of this name ends; -1 if there is none."""
        if name in self.unclosed:
            return -1
        m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.page, at)
        if m is None or m.end() > self.last[">"]:
            self.unclosed.add(name)
            return -1
        return self.page.find(">", m.end()) + 1


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order; white space within a block is one space, empty blocks are left out."""
    out: list[Block] = []
    stack: list[Node] = []
    count: dict[str, int] = {}  # of open elements by tag
    parts: list[str] = []
    link, links, began = 0, 0, None
    scan = Scanner(page)

    def text(piece: str) -> None:
        nonlocal began, link
        if not parts:
            began = stack[-1] if stack else None
        parts.append(piece)
        if links:
            link += len(piece)

    def end() -> None:
        nonlocal link
        if parts:
            whole = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if whole:
                out.append(Block(whole, began, link))
            parts.clear()
        link = 0

    def leave(k: int) -> None:
        """Close the elements from the k-th on."""
        for node in stack[k:]:
            count[node.tag] -= 1
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        if begin > at:
            text(page[at:begin])
        m = _NAME.match(page, begin + 1) if begin < scan.last[">"] else None
        if not m:
            if page.startswith("<!--", begin):
                close = page.find("-->", begin + 4)
                at = close + 3 if close >= 0 else size
            elif page.startswith(("<!", "<?", "</"), begin) and begin < scan.last[">"]:
                at = page.find(">", begin) + 1
            else:
                text("<")
                at = begin + 1
            continue
        stop = scan.tag_end(m.end())
        if stop < 0:
            text("<")
            at = begin + 1
            continue
        at = stop
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                if name == "a" and links:
                    links -= 1
                continue
            end()
            if count.get(name):
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                leave(k)
            continue
        if name in INLINE:
            if name == "br":
                if parts:
                    parts.append(" ")
            elif name == "a":
                links = 1
            continue
        attrs = page[m.end() : stop - 1]
        if name in RAW or name in SKIPPED:
            end()
            close = -1 if attrs.endswith("/") and name in SKIPPED else scan.close(name, at)
            at = close if close >= 0 else size if name in RAW else at
            continue
        end()
        links = 0
        if stack and any(n.tag == "p" for n in stack[-2:]):
            while stack and stack[-1].tag == "p":
                leave(len(stack) - 1)
        if name in CLOSES and any(count.get(t) for t in CLOSES[name]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in CLOSES[name]:
                    leave(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if name in VOID:
            continue
        if len(stack) >= DEEPEST:
            leave(DEEPEST - 1)
        stack.append(Node(name, attrs, stack[-1] if stack else None))
        count[name] = count.get(name, 0) + 1
    end()
    return out


@lru_cache(maxsize=1 << 16)
def _slot(feature: str) -> int:
    h = 2166136261
    for c in feature.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % DIMS


_OUTSIDE = ("section:none",)


def features(blocks: list[Block]) -> list[tuple[int, ...]]:
    """Slots of the features of each block."""
    rows, n = [], len(blocks)
    for k, b in enumerate(blocks):
        size, t = len(b.text), b.text
        share = min(4, 5 * b.link // max(1, size))
        shape = (f"size:{min(10, size.bit_length())}", f"link:{share}", f"end:{t[-1] in '.!?…:;'}", f"commas:{min(3, t.count(', '))}", f"first:{t[0] in '©|»›•'}", f"place:{5 * k // n}", "any")
        rows.append((*(b.node.features() if b.node else map(_slot, _OUTSIDE)), *map(_slot, shape)))
    return rows


class Crf:
    """Weights of both states' difference by feature, and the 2 x 2 transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def scores(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        w = self.weights
        return np.array([w[list(r)].sum() for r in rows])

    def decode(self, rows: list[tuple[int, ...]]) -> list[bool]:
        """The likeliest states by Viterbi; ties are dropped."""
        if not rows:
            return []
        (a, b), (c, d) = self.moves.tolist()
        drop, keep, back = 0.0, 0.0, []
        for k, e in enumerate(self.scores(rows).tolist()):
            if k:
                from_drop, from_keep = drop + b < keep + d, drop + a < keep + c
                back.append((from_keep, from_drop))
                drop, keep = max(drop + a, keep + c), max(drop + b, keep + d)
            keep += e
        state = keep > drop
        out = [state]
        for came_keep, came_drop in reversed(back):
            state = came_drop if state else came_keep
            out.append(state)
        return out[::-1]

    def extract(self, page: str) -> str:
        blocks = blocks_of(page)
        return "\n".join(b.text for b, kept in zip(blocks, self.decode(features(blocks)), strict=True) if kept)


def train(pages: Iterable[tuple[list[Block], list[bool]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Weights that maximise the conditional likelihood of the labels, with an L2 penalty, by Adam over all pages at once."""
    data = [(features(b), np.array(y, dtype=np.int64)) for b, y in pages if b]
    longest, n = max(len(y) for _, y in data), len(data)
    slots = np.concatenate([np.array(r) for rows, _ in data for r in rows])
    sizes = np.array([len(r) for rows, _ in data for r in rows])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    page = np.repeat(np.arange(n), [len(y) for _, y in data])
    place = np.concatenate([np.arange(len(y)) for _, y in data])
    gold = np.concatenate([y for _, y in data])
    mask = np.zeros((n, longest), dtype=bool)
    mask[page, place] = True
    grid = np.zeros((n, longest), dtype=np.int64)
    grid[page, place] = gold
    theta, m1, m2 = np.zeros(DIMS + 4), np.zeros(DIMS + 4), np.zeros(DIMS + 4)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (grid[:, :-1][mask[:, 1:]], grid[:, 1:][mask[:, 1:]]), 1)
    for step in range(1, rounds + 1):
        moves = theta[DIMS:].reshape(2, 2)
        e = np.zeros((n, longest, 2))
        e[page, place, 1] = np.bincount(owner, theta[slots], minlength=len(sizes))
        fore = np.zeros((n, longest, 2))
        fore[:, 0] = e[:, 0]
        for k in range(1, longest):
            fore[:, k] = np.logaddexp.reduce(fore[:, k - 1, :, None] + moves, axis=1) + e[:, k]
        back = np.zeros((n, longest, 2))
        for k in range(longest - 2, -1, -1):
            inner = np.logaddexp.reduce(moves + (e[:, k + 1] + back[:, k + 1])[:, None, :], axis=2)
            back[:, k] = np.where(mask[:, k + 1, None], inner, 0)
        total = np.logaddexp.reduce(fore + back, axis=2)
        keep = np.exp(fore[..., 1] + back[..., 1] - total)
        pair = np.exp(fore[:, :-1, :, None] + moves + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, 1:, None, None]) * mask[:, 1:, None, None]
        grad = np.concatenate([np.bincount(slots, (gold - keep[page, place])[owner], minlength=DIMS), (seen_moves - pair.sum(axis=(0, 1))).ravel()]) / n - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Crf(theta[:DIMS], theta[DIMS:].reshape(2, 2))


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Made pages with, for each leaf block in order, its text and whether it is main text.

    They vary what pages vary: with or without ``article`` and ``main``, named or
    nameless containers, boilerplate before, beside, after and within the article,
    and unclosed tags. Words are made of random letters, so nothing is learned from them.
    """
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in ("a", "e", "i", "o", "u", "en", "er", "io")]

    def line(low: int, high: int, dot: bool = True) -> str:
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        for k in range(len(words) - 1):
            if rng.random() < 0.12:
                words[k] += rng.choice([",", ",", ".", ";"])
        return " ".join(words).capitalize() + (rng.choice("..!?") if dot else "")

    def named(*kinds: str) -> str:
        kind = rng.choice(kinds)
        return rng.choice([f' class="{kind}"', f' id="{kind}"', f' class="{rng.choice(["x", "col-3", "box", "c12"])} {kind}"', f' class="{kind}-{rng.choice(["wrap", "box", "list", "inner"])}"'])

    def page() -> tuple[str, list[tuple[str, bool]]]:
        rows: list[tuple[str, bool]] = []

        def text(kept: bool, low: int, high: int, dot: bool = True) -> str:
            t = line(low, high, dot)
            rows.append((t, kept))
            return t

        def links(k: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/{i}">{text(False, 1, 4, False)}</a></li>' for i in range(k)) + "</ul>"

        def junk(kind: str) -> str:
            if kind == "nav":
                return rng.choice([lambda: f"<nav{rng.choice(['', named('menu', 'nav')])}>{links(rng.randint(2, 8))}</nav>", lambda: f"<div{named('menu', 'nav', 'navigation', 'navbar', 'breadcrumb', 'breadcrumbs', 'topbar')}>{links(rng.randint(2, 8))}</div>"])()
            if kind == "header":
                inner = lambda: rng.choice([lambda: f"<div>{text(False, 1, 6, False)}</div>", lambda: f"<h2>{text(False, 1, 5, False)}</h2><p>{text(False, 3, 12)}</p>", lambda: f"<h1>{text(False, 1, 4, False)}</h1>"])()
                return f"<header{rng.choice(['', named('header', 'masthead', 'banner')])}>{inner()}</header>" if rng.random() < 0.6 else f"<div{named('header', 'masthead', 'logo', 'site-header')}>{inner()}</div>"
            if kind == "footer":
                inner = lambda: rng.choice([lambda: "&copy; " + foot(), lambda: f"<p>{text(False, 3, 25)}</p>", lambda: links(3), lambda: f"<div>{text(False, 3, 12)}</div>"])()
                return f"<footer>{inner()}</footer>" if rng.random() < 0.6 else f"<div{named('footer', 'copyright', 'legal', 'bottom')}>{inner()}</div>"
            if kind == "side":
                inner = lambda: rng.choice([lambda: links(4), lambda: f"<h3>{text(False, 1, 4, False)}</h3><p>{text(False, 5, 50)}</p>", lambda: f"<p>{text(False, 5, 60)}</p>"])()
                return f"<aside{rng.choice(['', named('sidebar', 'related')])}>{inner()}</aside>" if rng.random() < 0.5 else f"<div{named('sidebar', 'widget', 'related', 'popular', 'trending', 'rail', 'recommended')}>{inner()}</div>"
            if kind == "notice":
                words = ("notice", "cookie", "cookie-consent", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "disclaimer", "paywall")
                return f"<{(t := rng.choice(['div', 'div', 'section', 'p']))}{named(*words)}>{text(False, 4, 40)}{rng.choice(['', '<button>' + text(False, 1, 2, False) + '</button>']) if t != 'p' else ''}</{t}>"
            if kind == "ad":
                t = rng.choice(["div", "div", "section", "p", "aside"])
                return f"<{t}{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'sponsor')}>{text(False, 3, 40)}</{t}>"
            if kind == "form":
                return f"<form{rng.choice(['', named('search', 'login', 'signup', 'form')])}><label>{text(False, 1, 4, False)}</label><input name=q><button>{text(False, 1, 2, False)}</button></form>"
            if kind == "noscript":
                return f"<noscript>{rng.choice([lambda: text(False, 3, 25), lambda: f'<p>{text(False, 3, 25)}</p>', lambda: f'<div>{text(False, 3, 25)}</div>'])()}</noscript>"
            if kind == "share":
                return f"<div{named('share', 'social', 'tags', 'pagination')}><a href=#>{text(False, 1, 3, False)}</a></div>"
            k = rng.randint(1, 4)
            t = rng.choice(["section", "div", "ol"])
            each = lambda: (f"<li>{text(False, 4, 60)}</li>" if t == "ol" else rng.choice([lambda: f"<p>{text(False, 4, 60)}</p>", lambda: f"<div class=comment><b>x</b> <p>{text(False, 4, 60)}</p></div>".replace("<b>x</b> ", ""), lambda: f"<article{named('comment')}><p>{text(False, 4, 60)}</p></article>"])())
            return f"<{t}{named('comments', 'comments', 'commentlist', 'replies', 'discussion', 'respond')}>{'' if t == 'ol' else '<h3>' + text(False, 1, 3, False) + '</h3>'}{''.join(each() for _ in range(k))}</{t}>"

        def foot() -> str:
            t = line(2, 10)
            rows.append((f"© {t}", False))
            return t

        def body_part() -> str:
            r = rng.random()
            if r < 0.62:
                t = text(True, *rng.choice([(3, 20), (20, 90), (20, 90), (1, 3)]))
                return rng.choice([f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<p>{t.replace(' ', ' <a href=/x>', 1)}</a></p>" if " " in t else f"<p>{t}</p>", f"<div>{t}</div>"])
            if r < 0.74:
                return f"<h{(h := rng.randint(2, 4))}>{text(True, 1, 8, False)}</h{h}>"
            if r < 0.84:
                t = rng.choice(["ul", "ol"])
                return f"<{t}>" + "".join(f"<li>{text(True, 2, 25, rng.random() < 0.6)}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>"
            if r < 0.9:
                return f"<blockquote>{rng.choice(['', '<p>'])}{text(True, 5, 50)}</blockquote>"
            if r < 0.94:
                return f"<pre>{text(True, 3, 20)}</pre>"
            if r < 0.97:
                return "<table>" + "".join(f"<tr><td>{text(True, 1, 5, False)}</td><td>{text(True, 1, 5, False)}</td></tr>" for _ in range(2)) + "</table>"
            return f"<figure><img src=x><figcaption>{text(True, 3, 15)}</figcaption></figure>"

        top = [k for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.45] + ["noscript"] * (rng.random() < 0.2)
        rng.shuffle(top)
        out = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body", rng.choice(["", " class='has-sidebar'", " class=page"]), ">"]
        out += [junk(k) for k in top]
        holder = rng.choices(["article", "main", "both", "named", "plain", "body"], [10, 4, 5, 6, 2, 2])[0]
        name = lambda: named("content", "post", "article", "entry-content", "post-content", "story", "article-body", "main", "text", "main-content")
        opening = {"article": f"<article{rng.choice(['', name()])}>", "main": "<main>", "both": f"<main><div class=row><article{rng.choice(['', name()])}>", "named": f"<div{name()}>", "plain": "<div><div>", "body": ""}[holder]
        closing = {"article": "</article>", "main": "</main>", "both": "</article></div></main>", "named": "</div>", "plain": "</div></div>", "body": ""}[holder]
        if rng.random() < 0.15:
            out.append(junk("side"))
        out.append(opening)
        title = lambda: f"<h1>{text(True, 2, 12, rng.random() < 0.3)}</h1>"
        if rng.random() < 0.85:
            out.append(f"<header>{title()}</header>" if holder in ("article", "both") and rng.random() < 0.25 else title())
        inside = 0.12 if holder not in ("plain", "body") else 0.04
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            out.append(body_part())
            if rng.random() < inside:
                out.append(junk(rng.choice(["ad", "side", "notice", "form", "share", "nav", "ad", "noscript"])))
        if rng.random() < 0.2 and inside > 0.1:
            out.append(junk(rng.choice(["share", "comments", "footer", "side"])))
        out.append(closing)
        out += [junk(k) for k in ("share", "comments", "side", "form", "ad", "nav", "footer") if rng.random() < 0.35]
        out.append(rng.choice(["</body></html>", ""]))
        return "".join(out), rows

    return [page() for _ in range(n)]


def as_blocks(page: str, rows: list[tuple[str, bool]]) -> tuple[list[Block], list[bool]]:
    """The blocks of a labelled page with their labels."""
    blocks, want, out = blocks_of(page), list(rows), []
    for b in blocks:
        k = next((k for k, (t, _) in enumerate(want) if t == b.text), None)
        if k is None:
            raise ValueError(f"no label for the block {b.text!r}")
        out.append(want.pop(k)[1])
    return blocks, out


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(as_blocks(*p) for p in labelled_pages())


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id_col, url_col, text, n_chars), one for each page: the kept blocks in page order, joined by line feeds.

    Null and empty pages, and pages without a kept block, have the empty text.
    Repeated rows stay repeated; ids and urls are passed on as they are, null
    ones too; an empty table gives no rows; other columns are not read.
    """
    crf = model or default_model()
    src = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("h"))
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [crf.extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["i", "u", "text", "n_chars"])

    out = arrow_map(src, run, f"i {kinds['i']}, u {kinds['u']}, text string, n_chars long")
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", "n_chars")
