"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, lean, others, schema_of, slices

# Elements by what they do to the text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp svg math object canvas textarea select title".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CLUES = ("nav menu breadcrumb pagination pager header masthead topbar footer copyright foot sidebar aside widget related recommend popular comment reply discussion disqus notice cookie consent banner "
         "alert gdpr ad ads advert sponsor promo form search login subscribe newsletter share social article content post entry body main story text byline author meta tag caption").split()  # fmt: skip

# Words that headings of comments and the like, and footers, begin with or hold.
TELLING = frozenset(
    "comment comments reply replies respond response responses discussion kommentar kommentare commentaire commentaires comentario comentarios "
    "copyright rights reserved rechte droits derechos privacy imprint impressum terms cookies advertisement sponsored related".split()
)

#: A tag ends at the first > outside of quotes; where a quote is never closed, at the first > there is.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<stop>>|\Z)|(?P<broken>[^>]*+)(?P<halt>>|\Z))"
    r"|</[^a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")


#: Clues and elements of an article's surroundings and of what is none; comments and the like may stand inside an article.
MAIN_TAGS, MAIN_CLUES = frozenset("article main".split()), frozenset("article content post entry body main story".split())
APART_TAGS, APART_CLUES = frozenset("nav header footer aside form dialog".split()), frozenset(CLUES) - MAIN_CLUES - frozenset("text byline author meta tag caption".split())


class Place:
    """Elements around a block. Places share what they have in common, so deep nesting takes no more memory than its depth."""

    __slots__ = ("clues", "depth", "slots", "tag", "tags", "two")

    def __init__(self, tag: str, above: Place | None = None, clues: frozenset[str] = frozenset()):
        known = tag if tag in BLOCKS or tag in ("html", "body", "td", "tr", "th", "option") else "other"
        self.tag, self.two = known, f"{above.tag}/{known}" if above else known
        self.depth = 1 + above.depth if above else 0
        self.tags = frozenset([known]) if above is None else above.tags if known in above.tags else above.tags | {known}
        self.clues = clues if above is None else above.clues if clues <= above.clues else above.clues | clues
        self.slots: list[int] | None = None

    def is_main(self) -> bool:
        return not self.tags.isdisjoint(MAIN_TAGS) or not self.clues.isdisjoint(MAIN_CLUES)

    def is_apart(self) -> bool:
        return not self.tags.isdisjoint(APART_TAGS) or not self.clues.isdisjoint(APART_CLUES)

    def names(self) -> list[str]:
        return [f"tag={self.tag}", f"two={self.two}", f"depth={min(8, self.depth)}", *(f"in={t}" for t in sorted(self.tags)), *(f"clue={c}" for c in sorted(self.clues))]


class Block:
    """Text between two block borders, with its place and the characters of it that are links."""

    __slots__ = ("links", "place", "text")

    def __init__(self, text: str, place: Place, links: int):
        self.text, self.place, self.links = text, place, links


@lru_cache(maxsize=1 << 14)
def clues_of(attributes: str) -> frozenset[str]:
    """Words of class, id and role that hint at an element's purpose, and whether it is hidden."""
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            found.add("unseen")
        elif name == "aria-hidden" and value == "true":
            found.add("hidden")
        elif name not in ("style", "aria-hidden"):
            for part in _PART.findall(value):
                word = part.lower()
                found.update(c for c in CLUES if word == c or len(c) > 3 and word.startswith(c))
    return frozenset(found)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order. Comments, elements that hold no text of the page and such as are not shown are skipped; a
    paragraph ends where a block begins; an end tag closes its element and all inside; an unfinished
    tag at the page's end is dropped. Character references are decoded once."""
    page, out = page or "", []
    stack: list[Place] = [Place("")]
    names: list[str] = [""]
    still_open: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text and "unseen" not in stack[-1].clues:
                out.append(Block(text, stack[-1], linked))
        parts.clear()
        linked = 0

    def close(tag: str) -> None:
        while True:
            stack.pop()
            gone = names.pop()
            still_open[gone] -= 1
            if gone == tag:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag or not (m["stop"] or m["halt"]):
            continue
        rest = m["rest"] if m["stop"] else m["broken"]
        if m["end"]:
            if tag in INLINE:
                if tag == "a" and in_link:
                    in_link = 0
                continue
            if still_open[tag] > 0:
                flush()
                close(tag)
                in_link = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not rest.endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else size
            if tag not in INLINE:
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                parts.append(" " if tag != "wbr" else "")
            elif tag == "a":
                in_link = 1
            continue
        flush()
        if tag in BLOCKS and still_open["p"] > 0:
            close("p")
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and names[-1] == tag:
            close(tag)
        if tag not in VOID:
            stack.append(Place(tag, stack[-1], clues_of(rest) if rest else frozenset()))
            names.append(tag)
            still_open[tag] += 1
    flush()
    return out


#: Feature vectors are hashed into so many slots.
SLOTS = 1 << 12


def features(blocks: list[Block]) -> list[list[int]]:
    """Active slots of each block: tags and clues of its ancestors, whether the page marks its article and the block lies in it,
    length, links, punctuation, place, and telling words at its beginning, in it if it is short, and in the heading above it."""
    out, n, under = [], len(blocks), []
    marked = any(b.place.is_main() and not b.place.is_apart() for b in blocks)
    plain = [not b.place.is_apart() and (not b.links or 2 * b.links < len(b.text)) for b in blocks]
    for i, b in enumerate(blocks):
        words, size = b.text.count(" ") + 1, len(b.text)
        state = f"{b.place.is_main()},{b.place.is_apart()},{marked}"
        names = [f"words={min(9, words.bit_length())}", f"links={int(10 * min(1, b.links / size)) if size else 0}", f"stop={b.text[-1] in '.!?…。'}", f"commas={min(3, b.text.count(','))}", f"first={i == 0}", f"last={i == n - 1}", f"sign={b.text[0] in '©®' or '©' in b.text}"]
        names += [f"state={state}", f"state={state},{plain[i]}", f"around={i > 0 and plain[i - 1]},{plain[i]},{i + 1 < n and plain[i + 1]},{marked}", "bias"]
        short = telling_words(b.text[:80])
        if b.place.tag in HEADINGS:
            under = short
        names += [f"says={w}" for w in short] + [f"under={w}" for w in under]
        if short and size <= 80:
            names.append("tells")
        if under:
            names.append(f"under,{b.place.tag in HEADINGS}")
        if b.place.slots is None:
            b.place.slots = [_slot(x) for x in b.place.names()]
        out.append([*b.place.slots, *(_slot(x) for x in names)])
    return out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend".split())


def telling_words(text: str) -> list[str]:
    """Telling words among the first four of a text, or anywhere in it if it has no more than twelve."""
    words = _WORDS.findall(text.lower())
    return sorted(TELLING.intersection(words if len(words) <= 12 else words[:4]))


@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return crc32(name.encode()) % SLOTS


class Crf:
    """Two labels, 0 boilerplate and 1 article: unary weights by slot, weights of label pairs."""

    def __init__(self, unary: np.ndarray | None = None, pair: np.ndarray | None = None):
        self.unary = np.zeros((SLOTS, 2)) if unary is None else unary
        self.pair = np.zeros((2, 2)) if pair is None else pair
        self.lists = self.unary.tolist(), self.pair.tolist()

    def scores(self, page: list[list[int]]) -> np.ndarray:
        return np.array([self.unary[x].sum(0) for x in page]) if page else np.zeros((0, 2))

    def viterbi(self, page: list[list[int]]) -> list[int]:
        """The likeliest labels of a page."""
        unary, ((aa, ab), (ba, bb)) = self.lists
        back, s0, s1 = [], 0.0, 0.0
        for i, slots in enumerate(page):
            u0 = u1 = 0.0
            for x in slots:
                w = unary[x]
                u0 += w[0]
                u1 += w[1]
            if i:
                back.append((int(s1 + ba > s0 + aa), int(s1 + bb > s0 + ab)))
                s0, s1 = max(s0 + aa, s1 + ba) + u0, max(s0 + ab, s1 + bb) + u1
            else:
                s0, s1 = u0, u1
        if not page:
            return []
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def gradient(self, page: list[list[int]], truth: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected label marginals, by forward and backward sums in logarithms."""
        u, n = self.scores(page), len(page)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = u[0]
        for i in range(1, n):
            forward[i] = u[i] + np.logaddexp(forward[i - 1, 0] + self.pair[0], forward[i - 1, 1] + self.pair[1])
        for i in range(n - 2, -1, -1):
            ahead = u[i + 1] + backward[i + 1]
            backward[i] = np.logaddexp(self.pair[:, 0] + ahead[0], self.pair[:, 1] + ahead[1])
        total = np.logaddexp(*forward[-1])
        single = -np.exp(forward + backward - total)
        single[np.arange(n), truth] += 1
        pair = np.zeros((2, 2))
        for i in range(1, n):
            pair -= np.exp(forward[i - 1][:, None] + self.pair + (u[i] + backward[i])[None] - total)
            pair[truth[i - 1], truth[i]] += 1
        return single, pair


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 8, rate: float = 0.3, seed: int = 1) -> Crf:
    """Stochastic gradient on the conditional likelihood with adaptive steps and a small ridge."""
    crf, rng = Crf(), random.Random(seed)
    squares, pair_squares = np.full((SLOTS, 2), 1e-2), np.full((2, 2), 1e-2)
    pages = [p for p in pages if p[0]]
    for _ in range(rounds):
        rng.shuffle(pages)
        for page, truth in pages:
            single, pair = crf.gradient(page, truth)
            step = np.zeros((SLOTS, 2))
            for slots, g in zip(page, single, strict=True):
                np.add.at(step, slots, g)
            used = np.unique(np.concatenate([np.array(s) for s in page]))
            step = step[used] - 1e-3 * crf.unary[used]
            squares[used] += step**2
            crf.unary[used] += rate * step / np.sqrt(squares[used])
            pair_squares += pair**2
            crf.pair += rate * pair / np.sqrt(pair_squares)
    return Crf(crf.unary, crf.pair)


_SYLLABLES = "ba be bi bo da de di do fa fe ga go ha he ka ki la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se si so ta te ti to va ve wa wo".split()

_DULL = "c1 c2 x7 box row col-8 wrap u-12 a1 left container".split()


def labelled_pages(count: int = 1000, seed: int = 7) -> list[tuple[str, dict[str, int]]]:
    """Pages of many layouts with the label of each block's text: the labelled set that the field is trained on.

    Every layout puts an article among menus, headers, footers, sidebars, notices, adverts, forms and reader
    comments, under varied tags and class names; lengths and punctuation overlap between the two labels, so
    that what surrounds a block and its neighbours decide more than its wording. A third of the pages has no telling class
    names: their articles stand in plain elements, in table cells or in no element at all, with few things or nothing around.
    """
    rng, out = random.Random(seed), []

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def one_page() -> tuple[str, dict[str, int]]:
        labels: dict[str, int] = {}

        def text(label: int, a: int, b: int, stop: bool | None = None) -> str:
            t = words(a, b).capitalize()
            t += rng.choice([".", ".", "!", "?", ""]) if stop is None else "." * stop
            labels[_SPACE.sub(" ", t)] = label
            return t

        def tag(name: str, *classes: str) -> tuple[str, str]:
            c = rng.choice(classes) if classes else ""
            return (f'<{name} {rng.choice(["class", "id", "class"])}="{c}">' if c else f"<{name}>"), f"</{name}>"

        def menu() -> str:
            a, b = rng.choice([tag("nav"), tag("nav", "main-nav", "menu"), tag("div", "menu", "nav-bar", "breadcrumbs", "pagination", "navbar"), tag("ul", "menu", "nav")])
            items = "".join(f'<li><a href="/x">{text(0, 1, 3, False)}</a></li>' for _ in range(rng.randint(2, 7)))
            return a + (items if a.startswith("<ul") else f"<ul>{items}</ul>") + b

        def aside() -> str:
            a, b = rng.choice([tag("aside"), tag("aside", "sidebar", "related"), tag("div", "sidebar", "widget", "related-posts", "recommended", "popular")])
            return a + f"<h3>{text(0, 1, 4, False)}</h3>" * rng.randint(0, 1) + "".join(f"<p>{text(0, 2, 40)}</p>" for _ in range(rng.randint(1, 3))) + b

        def advert() -> str:
            a, b = rng.choice([tag("div", "ad", "ads", "advert", "sponsored", "promo", "ad-banner", "advertisement"), tag("aside", "ad", "promo"), tag("section", "ads", "sponsor")])
            return f"<!-- ad {rng.randint(0, 99)} -->" * rng.randint(0, 1) + a + (f"<p>{text(0, 2, 30)}</p>" if rng.random() < 0.3 else text(0, 2, 30)) + b

        def notice() -> str:
            a, b = rng.choice([tag("div", "notice", "cookie-banner", "alert", "cookie-consent", "gdpr", "banner", "cookies"), tag("section", "notice", "consent"), tag("dialog")])
            return a + rng.choice([f"<p>{text(0, 4, 40)}</p>", text(0, 4, 30)]) + f"<button>{text(0, 1, 2, False)}</button>" * rng.randint(0, 1) + b

        def form() -> str:
            a, b = rng.choice([tag("form"), tag("form", "search", "login", "subscribe"), tag("div", "newsletter", "search-box", "subscribe")])
            return a + f"<label>{text(0, 1, 5, False)}</label> <input name=q>" + f"<p>{text(0, 3, 30)}</p>" * rng.randint(0, 1) + b

        def share() -> str:
            a, b = tag("div", "share", "social", "share-buttons", "social-links")
            return a + f'<a href="#">{text(0, 1, 3, False)}</a>' + b

        def comments() -> str:
            a, b = rng.choice([tag("section", "comments", "discussion"), tag("div", "comments", "comment-list", "replies", "disqus_thread"), tag("ol", "comments", "commentlist")])
            each = lambda: rng.choice([f'<div class="comment"><p>{text(0, 4, 60)}</p></div>', f'<li class="comment"><b>{words(1, 2)}</b><p>{text(0, 4, 60)}</p></li>', f"<p>{text(0, 4, 60)}</p>", f'<article class="comment"><p>{text(0, 4, 60)}</p></article>'])
            return a + f"<h3>{text(0, 1, 3, False)}</h3>" * rng.randint(0, 1) + "".join(each() for _ in range(rng.randint(1, 4))) + b

        def said(t: str) -> str:
            labels[t] = 0
            return t

        def own(t: str) -> str:
            labels[t] = 1
            return t

        def plain_comments() -> str:
            """Comments that nothing but their heading tells."""
            a, b = rng.choice([("<div>", "</div>"), (f"<div class={rng.choice(_DULL)}>", "</div>"), ("<section>", "</section>"), ("", "")])
            heading = said(rng.choice(["Comments", f"Comments ({rng.randint(1, 99)})", f"{rng.randint(2, 99)} comments", f"{rng.randint(2, 99)} Responses", "Leave a reply", "Discussion", "Kommentare", "Commentaires", "Comentarios", "Reader comments"]))
            h = rng.choice(["h2", "h3", "h4", "h3"])
            each = lambda: rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", "<p>{}</p>"]).format(text(0, 1, 40))
            return f"{a}<{h}>{heading}</{h}>" + "".join(each() for _ in range(rng.randint(1, 5))) + b

        def plain_footer() -> str:
            """A footer that nothing but its wording tells."""
            year, name = rng.randint(1998, 2024), words(1, 3).title()
            t = rng.choice([f"Copyright {year} {name}", f"Copyright {year} {name}. All rights reserved.", f"{year} {name}. All rights reserved.", f"{name}. Alle Rechte vorbehalten.", f"{name}. Tous droits réservés.", f"Privacy policy. Terms of use. {name}"])
            return rng.choice(["<div>{}</div>", f"<div class={rng.choice(_DULL)}>{{}}</div>", "<p>{}</p>", "<center>{}</center>", "<hr>{}"]).format(said(t))

        def header() -> str:
            a, b = rng.choice([tag("header"), tag("header", "site-header", "masthead"), tag("div", "header", "masthead", "topbar", "page-header")])
            return a + rng.choice([f"<p>{text(0, 1, 8)}</p>", f'<div class="logo"><a href="/">{text(0, 1, 3, False)}</a></div>', f"<h2>{text(0, 1, 5, False)}</h2>", f"<h1>{text(0, 1, 5, False)}</h1>"]) + (menu() if rng.random() < 0.4 else "") + b

        def footer() -> str:
            a, b = rng.choice([tag("footer"), tag("footer", "site-footer"), tag("div", "footer", "copyright", "page-footer", "foot")])
            return a + rng.choice(["&copy; ", "", "&copy; "]) + text(0, 2, 20) + f"<p>{text(0, 3, 20)}</p>" * rng.randint(0, 1) + b

        def body_block() -> str:
            k = rng.random()
            if k < 0.66:
                return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>", "<p><a href='/y'>{}</a></p>"]).format(text(1, 1, 120))
            if k < 0.78:
                h = rng.choice(["h2", "h3", "h2", "h4"])
                return f"<{h}>{text(1, 1, 10, False)}</{h}>"
            if k < 0.86:
                return "<ul>" + "".join(f"<li>{text(1, 1, 20)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            if k < 0.91:
                return f"<blockquote><p>{text(1, 4, 50)}</p></blockquote>"
            if k < 0.95:
                return "<table><tr>" + "".join(f"<td>{text(1, 1, 6)}</td>" for _ in range(rng.randint(1, 4))) + "</tr></table>"
            return rng.choice([f"<pre>{text(1, 2, 30)}</pre>", f"<figure><img src=x><figcaption>{text(1, 2, 15)}</figcaption></figure>"])

        def article() -> str:
            a, b = rng.choice([tag("article"), tag("article"), tag("article", "post", "entry"), tag("main"), tag("main", "content", "main-content"), tag("div", "content", "post-content", "entry-content", "article-body", "main-content", "story")])
            title = f"<h1>{text(1, 1, 12, rng.random() < 0.4)}</h1>"
            inner = rng.choice([title, title, title, f"<header>{title}</header>" if a.startswith("<article") else title, ""])
            for _ in range(rng.randint(1, 9)):
                inner += body_block()
                if rng.random() < 0.05:  # telling words in what belongs to the article
                    t = f"{rng.choice(['Comments', 'Copyright', 'Replies', 'Discussion', 'Terms', 'Related'])} {words(8, 30)}."
                    inner += f"<p>{own(t)}</p>"
                if rng.random() < 0.05:
                    inner += f"<{rng.choice(['h2', 'h3'])}>{own(rng.choice(['Discussion', 'Related work', 'Terms', 'Responses of the body', 'Diskussion und Kommentar']))}</h3><p>{text(1, 5, 60)}</p><p>{text(1, 5, 60)}</p>"
                k = rng.random()
                inner += advert() if k < 0.05 else aside() if k < 0.07 else notice() if k < 0.085 else ""
            inner += (share() if rng.random() < 0.15 else "") + (comments() if rng.random() < 0.12 else "") + (footer() if rng.random() < 0.06 and a.startswith("<article") else "") + (form() if rng.random() < 0.05 else "")
            if rng.random() < 0.06:
                inner += f"<p>{own(rng.choice(['All rights reserved.', 'Alle Rechte vorbehalten.', 'Terms and privacy.', 'Copyright by the author.']))}</p>"
            return a + inner + b

        def plain_page() -> str:
            dull = lambda name: f"<{name}{rng.choice(['', '', f' class={rng.choice(_DULL)}', f' id=x{rng.randint(1, 99)}'])}>"
            links = lambda: "".join(f'<li><a href="/x">{text(0, 1, 3, False)}</a></li>' for _ in range(rng.randint(2, 6)))
            k = rng.random()
            if k < 0.1:  # text without any element, or a paragraph or two
                return rng.choice([text(1, 2, 60), "".join(f"<p>{text(1, 1, 60)}</p>" for _ in range(rng.randint(1, 3)))])
            inner = rng.choice([f"<h1>{text(1, 1, 10, False)}</h1>", f"<h2>{text(1, 1, 10, False)}</h2>", ""]) + "".join(body_block() for _ in range(rng.randint(1, 8)))
            a, b = rng.choice([(dull("div"), "</div>"), (dull("div") + dull("div"), "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), (f"<table><tr><td>{' '.join(f'<a href=/x>{text(0, 1, 3, False)}</a>' for _ in range(rng.randint(1, 4)))}</td></tr><tr><td>", "</td></tr></table>"), (dull("section"), "</section>"), ("", ""), ("<center>", "</center>")])
            above = some(0.4, lambda: f"{dull('nav')}<ul>{links()}</ul></nav>") + some(0.3, lambda: f"<header><p>{text(0, 1, 6)}</p></header>") + some(0.25, lambda: f"{dull('div')}<ul>{links()}</ul></div>")
            below = some(0.2, lambda: f"<aside><p>{text(0, 2, 30)}</p></aside>") + some(0.2, lambda: f"<form><label>{text(0, 1, 5, False)}</label> <input name=q></form>") + some(0.15, plain_comments) + some(0.5, lambda: rng.choice([f"<footer>{rng.choice(['&copy; ', ''])}{text(0, 2, 12)}</footer>", plain_footer()]))
            return rng.choice(["<html><body>{}</body></html>", "<!DOCTYPE html><body>{}", "{}"]).format((above + a + inner + b + below).replace("{", "").replace("}", ""))

        some = lambda p, f: f() if rng.random() < p else ""
        if rng.random() < 0.33:
            return plain_page(), labels
        before = [some(0.5, header), some(0.75, menu), some(0.35, notice), some(0.5, advert), some(0.2, form), some(0.15, aside)]
        after = [some(0.3, aside), some(0.25, advert), some(0.15, share), some(0.3, comments), some(0.15, plain_comments), some(0.2, form), some(0.1, menu)]
        rng.shuffle(after)
        inner = "".join(before) + article() + "".join(after)
        if rng.random() < 0.25:
            inner = f'<div class="{rng.choice(["wrapper", "page", "container", "site"])}">{inner}</div>'
        head = f"<head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head>" * (rng.random() < 0.8)
        return f"<!DOCTYPE html><html>{head}<body>{inner}{some(0.85, rng.choice([footer, footer, footer, plain_footer]))}</body></html>", labels

    for _ in range(count):
        out.append(one_page())
    return out


@lru_cache(maxsize=2)
def trained(count: int = 1000, seed: int = 7) -> Crf:
    """The field trained on ``count`` labelled pages (the bound of what it learns from)."""
    pages = []
    for page, labels in labelled_pages(count, seed):
        blocks = blocks_of(page)
        pages.append((features(blocks), [labels.get(b.text, labels.get(b.text.removeprefix("© "), 0)) for b in blocks]))
    return train(pages)


def main_text(page: str | None, crf: Crf) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, label in zip(blocks, crf.viterbi(features(blocks)), strict=True) if label)


def extract_main_text(pages: DataFrame, crf: Crf | None = None, html: str = "html") -> DataFrame:
    """Replace column ``html`` by text string (empty if nothing is found) and n_chars long, its code points.

    Null html counts as empty. Pages are read whole, whatever their length. Other columns are passed through
    (text and n_chars, in any case, give way); repeated rows give equal texts; an empty table gives none.
    """
    crf = crf or trained()
    unary, pair = crf.unary, crf.pair
    bound_batches(pages.sparkSession)
    base = pages.select(*others(pages, html, "text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(unary, pair)
        for part in slices(batches):
            texts = [main_text(x.as_py(), own) for x in part.column(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    return pages.select(*others(pages, html, "text", "n_chars"), pages[html]).mapInArrow(lean(run), schema_of(base, ("text", "string"), ("n_chars", "bigint")))
