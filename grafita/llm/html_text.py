"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks, each a vector: the tags of its path, the parts
of its classes and ids that training has met (all others are one and the same "unknown
name"), hashed words, and a few plain figures.  A bidirectional LSTM, in numpy,
reads the whole sequence in both directions and labels every block as text or not, so a
block is judged in the light of the whole page.

No table has labelled blocks, so the labeller is trained on pages it is given (a bounded
sample) with noisy labels from their tags, and on copies of them into which menus,
notices, forms, comments, headers and sidebars of many namings have been put.  In most
copies the names of text, of furniture or of both are taken away or made unknown, so that
a name nobody knows says nothing: tags, links, words, place and neighbours decide.
"""

from __future__ import annotations

import html as html_entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafita.llm.textkit import slices

# HTML elements by how they split and hide text.
_HIDDEN = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "head", "title", "textarea", "select", "option", "button"}
_IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "noframes", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_UNSEEN = {"script", "style", "template"}
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg"}
_ENDS_P = {"p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "section", "article", "aside", "nav", "header", "footer", "form", "main"}
_BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_NAMES = re.compile(r"(?<![a-z])(ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|header|masthead|footer|foot|side-?bar|aside|widget\w*|related|share|social|cookie\w*|consent|notice|alert|popup|modal|subscribe|newsletter|comments?|replies|reply|disqus|respond|breadcrumbs?|login|signup|search|copyright|legal|toolbar|pagination|tags?)(?![a-z])")

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?]|/(?=[^a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*+))")
# one attribute: its name, and the quote that opens its value or the whole unquoted value; or the tag's end
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:([\"'])|([^\s>]*+)))?+)")
_UNQUOTED = re.compile(r"[^\s>]*+")
_SAID = {"class", "id", "role"}
_SPACE = re.compile(r"\s+")
#: Places of a vector: one for each tag and one for others; one for each known part of a name, one for others, and spare ones; hashed words.
_TAGS = {t: i for i, t in enumerate(sorted(_HIDDEN | _INLINE | _ENDS_P | _BOILER | {"html", "body", "figure", "figcaption", "blockquote", "pre", "details", "summary", "dl", "tbody", "thead", "tfoot", "hr", "center", "address", "fieldset", "caption"}))}
_NAMED = 256
_PATH, _WORD = len(_TAGS) + 1 + _NAMED + 1, 64
_UNKNOWN = "class=\N{REPLACEMENT CHARACTER}"
_PLAIN = 7
_AT_ONCE = 2048
WIDTH = _PATH + _WORD + _PLAIN


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links


class _Page:
    """A page's bytes of markup, read from left to right; no search for a missing end is made twice."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where what stands from at on, or -1.  ``at`` must not fall from call to call."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """Class, id and role of the tag whose name ends at ``at``; where the tag ends; whether it closes itself.

        As HTML has it, a quote opens a value only right after the equals sign; elsewhere
        it is a letter as any other.  A quote that nothing closes is taken as a letter, too.
        """
        page, said = self.page, []
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:
                return said, len(page), False  # the page ends within the tag
            at = m.end()
            if m[1]:
                return said, at, at - 2 >= m.start() and page[at - 2] == "/"  # the slash of an unquoted value is no part of m
            value = m[4] or ""
            if m[3]:
                close = self.find(m[3], at)
                if close >= 0:
                    value, at = page[at:close], close + 1
                else:
                    bare = _UNQUOTED.match(page, at)
                    value, at = bare[0], bare.end()
            if m[2].lower() in _SAID:
                said.append((m[2].lower(), value))

    def closing(self, tag: str, at: int) -> int:
        """Where the end tag of an element of raw text ends, or -1."""
        key = f"</{tag}"
        if key in self.missing:
            return -1
        m = re.compile(f"</{tag}(?=[\\s/>])[^>]*+>", re.I).search(self.page, at)
        if m is None:
            self.missing.add(key)
            return -1
        return m.end()


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order; scripts, styles, heads and markup are never text."""
    reader = _Page(page)
    depth: dict[str, int] = {}  # open elements by tag
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    hidden, links, linked, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", html_entities.unescape("".join(buffer))).strip()
            if text:
                out.append(Block(text, tuple(x for _, names in stack for x in names), linked))
            buffer.clear()
        linked = 0

    def end_head() -> None:
        """Takes off a head that is open at a place where no head goes on: </head> may be left out."""
        nonlocal hidden
        while stack and stack[-1][0] == "head":
            stack.pop()
            depth["head"] -= 1
            hidden -= 1

    def add(raw: str) -> None:
        nonlocal linked
        if hidden and raw and not raw.isspace():
            end_head()
        if raw and not hidden:
            buffer.append(raw)
            if links:
                linked += len(raw)

    def take(opened: list[tuple[str, tuple[str, ...]]]) -> None:
        nonlocal hidden, links
        for t, _ in opened:
            depth[t] -= 1
            hidden -= t in _HIDDEN
            links -= t == "a"

    end = len(page)
    while at < end:
        m = _OPEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[5] is None:
            # comments and the like; one that nothing ends goes on to the end of the page
            mark, back = ("-->", 2) if m[1] else ("]]>", 0) if m[2] and reader.find("]]>", at) >= 0 else (">", 0)
            close = reader.find(mark, at - back)
            at = close + len(mark) if close >= 0 else end
            continue
        tag = m[5].lower()
        said, at, itself = reader.attributes(at) if page[at : at + 1] != ">" else ([], at + 1, False)
        block = tag not in _INLINE and tag not in _UNSEEN
        if m[4]:
            if depth.get(tag, 0):
                if block:
                    flush()
                top = len(stack) - 1
                while stack[top][0] != tag:
                    top -= 1
                take(stack[top:])
                del stack[top:]
            continue
        if hidden and tag not in _IN_HEAD:
            end_head()
        if block:
            flush()
            if tag in _ENDS_P and depth.get("p", 0):
                # an open paragraph, with the inline elements left open in it, ends here
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        take(stack[i:])
                        del stack[i:]
                        break
                    if stack[i][0] not in _INLINE:
                        break
        elif tag == "br":
            add(" ")
        if tag in _VOID or itself:
            continue
        if tag in _RAW:
            close = reader.closing(tag, at)
            if close >= 0:
                at = close
                continue
            if tag in ("script", "style", "textarea"):
                break  # as browsers do, all the rest is its text
            continue
        names = [tag, *(f"{name}={v}" for name, value in said for v in value.lower().split())]
        stack.append((tag, tuple(names)))
        depth[tag] = depth.get(tag, 0) + 1
        hidden += tag in _HIDDEN
        links += tag == "a"
    flush()
    return out


def _parts(name: str) -> list[str]:
    """The words of a class, id or role."""
    return re.findall(r"[a-z]+", name.partition("=")[2])


def known_names(pages: list[list[Block]]) -> dict[str, int]:
    """The parts of names that most pages have, each with a place of its own."""
    seen: dict[str, int] = {}
    for blocks in pages:
        for part in {p for b in blocks for n in b.path if "=" in n for p in _parts(n)}:
            seen[part] = seen.get(part, 0) + 1
    return {p: i for i, p in enumerate(sorted(seen, key=lambda p: (-seen[p], p))[:_NAMED])}


def framed(blocks: list[Block]) -> bool:
    """Whether a page says itself, by tags, where its text stands."""
    return any("article" in b.path or "main" in b.path for b in blocks)


def features(blocks: list[Block], names: dict[str, int], start: int = 0, total: int | None = None, frame: bool | None = None) -> np.ndarray:
    """(blocks, WIDTH) vectors; blocks are those from ``start`` on of a page that has ``total``; frame: ``framed`` of the page.

    However many elements of a tag or name a block lies in, they count as the nearest.
    """
    total = len(blocks) if total is None else total
    frame = framed(blocks) if frame is None else frame
    x = np.zeros((len(blocks), WIDTH), np.float32)
    first, other = len(_TAGS) + 1, len(_TAGS) + 1 + _NAMED
    for i, b in enumerate(blocks):
        depth = 0
        for name in reversed(b.path):
            near = 1.0 / (1 + 0.1 * depth)
            if "=" not in name:
                at = _TAGS.get(name, len(_TAGS))
                x[i, at] = max(x[i, at], near)
                depth += 1
            else:
                for at in {first + names[p] if p in names else other for p in _parts(name)} or {other}:
                    x[i, at] = max(x[i, at], near)
        words = b.text.lower().encode("utf-8", "surrogatepass").split()
        slots = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % _WORD
        x[i, _PATH : _PATH + _WORD] = np.bincount(slots, minlength=_WORD) / max(1, len(words))
        n = len(b.text)
        x[i, _PATH + _WORD :] = (np.log1p(n) / 8, b.linked / max(1, n), (start + i) / total, b.text.count(",") * 10 / max(10, n), b.text[-1] in ".!?", min(1.0, n / 200), frame and "article" not in b.path and "main" not in b.path)
    return x


@dataclass
class Labeller:
    """Weights of the two LSTMs and the output layer, and the parts of names it knows."""

    w: dict[str, np.ndarray]
    hidden: int
    names: dict[str, int]

    @staticmethod
    def fresh(hidden: int, rng: np.random.Generator, names: dict[str, int]) -> Labeller:
        w = {}
        for d in "fb":
            w["x" + d] = rng.standard_normal((WIDTH, 4 * hidden)).astype(np.float32) * 0.1
            w["h" + d] = rng.standard_normal((hidden, 4 * hidden)).astype(np.float32) * 0.1
            w["c" + d] = np.zeros(4 * hidden, np.float32)
            w["c" + d][hidden : 2 * hidden] = 1
            w["o" + d] = rng.standard_normal(hidden).astype(np.float32) * 0.2
        w["o"] = np.zeros(1, np.float32)
        return Labeller(w, hidden, names)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits (pages, blocks) of padded pages x (pages, blocks, WIDTH)."""
        n, steps, _ = x.shape
        return self.swept({d: self.gates(x.reshape(-1, WIDTH), d).reshape(n, steps, -1) for d in "fb"}, mask, keep)

    def gates(self, x: np.ndarray, d: str) -> np.ndarray:
        """What the vectors x give to the gates of the LSTM of direction d."""
        return x @ self.w["x" + d] + self.w["c" + d]

    def swept(self, given: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits, from what the vectors give to the gates of both directions (pages, blocks, 4 * hidden)."""
        n, steps = mask.shape
        h_, logits, tape = self.hidden, np.full((n, steps), self.w["o"][0], np.float32), {}
        for d in "fb":
            gates = given[d]
            h, c = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
            hs = np.zeros((n, steps, h_), np.float32)
            saved = []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g = gates[:, t] + h @ self.w["h" + d]
                s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * h_], -30, 30)))
                i, f, o, u = s[:, :h_], s[:, h_ : 2 * h_], s[:, 2 * h_ :], np.tanh(g[:, 3 * h_ :])
                c1 = f * c + i * u
                tc = np.tanh(c1)
                on = mask[:, t, None]
                if keep:
                    saved.append((t, h, c, i, f, o, u, tc, on))
                h, c = np.where(on, o * tc, h), np.where(on, c1, c)
                hs[:, t] = h
            logits += hs @ self.w["o" + d]
            tape[d] = (hs, saved)
        return logits, tape

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logits, tape = self.run(x, mask, True)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        total = mask.sum()
        loss = float(-(np.log(np.where(y, p, 1 - p) + 1e-9) * mask).sum() / total)
        gap = ((p - y) * mask / total).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["o"][0] = gap.sum()
        n, steps, _ = x.shape
        h_ = self.hidden
        for d in "fb":
            hs, saved = tape[d]
            grad["o" + d] = np.einsum("nt,nth->h", gap, hs)
            dh, dc = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
            dgates = np.zeros((n, steps, 4 * h_), np.float32)
            for t, h, c, i, f, o, u, tc, on in reversed(saved):
                dh = dh + gap[:, t, None] * self.w["o" + d]
                a, b = np.where(on, dh, 0), np.where(on, dc, 0)
                b = b + a * o * (1 - tc * tc)
                g = np.concatenate([b * u * i * (1 - i), b * c * f * (1 - f), a * tc * o * (1 - o), b * i * (1 - u * u)], 1)
                dgates[:, t] = g
                grad["h" + d] += h.T @ g
                dh = np.where(on, g @ self.w["h" + d].T, dh)
                dc = np.where(on, b * f, dc)
            grad["x" + d] = x.reshape(-1, WIDTH).T @ dgates.reshape(-1, 4 * h_)
            grad["c" + d] = dgates.sum((0, 1))
        return loss, grad

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page's blocks the mask of those that are text.

        Blocks become vectors a bounded number at a time; of a page no more is held at
        once than what its blocks give to the gates.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        at = 0
        while at < len(order):
            # batches of pages of like length, of bounded size
            rows = order[at : at + max(1, min(64, 4096 // len(pages[order[at]])))]
            while len(rows) > 1 and len(rows) * len(pages[rows[-1]]) > 2 * _AT_ONCE:
                rows = rows[: len(rows) // 2]
            at += len(rows)
            steps = max(len(pages[i]) for i in rows)
            given = {d: np.zeros((len(rows), steps, 4 * self.hidden), np.float32) for d in "fb"}
            mask = np.zeros((len(rows), steps), bool)
            for k, i in enumerate(rows):
                size, frame = len(pages[i]), framed(pages[i])
                mask[k, :size] = True
                for a in range(0, size, _AT_ONCE):
                    x = features(pages[i][a : a + _AT_ONCE], self.names, a, size, frame)
                    for d in "fb":
                        given[d][k, a : a + len(x)] = self.gates(x, d)
            logits, _ = self.swept(given, mask)
            for i, z in zip(rows, logits, strict=True):
                out[i] = z[: len(pages[i])] > 0
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


def noisy_label(block: Block) -> bool:
    """Text or not, as far as a block's tags and names tell."""
    names = {n for n in block.path if "=" not in n}
    said = " ".join(n.partition("=")[2] for n in block.path if "=" in n)
    if names & _BOILER or said and _NAMES.search(said):
        return False
    if names & {"article", "main"}:
        return True
    return len(block.text) >= 80 and block.linked < 0.3 * len(block.text)


#: How the names of a copy's text and furniture are treated: kept, made unknown or taken away.
_NAMINGS = [("kept", "kept"), ("unknown", "unknown"), ("unknown", "unknown"), ("none", "unknown"), ("unknown", "kept"), ("none", "none"), ("none", "none"), ("none", "none"), ("unknown", "none")]


def _renamed(path: tuple[str, ...], how: str) -> tuple[str, ...]:
    if how == "kept":
        return path
    return tuple(_UNKNOWN if "=" in n else n for n in path if how == "unknown" or "=" not in n)


def _disturbed(blocks: list[Block], labels: list[bool], rng: random.Random) -> tuple[list[Block], list[bool]]:
    """A copy of a page with other furniture around and inside its text, and other names or none."""
    words = " ".join(b.text for b in blocks).split() or ["text"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", "", ".", "!"])
    of_text, of_rest = rng.choice(_NAMINGS)
    nested = lambda: ("div", "class=container") * rng.choice([0, 0, 0, 1, 1, 2, 4])
    top = ("html", "body", *nested())
    wrap = rng.choice([("article",), ("main",), ("div", "class=content"), ("div", "class=content"), ("div", "id=main"), ("div", "class=post"), ("main", "article"), ("section", "class=entry-content"), ("div", "class=page", "article"), ("div", "class=richtext"), ("div",), ("div",), ("section",), ("table", "tr", "td"), ()])
    # where neither names nor tags tell furniture from text, only what is linked, or stands in a tag of its own, can be learnt
    told = of_rest == "kept" or "article" in wrap or "main" in wrap

    def some(kind: str) -> list[Block]:
        if kind == "menu":
            path = (*top, *rng.choice([("nav",), ("div", "class=menu"), ("div", "id=navigation"), ("header", "class=site-header"), ("ul", "class=nav-links"), ("table", "tr", "td"), ()]), *rng.choice([("ul", "li"), ("ul", "li"), (), ("p",), ("div",)]))  # the link itself has ended where its block does
            return [Block(t, _renamed(path, of_rest), len(t)) for t in (say(rng.randint(1, 3)) for _ in range(rng.randint(2, 8)))]
        names = {
            "header": [("header",), ("div", "id=header"), ("div", "class=masthead"), ("header", "class=banner")],
            "footer": [("footer",), ("div", "class=footer"), ("div", "id=foot"), ("div", "class=copyright")],
            "side": [("aside",), ("div", "class=sidebar"), ("div", "id=side-bar"), ("div", "class=widget"), ("div", "class=related")],
            "notice": [("div", "class=cookie-notice"), ("div", "id=consent"), ("div", "class=notice"), ("div", "class=alert"), ("div", "role=alert")],
            "advert": [("div", "class=ad"), ("div", "class=advert"), ("div", "class=sponsored"), ("ins", "class=adsbygoogle"), ("div", "id=banner-ad"), ("div", "class=promo")],
            "form": [("form",), ("form", "class=subscribe"), ("div", "class=newsletter"), ("form", "id=search")],
            "comment": [("section", "class=comments"), ("div", "id=comments"), ("ol", "class=comment-list"), ("div", "class=comment"), ("div", "id=disqus_thread")],
        }[kind]
        own = [n for n in names if n[0] not in ("div", "section", "ol")]
        if not told and not own:
            return []
        path = (*top, *rng.choice(names if told else own), *rng.choice([(), ("p",), ("div",), ("p", "span"), ("div", "p")]))
        return [Block(say(rng.randint(2, 60)), _renamed(path, of_rest), 0) for _ in range(rng.randint(1, 5))]

    body = []
    deep = nested()
    for b in (b for b, t in zip(blocks, labels, strict=True) if t):
        tail = rng.choice([("h1",), ("h2",)]) if len(b.text) < 90 and rng.random() < 0.5 else rng.choice([("p",), ("p",), ("p",), ("li",), ("blockquote", "p"), ("div",), ("td",)])
        body.append((Block(b.text, _renamed((*top, *wrap, *deep, *tail), of_text), 0), True))
    for _ in range(rng.randint(0, 2) if of_rest == "kept" else 0):
        at = rng.randint(0, len(body))
        inside = rng.choice(["advert", "notice", "form", "side"])
        body[at:at] = [(Block(b.text, _renamed((*top, *wrap), of_text) + b.path[len(top) :], 0), False) for b in some(inside)]
    before = [(b, False) for k in rng.sample(["menu", "header", "notice", "advert", "side"], rng.randint(0, 4)) for b in some(k)]
    after = [(b, False) for k in rng.sample(["comment", "side", "form", "advert", "footer", "notice", "menu"], rng.randint(0, 4)) for b in some(k)]
    both = before + body + after
    return [b for b, _ in both], [t for _, t in both]


def fit(pages: list[str], hidden: int = 16, rounds: int = 500, copies: int = 1_000, seed: int = 4, longest: int = 60) -> Labeller:
    """Trains a labeller on sample pages and about ``copies`` disturbed ones.  Training reads at most ``longest`` blocks in a row of a page."""
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    base = [(b, [noisy_label(x) for x in b]) for b in (blocks_of(p) for p in pages) if b]
    if not base:
        base = [([Block("text of a page, with words.", ("html", "body", "article", "p"), 0)], [True])]
    all_ = [p for p in base] + [p for blocks, labels in base for _ in range(-(-copies // len(base))) if (p := _disturbed(blocks, labels, draw))[0]]
    model = Labeller.fresh(hidden, rng, known_names([b for b, _ in all_]))
    sets = []
    for b, y in all_:
        at = draw.randint(0, max(0, len(b) - longest)) if draw.random() < 0.5 else 0
        sets.append((features(b[at : at + longest], model.names, at, len(b), framed(b)), np.array(y[at : at + longest])))
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    for t in range(1, rounds + 1):
        chosen = [sets[draw.randrange(len(sets))] for _ in range(24)]
        x, mask = _padded([c[0] for c in chosen])
        y = np.zeros(mask.shape, bool)
        for k, (_, lab) in enumerate(chosen):
            y[k, : len(lab)] = lab
        # words of a sample say little about other pages': on most copies they are other words
        for i in np.flatnonzero(rng.random(len(x)) < 0.7):
            x[i, :, _PATH : _PATH + _WORD] = x[i][:, _PATH + rng.permutation(_WORD)]
        x[..., len(_TAGS) + 1 : _PATH] *= rng.random((len(x), 1, 1)) > 0.05  # now and then a page without names
        _, grad = model.gradients(x, mask, y)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1, 2 * (1 - t / (rounds + 1)))
        for k, g in grad.items():
            g = g / max(1, size)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.w[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return model


def fit_from_table(pages: DataFrame, sample_rows: int = 240, sample_bytes: int = 48 << 20, seed: int = 4) -> Labeller:
    """Trains on the pages of smallest hash of page_id; all rows are then read by the model.

    At most ``sample_rows`` pages, of at most ``sample_bytes`` / ``sample_rows`` bytes each,
    come to the driver.  Of a page_id with several pages the smallest is read.
    """
    known = pages.where(F.col("html").isNotNull() & (F.octet_length("html") <= sample_bytes // sample_rows)).select("page_id", "html")
    # about four times the pages wanted pass the test, so a task sends few whatever the number of tasks
    n = pages.count()
    draw = F.pmod(F.xxhash64("page_id", F.lit(seed)), F.lit(1 << 40))
    few = known.where(draw <= int(min(1.0, 4.0 * sample_rows / max(1, n)) * (1 << 40))).groupBy("page_id").agg(F.min("html").alias("html"))
    got = few.orderBy(draw, "page_id").limit(sample_rows).select("html").collect()
    return fit([r[0] for r in got], seed=seed)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every row: the text blocks joined by a blank line.

    A null or empty html, or one without text blocks, gives an empty text.  Repeated rows
    are each a row, equal pages have equal texts, an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # weights of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            blocks = [blocks_of(h or "") for h in part.column(2).to_pylist()]
            marks = shared.value.label(blocks)
            texts = ["\n\n".join(b.text for b, m in zip(bs, ms, strict=True) if m) for bs, ms in zip(blocks, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
