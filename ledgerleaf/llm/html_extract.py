"""Main text of web pages: a bidirectional LSTM in numpy labels every leaf block, with the whole page as context.

A page is cut into leaf blocks: runs of text between block-level tags. Each is described by its path of tags, classes
and ids and by its words, both as sums of hashed vectors that are trained along, and by a few measures such as the share of linked text.
The network reads the sequence both ways and keeps the article's blocks. It is trained here, on pages that page() makes
up in many layouts, with labels known from how they were made.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches, without

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose text is no page text.
SILENT = {"script", "style", "noscript", "template", "title", "textarea", "select", "option", "svg", "iframe", "canvas", "head", "datalist", "video", "audio", "button"}
#: Of these, the ones whose content is not markup.
RAW = {"script", "style", "noscript", "title", "textarea", "iframe"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "br", "wbr", "meta", "link", "object", "math", "mi", "mo", "mn", "ms", "mrow", "mtext", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "mover", "munder", "munderover", "mspace", "mstyle", "semantics"}
#: Silent elements stand within lines: what is before and after them is one block.
INLINE |= SILENT - {"head", "title"}
#: What an opening tag closes if it is the innermost open block.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
SPACES = re.compile(r"\s+")
#: Blocks, with what pads pages to one length, that go through the network at a time.
STEPS = 8192


PATHS, WORDS, MEASURES = 512, 1024, 8
WIDTH = 16
HIDDEN = 16


@lru_cache(maxsize=1 << 16)
def bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


@dataclass(slots=True)
class Block:
    text: str
    #: Buckets of the tags, classes and ids on the way to it, shared with other blocks, and that of the last two.
    path: frozenset[int]
    last: int
    linked: int = 0


@dataclass(slots=True)
class Open:
    """An open element: its tag, what of the path ends with it, and where the run of inline elements that it ends begins."""

    tag: str
    path: frozenset[int]
    ends: tuple[str, ...]
    run: int


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: white space as one space, character references decoded, empty ones left out.

    Time and memory go with the page's length, also where tags are nested or left open by the thousand.
    """
    out: list[Block] = []
    stack: list[Open] = []
    standing: Counter[str] = Counter()
    parts: list[str] = []
    linked = silent = links = 0
    page = page or ""
    nowhere = frozenset()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                path, ends = (stack[-1].path, stack[-1].ends) if stack else (nowhere, ())
                out.append(Block(text, path, bucket(">".join(ends), PATHS), min(linked, len(text))))
            parts.clear()
        linked = 0

    def shut(k: int) -> None:
        nonlocal silent, links
        for x in stack[k:]:
            silent -= x.tag in SILENT
            links -= x.tag == "a"
            standing[x.tag] -= 1
        del stack[k:]

    def opened(tag: str, attributes: str) -> None:
        nonlocal silent, links
        path, ends = (stack[-1].path, stack[-1].ends) if stack else (nowhere, ())
        if tag not in ("html", "body"):
            names = [tag] + [f".{x.lower()}" for n in NAMES.finditer(attributes) for x in re.split(r"[\s_\-]+", n[1] or n[2] or n[3] or "") if x]
            new = {bucket(x, PATHS) for x in names}
            path, ends = path if new <= path else path | new, (*ends, *names)[-2:]
        run = (stack[-1].run if stack and stack[-1].tag in INLINE else len(stack)) if tag in INLINE else len(stack) + 1
        stack.append(Open(tag, path, ends, run))
        standing[tag] += 1
        silent += tag in SILENT
        links += tag == "a"

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE and not silent:
                flush()
            low = stack[-1].run if tag in INLINE - SILENT and stack else 0  # an inline element is closed only if no block stands within it
            for k in range(len(stack) - 1, low - 1, -1) if standing[tag] > 0 else ():
                if stack[k].tag == tag:
                    if silent and tag not in INLINE and not any(x.tag in SILENT for x in stack[:k]):
                        flush()  # it closes the silent element, left open, along with its own
                    shut(k)
                    break
            continue
        if tag in VOID:
            if not silent and (tag == "br" or tag not in INLINE):
                parts.append(" ")
            if tag not in INLINE and not silent:
                flush()
            continue
        if tag not in INLINE and (not silent or tag == "body"):
            flush()
            if tag == "body" and silent:
                shut(0)
            inner = CLOSES.get(tag, {"p"} if tag not in SILENT else set())
            k = len(stack)
            while k:
                if stack[k - 1].tag in INLINE:
                    k = stack[k - 1].run
                elif stack[k - 1].tag in inner:
                    k -= 1
                    shut(k)
                else:
                    break
            if tag == "body":
                shut(0)
        if (m[3] or "").endswith("/") and tag in SILENT:
            continue
        opened(tag, m[3] or "")
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    return out


# ---- features

def features(found: list[Block], lo: int = 0, hi: int | None = None) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Buckets of the path (each element, and the last two together), buckets of the words, and measures of blocks lo to hi of a page."""
    some = found[lo:hi]
    paths, words, measures = [], [], np.zeros((len(some), MEASURES), np.float32)
    for i, b in enumerate(some):
        paths.append(sorted({*b.path, b.last}))
        tokens = b.text.lower().split()
        words.append([bucket(w.strip(".,;:!?()\"'"), WORDS) for w in tokens])
        n, at = len(b.text), lo + i
        measures[i] = [np.log1p(n) / 6, b.linked / n, min(1.0, sum(map(b.text.count, ".!?")) / 5), np.log1p(len(tokens)) / 5, b.text[-1] in ".!?:;\"”»", at / len(found), 1 / (1 + at), 1 / (len(found) - at)]
    return paths, words, measures


# ---- network


@dataclass
class Net:
    path: np.ndarray
    word: np.ndarray
    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.path, self.word, *self.w, *self.u, *self.b, self.v, self.c]


def fresh(seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    size = 2 * WIDTH + MEASURES
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
    return Net(draw(PATHS, WIDTH, scale=0.3), draw(WORDS, WIDTH, scale=0.1), [draw(size, 4 * HIDDEN, scale=0.2) for _ in (0, 1)], [draw(HIDDEN, 4 * HIDDEN, scale=0.2) for _ in (0, 1)], [bias.copy(), bias.copy()], draw(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32))


@dataclass
class Batch:
    """Pages side by side, padded: real says which of steps x pages are blocks. Path and word buckets are flat, with their owners and weights."""

    real: np.ndarray
    path: tuple[np.ndarray, np.ndarray, np.ndarray]
    word: tuple[np.ndarray, np.ndarray, np.ndarray]
    measures: np.ndarray


def batched(pages: list[tuple[list[list[int]], list[list[int]], np.ndarray]], steps: int | None = None) -> Batch:
    steps, n = steps or max(len(p[0]) for p in pages), len(pages)
    real, measures = np.zeros((steps, n), bool), np.zeros((steps, n, MEASURES), np.float32)
    flat: list[tuple[list[int], list[int], list[float]]] = [([], [], []), ([], [], [])]
    for j, (paths, words, m) in enumerate(pages):
        real[: len(paths), j] = True
        measures[: len(paths), j] = m
        for kind, lists in enumerate((paths, words)):
            for i, x in enumerate(lists):
                flat[kind][0].extend(x)
                flat[kind][1].extend([i * n + j] * len(x))
                flat[kind][2].extend([1.0 if kind == 0 else 1 / len(x)] * len(x))
    ready = [(np.array(a, np.int64), np.array(o, np.int64), np.array(w, np.float32)) for a, o, w in flat]
    return Batch(real, *ready, measures)


def summed(table: np.ndarray, flat: tuple, size: int) -> np.ndarray:
    """The weighted sums of table rows by owner."""
    ids, owner, weight = flat
    out = np.zeros((size, table.shape[1]), np.float32)
    if len(ids):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for k in range(0, len(starts), 4096):
            a, b = starts[k], starts[k + 4096] if k + 4096 < len(starts) else len(ids)
            out[owner[starts[k : k + 4096]]] = np.add.reduceat(table[ids[a:b]] * weight[a:b, None], starts[k : k + 4096] - a, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(net: Net, batch: Batch) -> np.ndarray:
    steps, n = batch.real.shape
    return np.concatenate([summed(net.path, batch.path, steps * n), summed(net.word, batch.word, steps * n), batch.measures.reshape(steps * n, -1)], axis=1).reshape(steps, n, -1)


def predicted(net: Net, pages: list[list[Block]], most: int | None = None) -> np.ndarray:
    """steps x pages: the chance that a block is the article's, as forward() gives it, without what training needs.

    Of a page with more than `most` blocks so many are described at a time, in order and again in reverse; only states pass from one part to the next.
    """
    steps, n, most = max(map(len, pages)), len(pages), most or STEPS
    out = np.full((steps, n), net.c[0], np.float32)
    parts = [(k, min(k + most, steps)) for k in range(0, steps, most)]
    x = None
    for way in (0, 1):
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for lo, hi in parts if way == 0 else parts[::-1]:
            if x is None or len(parts) > 1:
                batch = batched([features(p, lo, hi) for p in pages], hi - lo)
                x = inputs(net, batch)
            a, all_real = x @ net.w[way] + net.b[way], batch.real.all(axis=1)
            held = np.empty((hi - lo, n, HIDDEN), np.float32)
            for t in range(hi - lo) if way == 0 else range(hi - lo - 1, -1, -1):
                pre = a[t] + h @ net.u[way]
                g = sigmoid(pre[:, : 3 * HIDDEN])
                cell = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * np.tanh(pre[:, 3 * HIDDEN :])
                after = g[:, 2 * HIDDEN :] * np.tanh(cell)
                if all_real[t]:
                    h, c = after, cell
                else:
                    real = batch.real[t][:, None]
                    h, c = np.where(real, after, h), np.where(real, cell, c)
                held[t] = h
            out[lo:hi] += held @ net.v[way * HIDDEN : (way + 1) * HIDDEN]
    return sigmoid(out)


def forward(net: Net, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    steps, n = batch.real.shape
    x = inputs(net, batch)
    both, trails = np.zeros((steps, n, 2 * HIDDEN), np.float32), []
    for way in (0, 1):
        a = x @ net.w[way] + net.b[way]
        h, c, trail = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            pre = a[t] + h @ net.u[way]
            g = np.concatenate([sigmoid(pre[:, : 3 * HIDDEN]), np.tanh(pre[:, 3 * HIDDEN :])], axis=1)
            real = batch.real[t][:, None]
            i, f, o, z = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN : 3 * HIDDEN], g[:, 3 * HIDDEN :]
            cell = np.where(real, f * c + i * z, c)
            tc = np.tanh(cell)
            after = np.where(real, o * tc, h)
            trail.append((t, h, c, g, tc, real))
            h, c = after, cell
            both[t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
        trails.append(trail)
    return x, both, sigmoid(both @ net.v + net.c), trails


def gradient(net: Net, batch: Batch, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    x, both, p, trails = forward(net, batch)
    steps, n = batch.real.shape
    weight = batch.real / max(1, batch.real.sum())
    loss = -(np.log(np.where(y == 1, p, 1 - p) + 1e-9) * weight).sum()
    d = ((p - y) * weight).astype(np.float32)
    dv, dc = np.tensordot(d, both, ([0, 1], [0, 1])), d.sum(keepdims=True).reshape(1)
    down, dx = d[:, :, None] * net.v, np.zeros_like(x)
    dw, du, db = [], [], []
    for way in (0, 1):
        dh, dcell = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        da, wu = np.zeros((steps, n, 4 * HIDDEN), np.float32), np.zeros_like(net.u[way])
        for t, h, c, g, tc, real in reversed(trails[way]):
            dh = dh + down[t, :, way * HIDDEN : (way + 1) * HIDDEN]
            i, f, o, z = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN : 3 * HIDDEN], g[:, 3 * HIDDEN :]
            dn = dh * o * (1 - tc**2) + dcell
            pre = np.concatenate([dn * z * i * (1 - i), dn * c * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - z**2)], axis=1) * real
            da[t] = pre
            wu += h.T @ pre
            dh = np.where(real, pre @ net.u[way].T, dh)
            dcell = np.where(real, dn * f, dcell)
        dw.append(np.tensordot(x, da, ([0, 1], [0, 1]))), du.append(wu), db.append(da.sum(axis=(0, 1)))
        dx += da @ net.w[way].T
    flat = dx.reshape(steps * n, -1)
    tables = []
    for table, (ids, owner, w), lo in ((net.path, batch.path, 0), (net.word, batch.word, WIDTH)):
        g = np.zeros_like(table)
        np.add.at(g, ids, flat[owner, lo : lo + WIDTH] * w[:, None])
        tables.append(g)
    return float(loss), [*tables, *dw, *du, *db, dv, dc]


# ---- made-up pages

#: Class names that pages give to what is not the article, by kind, and to the article.
CHROME = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "main-menu", "site-nav"],
    "header": ["header", "masthead", "site-header", "banner", "top", "logo"],
    "footer": ["footer", "site-footer", "colophon", "copyright", "bottom", "legal"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "tags", "trending", "right-col"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe"],
    "form": ["search", "login", "signup", "contact-form", "search-box"],
    "comments": ["comments", "comment", "comment-list", "reply", "disqus", "responses"],
    "share": ["share", "social", "sharing", "share-buttons", "follow"],
}
ARTICLE = ["content", "article", "post", "entry-content", "main", "story", "article-body", "post-content", "text", "page-content", "body-text"]
PHRASES = {
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter", "By continuing you agree to our privacy policy."],
    "footer": ["All rights reserved.", "&copy; 2024", "Privacy policy", "Terms of use", "Contact us", "Imprint"],
    "share": ["Share this", "Tweet", "Follow us", "Like", "Email this"],
    "comments": ["Leave a comment", "Reply", "3 comments", "Log in to reply"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Ad"],
    "form": ["Search", "Sign in", "Email", "Submit"],
    "side": ["Related articles", "Read more", "Most popular", "Tags"],
    "header": ["Home", "Skip to content"],
    "menu": ["Home", "About", "Contact", "News"],
}
TAGS = {"menu": ["nav", "nav", "div", "ul", "table"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "ad": ["div", "section", "aside"], "notice": ["div", "section"], "form": ["form", "div"], "comments": ["section", "div"], "share": ["div", "ul"]}


def page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page, and the texts of its article's blocks. Words are made up as well, from a few syllables of the page's own."""
    syllables = ["".join(rng.choice(list("aeiouàéöñßrstlnmdkpgbcht"), int(rng.integers(1, 4)))) for _ in range(24)]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    pick = lambda options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p
    noise = [pick(["", "", "", " |", "###", "***", "&amp;&amp;", "!!"]) for _ in range(3)]

    def sentence(n: int) -> str:
        s = " ".join(word() + (pick(noise) if chance(0.3) else "") + ("," if chance(0.08) else "") for _ in range(max(1, n)))
        return s[:1].upper() + s[1:] + pick([".", ".", ".", "?", "!"])

    article: list[str] = []
    hidden = re.compile(r"<(svg|select|button|script|iframe)\b.*?</\1>")
    plain = lambda s: SPACES.sub(" ", html.unescape(re.sub(r"<[^>]*>", "", hidden.sub("", s.replace("<br>", " "))))).strip()

    def inlined(s: str) -> str:
        bits = s.split(" ")
        for _ in range(int(rng.integers(0, 3))):
            k = int(rng.integers(len(bits)))
            tag = pick(["a", "b", "em", "strong", "i", "span", "code"])
            bits[k] = f'<{tag}{" href=/x" if tag == "a" else ""}>{bits[k]}</{tag}>'
        if chance(0.04):
            silent = pick(["<svg><g><path d='M0'/></g></svg>", f"<select><option>{word()}<option>{word()}</select>", f"<button>{word()}</button>", "<script>x<y</script>", "<iframe src=/x></iframe>"])
            bits.insert(int(rng.integers(len(bits) + 1)), silent)
        return " ".join(bits)

    def kept(tag: str, s: str, close: bool = True) -> str:
        article.append(plain(s))
        return f"<{tag}>{s}" + (f"</{tag}>" if close else "")

    def prose() -> str:
        return " ".join(sentence(int(rng.integers(1, 18))) for _ in range(int(rng.choice([1, 1, 2, 3, 6]))))

    def body() -> str:
        title = sentence(int(rng.integers(2, 12)))
        out = [kept("h1", title if chance(0.8) else title.rstrip(".?!"))] if chance(0.85) else []
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            if r < 0.68:
                out.append(kept("p", inlined(prose())))
            elif r < 0.74:
                out.append(kept("p", "<b>" + (title if chance(0.5) else prose()) + "<br>", close=False))
            elif r < 0.82:
                out.append(kept(pick(["h2", "h3", "h4"]), sentence(int(rng.integers(1, 7))).rstrip(".?!")))
            elif r < 0.9:
                kind = pick(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(kept("li", inlined(sentence(int(rng.integers(1, 12)))), chance(0.8)) for _ in range(int(rng.integers(1, 6)))) + f"</{kind}>")
            elif r < 0.94:
                out.append(kept("blockquote", prose()) if chance(0.5) else "<blockquote>" + kept("p", prose()) + "</blockquote>")
            elif r < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(kept("td", sentence(int(rng.integers(1, 4)))) for _ in range(2)) + "</tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>")
            elif r < 0.985:
                out.append("<figure>" + kept("figcaption", sentence(int(rng.integers(2, 9)))) + "</figure>")
            else:
                out.append("<details>" + kept("summary", sentence(int(rng.integers(2, 9)))) + kept("p", prose()) + "</details>")
            if chance(0.03):
                out.append(chrome(pick(["ad", "share", "side"])))
        return "".join(out)

    def chrome(kind: str) -> str:
        tag = pick(TAGS[kind])
        names = f' {pick(["class", "class", "id"])}="{pick(CHROME[kind])}"' if tag in ("div", "section", "ul", "table") or chance(0.5) else ""
        n = int(rng.integers(1, 8))
        if kind in ("menu", "share") or kind in ("footer", "header", "side") and chance(0.4):
            items = [f'<a href="/{k}">{pick(PHRASES[kind]) if chance(0.3) else word()}</a>' for k in range(n)]
            inner = "".join(f"<li>{x}</li>" for x in items)
            inner = "<tr>" + "".join(f"<td>{x}" for x in items) + "</tr>" if tag == "table" else inner if tag == "ul" else f"<ul>{inner}</ul>" if chance(0.7) else " ".join(items)
        elif kind == "comments":
            inner = (f"<h3>{pick(PHRASES[kind])}</h3>" if chance(0.7) else "") + "".join(f'<{pick(["div", "p"])} class="{pick(CHROME[kind])}">{"<b>" + word() + "</b> " if chance(0.5) else ""}{prose()}</div>' for _ in range(n))
        elif kind == "form":
            inner = f'<label>{pick(PHRASES[kind])}</label><input name=q><select><option>{word()}</option></select><button>{pick(PHRASES[kind])}</button>'
        else:
            texts = [pick(PHRASES[kind]) if chance(0.4) else (("&copy; " if kind == "footer" and chance(0.6) else "") + prose()) for _ in range(int(rng.integers(1, 4)))]
            inner = texts[0] if len(texts) == 1 else "".join(f"<p>{t}</p>" for t in texts)
        return f"<{tag}{names}>{inner}</{tag}>"

    wrap = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), *((f'<div {pick(["class", "id"])}="{pick(ARTICLE)}">', "</div>") for _ in range(3)), ("", ""), ("<div>", "</div>"), ("<section>", "</section>")])
    before = [chrome(k) for k in ("header", "menu", "notice", "ad", "form", "menu") if chance(0.45)]
    between = [chrome(k) for k in ("side",) if chance(0.2)]
    after = [chrome(k) for k in ("share", "comments", "side", "ad", "form", "notice", "footer") if chance(0.4)]
    head = f'<!DOCTYPE html><html lang="{word()}"><head><title>{word()}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    if chance(0.1):
        article.clear()
        return head + "".join(before + after) + "</body></html>", []
    made = body()
    return head + "".join(before) + "".join(between) + wrap[0] + made + wrap[1] + "".join(after) + pick(["", "</body></html>"]), article


def labelled(rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A made-up page's blocks, and which are the article's: its texts in order."""
    while True:
        source, article = page(rng)
        found = blocks(source)
        y, k = np.zeros(len(found)), 0
        for i, b in enumerate(found):
            if k < len(article) and b.text == article[k]:
                y[i], k = 1, k + 1
        if found and k == len(article):
            return found, y


@lru_cache(maxsize=2)
def trained(pages: int = 1200, epochs: int = 16, batch: int = 30, rate: float = 0.01, seed: int = 5) -> Net:
    """The labeller, fitted on made-up pages; the same in every process, and it doesn't depend on the data."""
    rng = np.random.default_rng(seed)
    made = [labelled(rng) for _ in range(pages)]
    ready = sorted(((features(b), y) for b, y in made), key=lambda x: len(x[1]))
    net = fresh(seed)
    groups = [ready[k : k + batch] for k in range(0, len(ready), batch)]
    data = []
    for group in groups:
        b = batched([f for f, _ in group])
        y = np.zeros(b.real.shape, np.float32)
        for j, (_, labels) in enumerate(group):
            y[: len(labels), j] = labels
        data.append((b, y))
    parts = net.parts()
    m, s, step, total = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0, epochs * len(data)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            _, grads = gradient(net, *data[k])
            step += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            now = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, a, b in zip(parts, grads, m, s, strict=True):
                g = g / max(1.0, norm)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (now * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def main_texts(net: Net, pages: list[str | None], together: int = 64) -> list[str]:
    """The kept blocks of each page, joined by newlines. Pages of like length go together, STEPS blocks at a time with what pads them."""
    out = [""] * len(pages)
    found = [blocks(p) for p in pages]
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    k = 0
    while k < len(order):
        size = 1
        while size < together and k + size < len(order) and (size + 1) * len(found[order[k + size]]) <= STEPS:
            size += 1
        at = order[k : k + size]
        p = predicted(net, [found[i] for i in at])
        for j, i in enumerate(at):
            out[i] = "\n".join(b.text for b, x in zip(found[i], p[:, j], strict=False) if x >= 0.5)
        k += size
    return out


def extract(df: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each whole page; null and empty pages, and pages without an article, give ''.

    Blocks that are as likely the article's as not are kept. Pages alike get the same text, so rows repeated do, but for rounding in which pages go through
    the network together. Very long pages go through it alone, in parts, and need memory for their text and blocks only. An empty table gives an
    empty one. A column called like the new one gives way.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(trained())

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            pages, out = batch.to_pylist(), []
            for k in range(0, len(pages), 512):
                out += main_texts(sent.value, pages[k : k + 512])
            yield pa.array(out, pa.string())

    return without(df, text).withColumn(text, extracted(quoted(source).cast("string")))
