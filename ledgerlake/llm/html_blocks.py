"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks. A bidirectional LSTM in numpy sees of each block the tag path with class and id
words, its hashed words and its shape, and of the page what comes before and after; it says of each block whether it belongs to
the article. It is trained here on a bounded sample of the pages themselves, labelled by the structure some pages have, with furniture
of other kinds mixed in and the tell-tale names of the article varied, so that pages of another build are read too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import chunks, has_columns, map_batches

#: Bound of the training sample: about so many pages, and blocks and about the characters of a page that are used. Pages of any length are sampled.
FIT_PAGES = 1000
FIT_BLOCKS = 400
FIT_CHARS = 60_000
VARIANTS = 2
EPOCHS = 8
HIDDEN = 24
PATH_BUCKETS = 160
WORD_BUCKETS = 48
SHAPE = 6
WIDTH = PATH_BUCKETS + WORD_BUCKETS + SHAPE

# Fixed values of HTML: elements without an end tag, elements whose content is no text, elements that stay within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_ELEMENTS = frozenset("script style template noscript title svg math iframe object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}

_name_words = re.compile(r"[a-z]+").findall
MAIN = frozenset("article main articlebody".split())
MAIN_NAMES = frozenset("article post story entry content maintext body".split())
FURNITURE = frozenset("nav header footer aside form menu button select textarea dialog fieldset".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header menu nav navigation "
    "newsletter notice pagination popup promo promotion related reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)


@dataclass
class Block:
    path: tuple[str, ...]  # tag, or class or id word after a mark, of all open elements; each once, outermost first
    text: str
    linked: float  # share of the characters within links


class BlockParser(HTMLParser):
    """Leaf blocks in page order. Unclosed and stray tags are repaired as far as blocks need it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []  # tag and names of the open elements
        self.open: dict[str, int] = {}  # how many of them have a name
        self.known: tuple[str, ...] | None = ()
        self.parts: list[str] = []
        self.links = self.chars = self.hidden = self.anchors = 0

    @property
    def path(self) -> tuple[str, ...]:
        """Made once for all blocks between two changes, so memory grows with the names and not with the depth."""
        if self.known is None:
            self.known = tuple(self.open)
        return self.known

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.path, text, self.links / max(1, self.chars)))
            self.parts, self.links, self.chars = [], 0, 0

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, names = self.stack.pop()
            if tag in HIDDEN_ELEMENTS:
                self.hidden -= 1
            elif tag == "a":
                self.anchors -= 1
            if tag not in INLINE:
                self.flush()
            for name in names:
                if self.open[name] == 1:
                    del self.open[name]
                    self.known = None
                else:
                    self.open[name] -= 1

    def _close_implied(self, tag: str) -> None:
        if tag not in INLINE:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._pop(i)
                    break
                if self.stack[i][0] not in INLINE:
                    break
        owners = CLOSED_BY_SAME.get(tag)
        if owners:
            same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in same:
                    self._pop(i)
                    break
                if self.stack[i][0] in owners:
                    break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br" or tag not in INLINE:
                self.parts.append(" ")
            if tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
        self._close_implied(tag)
        names = [tag]
        if attrs and tag != "a":
            for name, value in attrs:
                if value and name in ("class", "id", "role", "itemprop"):
                    names += ["." + w for w in _name_words(value.lower())]
        for name in names:
            if name in self.open:
                self.open[name] += 1
            else:
                self.open[name] = 1
                self.known = None
        self.stack.append((tag, tuple(names)))
        if tag in HIDDEN_ELEMENTS:
            self.hidden += 1
        elif tag == "a":
            self.anchors += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "a", "b", "i", "li"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
        if tag not in INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.hidden or not data:
            return
        if not self.parts and not data.strip():
            return
        self.parts.append(data)
        self.chars += len(data)
        if self.anchors:
            self.links += len(data)


def blocks_of(html: str) -> list[Block]:
    parser = BlockParser()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


_bucket_of: dict[str, int] = {}


def _path_bucket(name: str) -> int:
    found = _bucket_of.get(name)
    if found is None:
        if len(_bucket_of) > 100_000:
            _bucket_of.clear()
        found = _bucket_of[name] = crc32(name.encode("utf-8")) % PATH_BUCKETS
    return found


class _WordBuckets(dict):
    """Bucket of a word; the store starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        bucket = self[word] = crc32(word.encode("utf-8")) % WORD_BUCKETS
        return bucket


_word_bucket = _WordBuckets().__getitem__


def features(blocks: list[Block]) -> np.ndarray:
    """Block x WIDTH: path names, hashed words (a unit vector), and length, links, place and end of the block."""
    out = np.zeros((len(blocks), WIDTH), dtype=np.float32)
    for i, block in enumerate(blocks):
        row = out[i]
        for name in block.path:
            row[_path_bucket(name)] = 1.0
        words = block.text.split()
        keys = np.fromiter(map(_word_bucket, words), dtype=np.int64, count=len(words))
        counts = np.bincount(keys, minlength=WORD_BUCKETS)
        row[PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = counts / np.sqrt(counts @ counts)
        row[-SHAPE:] = (
            np.log1p(len(words)) / 4, np.log1p(len(block.text)) / 6, block.linked, (i + 1) / len(blocks), 1.0 if block.text[-1] in ".!?…" else 0.0, 1.0,
        )
    return out


def structure_labels(blocks: list[Block]) -> list[int]:
    """What the structure says of each block: 1 inside an article and no furniture, by tag and by class or id words."""
    names = [set(b.path) for b in blocks]
    has_main = any(n & MAIN for n in names)
    has_named = any({w[1:] for w in n if w[0] == "."} & MAIN_NAMES for n in names)
    labels = []
    for block, tags in zip(blocks, names):
        named = {w[1:] for w in tags if w[0] == "."}
        furniture = bool(tags & FURNITURE or named & FURNITURE_NAMES)
        if has_main:
            inside = bool(tags & MAIN)
        elif has_named:
            inside = bool(named & MAIN_NAMES)
        else:
            inside = "p" in tags and len(block.text.split()) >= 8 and block.linked < 0.3
        labels.append(int(inside and not furniture))
    return labels


# Furniture that is mixed into training pages: path below the body, least and most words, linked or not.
_EXTRA = (
    (("header",), 2, 8, 0.3),
    (("header", ".site", ".header", "h1"), 1, 5, 0.0),
    (("div", ".header", "p"), 2, 12, 0.2),
    (("div", ".menu", "ul", "li", "a"), 1, 3, 1.0),
    (("ul", ".navigation", "li", "a"), 1, 3, 1.0),
    (("aside", "p"), 5, 40, 0.1),
    (("aside", ".sidebar", "h3"), 1, 5, 0.0),
    (("aside", ".sidebar", "ul", "li", "a"), 2, 9, 1.0),
    (("div", ".sidebar", "p"), 4, 40, 0.1),
    (("div", ".cookie", ".notice", "p"), 6, 30, 0.1),
    (("div", ".notice"), 5, 30, 0.0),
    (("div", ".cookie", ".banner"), 5, 30, 0.2),
    (("div", ".ad"), 2, 20, 0.3),
    (("div", ".ads", "p"), 2, 20, 0.3),
    (("div", ".advert", "p"), 2, 20, 0.3),
    (("div", ".sponsored", "a"), 2, 12, 1.0),
    (("div", ".promo", "p"), 3, 20, 0.2),
    (("form", "label"), 1, 6, 0.0),
    (("form", "p"), 2, 12, 0.0),
    (("form", "button"), 1, 3, 0.0),
    (("form", "select", "option"), 1, 3, 0.0),
    (("form", ".newsletter", "div"), 2, 12, 0.0),
    (("section", ".comments", "h2"), 1, 4, 0.0),
    (("section", ".comments", "div", ".comment", "p"), 3, 60, 0.0),
    (("div", ".comments", "div", ".comment", "p"), 3, 60, 0.0),
    (("div", ".comment"), 3, 50, 0.0),
    (("ul", ".comments", "li", "p"), 3, 50, 0.0),
    (("ol", ".commentlist", ".comment", "li", "p"), 3, 50, 0.0),
    (("div", ".related", "ul", "li", "a"), 2, 9, 1.0),
    (("div", ".share", "a"), 1, 2, 1.0),
    (("div", ".footer", "p"), 3, 25, 0.2),
    (("footer", "ul", "li", "a"), 1, 4, 1.0),
    (("nav", "a"), 1, 3, 1.0),
    (("nav", ".breadcrumb", "a"), 1, 3, 1.0),
)
#: What may stand where the sample has its article element.
_ARTICLE = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post", ".body"), ("div", ".article"), ("section", ".story"), ("div", ".entry", ".content"), ("div",))
#: What may stand where an article of the sample has a paragraph.
_PARAGRAPH = (("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("pre",), ("figure", "figcaption"), ("table", "tr", "td"), ("div",), ("section", "p"), ("dl", "dd"))


def varied(blocks: list[Block], labels: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A training variant: the article element and some paragraphs renamed, furniture of random kinds put in at random places."""
    name = _ARTICLE[rng.integers(len(_ARTICLE))]
    words = " ".join(b.text for b in blocks).split()[:3000] or ["a"]
    out = []
    for block, label in zip(blocks, labels):
        path = _renamed(block.path, name)
        if label and path[-1] == "p" and rng.random() < 0.15:
            path = (*path[:-1], *_PARAGRAPH[rng.integers(len(_PARAGRAPH))])
            if path[-1] in ("li", "h2", "h3", "td", "dd", "figcaption"):  # short, and items come in a row
                parts = block.text.split()
                for _ in range(rng.integers(1, 5) if path[-1] in ("li", "td", "dd") else 1):
                    at = int(rng.integers(len(parts)))
                    out.append((Block(path, " ".join(parts[at : at + int(rng.integers(2, 15))]), 0.0), label))
                continue
        out.append((Block(path, block.text, block.linked), label))
    inside = [i for i, (_, y) in enumerate(out) if y]
    for _ in range(rng.integers(1, 6)):
        path, low, high, linked = _EXTRA[rng.integers(len(_EXTRA))]
        at = int(rng.integers(len(out) + 1))
        within = bool(inside) and inside[0] < at <= inside[-1] and len(out) > at and out[at][1]
        outer = ("html", "body", *name) if within or rng.random() < 0.15 else ("html", "body")
        for _ in range(rng.integers(1, 5)):
            first, count = int(rng.integers(len(words))), int(rng.integers(low, high + 1))
            text = " ".join((words[first:] + words)[:count])
            out.insert(at, (Block((*outer, *path), text, linked), 0))
    return [b for b, _ in out], [y for _, y in out]


def _renamed(path: tuple[str, ...], name: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(n for p in path for n in (name if p == "article" else (p,)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-30, 30)))


class Direction:
    """One LSTM over padded sequences (batch x time x width); a step outside a sequence keeps the state at zero."""

    def __init__(self, parameters: dict[str, np.ndarray], name: str):
        self.w, self.u, self.b = (parameters[f"{name}_{k}"] for k in "wub")

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        batch, time, _ = x.shape
        gates_in = x @ self.w + self.b
        h = np.zeros((batch, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        out, steps = np.zeros((batch, time, HIDDEN), dtype=np.float32), []
        for t in range(time):
            z = gates_in[:, t] + h @ self.u
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            before_h, before_c = h, c
            c = (f * c + i * g) * m
            squashed = np.tanh(c)
            h = o * squashed * m
            out[:, t] = h
            if keep:
                steps.append((i, f, o, g, squashed, before_h, before_c, m))
        return (out, steps) if keep else out

    def backward(self, x: np.ndarray, steps: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        d_h, d_c = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
        d_z = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        d_u = np.zeros_like(self.u)
        for t in range(len(steps) - 1, -1, -1):
            i, f, o, g, squashed, before_h, before_c, m = steps[t]
            d_h = (d_h + d_out[:, t]) * m
            d_c = (d_c + d_h * o * (1 - squashed**2)) * m
            d = np.concatenate((d_c * g * i * (1 - i), d_c * before_c * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g**2)), axis=1)
            d_z[:, t] = d
            d_u += before_h.T @ d
            d_h = d @ self.u.T
            d_c = d_c * f
        flat = d_z.reshape(-1, 4 * HIDDEN)
        return {"w": x.reshape(-1, x.shape[2]).T @ flat, "u": d_u, "b": flat.sum(axis=0)}


class BlockLabeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 3):
        if parameters is None:
            rng = np.random.default_rng(seed)
            draw = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
            parameters = {"out": draw(2 * HIDDEN), "bias": np.zeros(1, dtype=np.float32)}
            for d in ("ahead", "back"):
                start = np.zeros(4 * HIDDEN, dtype=np.float32)
                start[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
                parameters |= {f"{d}_w": draw(WIDTH, 4 * HIDDEN), f"{d}_u": draw(HIDDEN, 4 * HIDDEN), f"{d}_b": start}
        self.p = parameters

    @staticmethod
    def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        time = max(map(len, sequences))
        x = np.zeros((len(sequences), time, WIDTH), dtype=np.float32)
        mask = np.zeros((len(sequences), time), dtype=np.float32)
        for i, s in enumerate(sequences):
            x[i, : len(s)], mask[i, : len(s)] = s, 1
        return x, mask

    def probabilities(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Of every block of every sequence; sequences of like length share a batch, a very long one stands alone."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < 128 and (end - start + 1) * len(sequences[order[end]]) <= 16_384:
                end += 1
            x, mask = self.padded([sequences[i] for i in order[start:end]])
            ahead = Direction(self.p, "ahead").forward(x, mask)
            back = Direction(self.p, "back").forward(x[:, ::-1], mask[:, ::-1])[:, ::-1]
            said = _sigmoid(ahead @ self.p["out"][:HIDDEN] + back @ self.p["out"][HIDDEN:] + self.p["bias"])
            for row, i in enumerate(order[start:end]):
                out[i] = said[row, : len(sequences[i])]
            start = end
        return out

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 32) -> BlockLabeller:
        """Cross-entropy by backpropagation through time and Adam, at a falling rate; the order of batches is fixed by a seed."""
        rng = np.random.default_rng(17)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.argsort([len(s) for s in sequences], kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        step, steps = 0, epochs * len(groups)
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                step += 1
                rows = groups[g]
                x, mask = self.padded([sequences[i] for i in rows])
                y = np.zeros_like(mask)
                for r, i in enumerate(rows):
                    y[r, : len(labels[i])] = labels[i]
                gradient = self._gradient(x, mask, y)
                for k, v in gradient.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    rate = 0.01 * (1 - 0.95 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.p[k] = (self.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self

    def _gradient(self, x, mask, y) -> dict[str, np.ndarray]:
        backwards = np.ascontiguousarray(x[:, ::-1])
        one, two = Direction(self.p, "ahead"), Direction(self.p, "back")
        ahead, ahead_steps = one.forward(x, mask, keep=True)
        back, back_steps = two.forward(backwards, np.ascontiguousarray(mask[:, ::-1]), keep=True)
        both = np.concatenate((ahead, back[:, ::-1]), axis=2)
        said = _sigmoid(both @ self.p["out"] + self.p["bias"])
        d = (said - y) * mask / mask.sum()
        d_both = d[:, :, None] * self.p["out"]
        gradient = {"out": np.einsum("bt,bth->h", d, both), "bias": np.array([d.sum()], dtype=np.float32)}
        for name, direction, inputs, steps, part in (
            ("ahead", one, x, ahead_steps, d_both[:, :, :HIDDEN]), ("back", two, backwards, back_steps, d_both[:, ::-1, HIDDEN:]),
        ):
            gradient |= {f"{name}_{k}": v for k, v in direction.backward(inputs, steps, part).items()}
        norm = float(np.sqrt(sum((v * v).sum() for v in gradient.values())))
        return {k: v * min(1.0, 5.0 / (norm + 1e-9)) for k, v in gradient.items()}


def train_labeller(pages: list[str | tuple[list[Block], list[int]]]) -> BlockLabeller:
    """From sample pages, html or blocks with labels: each as it is and in variants. At least 400 sequences, by more variants of few pages.

    Raises an error if no page has a block, as there is nothing to learn from.
    """
    rng = np.random.default_rng(23)
    parsed = [p for p in (labelled(p) if isinstance(p, str) else p for p in pages) if p[0]]
    if not parsed:
        raise ValueError("no sample page has a block; the labeller cannot be trained")
    sequences, labels = [], []
    variants = max(VARIANTS, -(-400 // len(parsed)))
    for blocks, told in parsed:
        for n in range(variants + 1):
            some, said = varied(blocks, told, rng) if n else (blocks, told)
            sequences.append(features(some))
            labels.append(np.array(said, dtype=np.float32))
    return BlockLabeller().fit(sequences, labels)


def labelled(html: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page and what its structure says of each."""
    blocks = blocks_of(html)
    return blocks, structure_labels(blocks)


def shortened(blocks: list[Block], labels: list[int]) -> tuple[list[Block], list[int]]:
    """At most ``FIT_BLOCKS`` blocks with about ``FIT_CHARS`` characters: long runs of one label lose their middle, long texts their rest."""
    if len(blocks) > FIT_BLOCKS:
        edges = [0, *(i for i in range(1, len(labels)) if labels[i] != labels[i - 1]), len(labels)]
        side = max(1, FIT_BLOCKS // (2 * (len(edges) - 1)))
        keep = [i for a, b in zip(edges, edges[1:]) for i in range(a, b) if i < a + side or i >= b - side][:FIT_BLOCKS]
        blocks, labels = [blocks[i] for i in keep], [labels[i] for i in keep]
    if sum(len(b.text) for b in blocks) > FIT_CHARS:
        most = FIT_CHARS // len(blocks)
        blocks = [b if len(b.text) <= most else Block(b.path, b.text[: most - 1] + b.text[-1], b.linked) for b in blocks]
    return blocks, labels


def sample_pages(df: DataFrame, html: str) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of about ``FIT_PAGES`` distinct pages of any length, chosen by a hash of their html.

    Tasks parse the sampled pages; of each only a bounded part (:func:`shortened`) reaches the driver.
    """
    fit = df.select(F.col(f"`{html}`").alias("html")).where(F.length("html") > 0).withColumn("h", F.xxhash64("html"))
    every = max(1, fit.agg(F.approx_count_distinct("h", 0.02)).first()[0] // FIT_PAGES)
    rows = fit.select("h").where(F.pmod("h", F.lit(every)) == 0).distinct().orderBy("h").limit(2 * FIT_PAGES).collect()
    chosen = [r["h"] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch, pages in chunks(batches, "html"):
            for key, page in zip(batch.column(1).to_pylist(), pages):
                if key not in seen:
                    seen.add(key)
                    made = json.dumps([(b.path, b.text, b.linked, said) for b, said in zip(*shortened(*labelled(page)))])
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([made], pa.string())], names=["h", "page"])

    made = map_batches(fit.where(F.col("h").isin(chosen)), run, "h long, page string").dropDuplicates(["h"]).collect() if chosen else []
    pages = [json.loads(r["page"]) for r in sorted(made, key=lambda r: r["h"])]
    return [([Block(tuple(path), text, linked) for path, text, linked, _ in page], [said for *_, said in page]) for page in pages]


def extract_main_text(df: DataFrame, html: str = "html", labeller: BlockLabeller | None = None) -> DataFrame:
    """All columns of ``df`` but the html, with ``text`` and ``n_chars``; columns of these names are replaced.

    Each page is read whole and alone, nothing is shuffled. Blocks of the article are joined by line ends. Null and empty html and pages
    without an article give the empty text. Repeated rows stay; an empty table gives an empty result. Without a given labeller one is
    trained on a bounded sample of the pages; if none of these has a block and a page has, an error is raised.
    """
    has_columns(df, html)
    pages = [] if labeller else sample_pages(df, html)
    model = labeller or (train_labeller(pages) if any(blocks for blocks, _ in pages) else None)
    shared = df.sparkSession.sparkContext.broadcast(model.p if model else None)
    kept = [f for f in df.schema.fields if f.name != html and f.name.lower() not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BlockLabeller(shared.value) if shared.value else None
        for batch, pages in chunks(batches, "_html"):
            texts = []
            for i in range(0, len(pages), 256):
                parsed = [blocks_of(p) if p else [] for p in pages[i : i + 256]]
                if model is None:
                    if any(parsed):
                        raise ValueError("no sample page has a block; the labeller cannot be trained")
                    texts.extend("" for _ in parsed)
                    continue
                for blocks, said in zip(parsed, model.probabilities([features(b) for b in parsed])):
                    texts.append("\n".join(b.text for b, p in zip(blocks, said.tolist()) if p > 0.5))
            columns = [batch.column(n) for n in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=names)

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])
    names = [f"c{i}" for i in range(len(kept))] + ["text", "n_chars"]
    plain = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{html}`").alias("_html"))
    inner = StructType([StructField(n, f.dataType, True) for n, f in zip(names, schema.fields)])
    made = map_batches(plain, run, inner)
    return made.select(*[F.col(n).alias(f.name) for n, f in zip(names, schema.fields)])
