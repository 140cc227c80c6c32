"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A walk over words repeats or advances at each step by a random bit of the word it stands on; so edits between two texts
become few differing steps. Windows as long as the items, started at a stride, and the items' own suffixes from every place
that a window may start at are embedded by the same walks. Sampled steps form keys; equal keys are verified by exact edit distance.

A long item is retrieved by any of its segments: of equal segments one has no more than its share of the edits, so every item is
searched for as a short one is. Items so short that no edit is allowed are looked up by the hash of all their words.
Windows start anew in each text and end with it, so what is found in a text depends on nothing but the text and the items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import groups, keep_rows, ship, texts_of

#: Windows that are embedded at once, which bounds the work space for long texts.
WINDOWS = 1 << 20


@dataclass(frozen=True)
class Search:
    """error: edits (of words) allowed for each word of an item. walks * tables keys of `sample` steps are tried for each window.

    segment: words of the longest item that is searched for in one; longer ones are cut into equal segments.
    """

    error: float = 0.1
    walks: int = 2
    tables: int = 3
    sample: int = 5
    segment: int = 60
    ratio: float = 1.5  # of the longest to the shortest item that share windows
    block: int = 20_000  # items searched for at once; more are searched in several passes
    seed: int = 11


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class WordHashes:
    """Lower-case words, runs of word characters, as 64-bit hashes; vectorised over a whole text."""

    PIECE = 1 << 20
    letters: np.ndarray | None = None
    base = 0x9E3779B97F4A7C15
    powers = inverse = np.ones(1, np.uint64)

    def __init__(self) -> None:
        if WordHashes.letters is None:
            every = np.zeros(0x110000, bool)
            every[[m.start() for m in re.finditer(r"\w", "".join(map(chr, range(0x110000))))]] = True
            WordHashes.letters = every

    def _grow(self, n: int) -> None:
        if len(WordHashes.powers) < n:
            size = max(n, 1 << 17)
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                setattr(WordHashes, name, np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]), dtype=np.uint64))

    def _pieces(self, low: str) -> Iterator[tuple[int, np.ndarray]]:
        """Place and code points of the pieces of a text, which are cut between words and hold about PIECE characters."""
        at = 0
        while at < len(low):
            end = min(at + self.PIECE, len(low))
            while end < len(low) and self.letters[ord(low[end - 1])] and self.letters[ord(low[end])]:
                end += 1
            yield at, np.frombuffer(low[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
            at = end

    def _hashed(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = np.zeros(len(codes) + 2, np.int8)
        word[1:-1] = self.letters[codes]
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        self._grow(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint32(1)) * self.powers[: len(codes)], dtype=np.uint64, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts], 77), starts, ends

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end (in characters of text.lower()) of each word."""
        parts = [(h, at + a, at + b) for at, codes in self._pieces(text.lower()) for h, a, b in [self._hashed(codes)]]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), none, none)

    def __call__(self, text: str) -> np.ndarray:
        """The hashes alone: eight bytes a word, and the work space of one piece, are held of a text."""
        parts = [self._hashed(codes)[0] for _, codes in self._pieces(text.lower())]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


@dataclass
class Class:
    """Segments of at least least and under ratio * least words: windows start every stride words and walk steps steps."""

    least: int
    stride: int
    offsets: int
    steps: int
    picks: np.ndarray  # walks x tables x sample: the sampled steps, ascending
    keys: list  # of each walk and table: sorted keys
    owner: list  # of each walk and table: item and offset of each key
    filters: list


def _mixed(x: np.ndarray, walk: int, steps: int, seed: int) -> list[np.ndarray]:
    return [mix(x, (seed * 1000003 + walk * 8191 + b * 131071 + 1) * 0x9E3779B97F4A7C15 % 2**64) for b in range(-(-steps // 64))]


def embed_keys(x: np.ndarray, starts: np.ndarray, walk: int, c: Class, seed: int) -> list[np.ndarray]:
    """For each table the key of each start: x is padded with enough zeros to end on."""
    bits, at = _mixed(x, walk, c.steps, seed), starts.copy()
    keys = [np.zeros(len(starts), np.uint64) for _ in range(len(c.picks[walk]))]
    for j in range(int(c.picks[walk].max()) + 1):
        for t, picked in enumerate(c.picks[walk]):
            if j in picked:
                with np.errstate(over="ignore"):
                    keys[t] = (keys[t] ^ x[at]) * np.uint64(0x9E3779B97F4A7C15)
                    keys[t] ^= keys[t] >> np.uint64(31)
        at += (bits[j // 64][at] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int32)
    return keys


def padded(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([x, np.zeros(n, np.uint64)])


def _runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low up to its high, one run after another."""
    n = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


class Index:
    """Keys of all items of a block."""

    def __init__(self, items: list[tuple[object, str]], s: Search):
        self.search = s
        hashes = WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [hashes(t) for _, t in items]
        rng = np.random.default_rng(s.seed)
        by_class: dict[int, list[tuple[int, int]]] = {}  # item and first word of each segment
        exact: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if not int(s.error * len(w)):
                exact.setdefault(len(w), []).append(i)
                continue
            count = -(-len(w) // s.segment)
            least = 1
            while (up := max(least + 1, int(least * s.ratio))) <= len(w) // count:
                least = up
            by_class.setdefault(least, []).extend((i, len(w) * k // count) for k in range(count))
        exact.pop(0, None)
        self.exact = []
        for n, members in sorted(exact.items()):
            k = np.array([self._whole(self.words[i], n)[0] for i in members], np.uint64)
            order = np.argsort(k, kind="stable")
            self.exact.append((n, k[order], np.array(members, np.int64)[order]))
        self.classes = []
        for least, members in sorted(by_class.items()):
            stride = max(1, least // 6)
            offsets = max(stride, min(3 * stride, max(1, least // 2)))
            steps = max(1, (least - offsets + 1) * 3 // 2)
            edges = np.linspace(0, steps, s.sample + 1)
            picks = np.floor(edges[:-1] + (edges[1:] - edges[:-1]) * rng.random((s.walks, s.tables, s.sample))).astype(np.int64)  # one step of each part of the walk
            c = Class(least, stride, offsets, steps, picks, [], [], [])
            for walk in range(s.walks):
                found: list[list] = [[] for _ in range(s.tables)]
                place = []
                for i, first in members:
                    starts = np.arange(first, first + min(offsets, len(self.words[i]) - first), dtype=np.int32)
                    for t, k in enumerate(embed_keys(padded(self.words[i], steps), starts, walk, c, s.seed)):
                        found[t].append(k)
                    place += [(i, int(o)) for o in starts]
                where = np.array(place, np.int64)
                c.keys.append([])
                c.owner.append([])
                c.filters.append([])
                for t in range(s.tables):
                    k = np.concatenate(found[t])
                    order = np.argsort(k, kind="stable")
                    c.keys[walk].append(k[order])
                    c.owner[walk].append(where[order])
                    f = np.zeros(1 << 18, bool)
                    f[(k >> np.uint64(46)).astype(np.int64)] = True
                    c.filters[walk].append(f)
            self.classes.append(c)
        self.reach = max([c.steps for c in self.classes] + [n for n, *_ in self.exact], default=0)
        self.patterns = [None] * len(self.words)

    @staticmethod
    def _whole(x: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each place of x that has so many."""
        h = np.zeros(max(0, len(x) - n + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n if len(h) else 0):
                h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(h)]
        return mix(h, 23)

    def candidates(self, x: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of text, item and place in x of its first word, ascending, for all windows of the texts that x holds with zeros between."""
        found = [np.zeros((0, 3), np.int64)]

        def take(starts: np.ndarray, text: np.ndarray, known: np.ndarray, owner: np.ndarray, key: np.ndarray) -> None:
            low, high = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
            hit = low < high
            if hit.any():
                n, own = (high - low)[hit], owner[_runs(low[hit], high[hit])]
                found.append(np.stack([np.repeat(text[hit], n), own[:, 0], np.repeat(starts[hit], n) - own[:, 1]], 1))

        for n, known, members in self.exact:
            for at in range(0, len(x), WINDOWS):
                key = self._whole(x[at : at + WINDOWS + n - 1], n)
                starts = np.flatnonzero(np.isin(key, known)) + at
                text = np.searchsorted(begins, starts, "right") - 1
                inside = starts + n <= begins[text] + sizes[text]
                take(starts[inside], text[inside], known, np.stack([members, np.zeros(len(members), np.int64)], 1), key[starts[inside] - at])
        for c in self.classes:
            n = -(-sizes // c.stride)
            every, texts = (np.repeat(begins - np.concatenate([[0], np.cumsum(n)[:-1]]) * c.stride, n) + np.arange(int(n.sum())) * c.stride).astype(np.int32), np.repeat(np.arange(len(n)), n)
            for at in range(0, len(every), WINDOWS):
                starts, text = every[at : at + WINDOWS], texts[at : at + WINDOWS]
                a, b = int(starts[0]), int(starts[-1]) + c.steps + 1
                for walk in range(self.search.walks):
                    for t, key in enumerate(embed_keys(x[a:b], starts - np.int32(a), walk, c, self.search.seed)):
                        maybe = np.flatnonzero(c.filters[walk][t][(key >> np.uint64(46)).astype(np.int64)])
                        if len(maybe):
                            take(starts[maybe], text[maybe], c.keys[walk][t], c.owner[walk][t], key[maybe])
        return np.unique(np.concatenate(found), axis=0)

    def distance(self, item: int, region: np.ndarray) -> int:
        """Least edits of words between the item and any stretch of region: bit-parallel, exact."""
        if self.patterns[item] is None:
            masks: dict[int, int] = {}
            for i, w in enumerate(self.words[item].tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.patterns[item] = masks
        masks, m = self.patterns[item], len(self.words[item])
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        best = m
        for w in region.tolist():
            eq = masks.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph = ph << 1 & full
            pv = (mh << 1 | ~(xv | ph)) & full
            mv = ph & xv
            best = min(best, score)
        return best

    def search_texts(self, lists: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, item, distance) of every verified pair, each once with its least distance.

        The places where an item may stand in a text are widened by the edits that are allowed; those that overlap are verified as one.
        """
        sizes = np.array([len(w) for w in lists], np.int64)
        if not sizes.sum() or not self.reach:
            return []
        begins = np.cumsum(sizes + self.reach) - sizes - self.reach
        gap = np.zeros(self.reach, np.uint64)
        x = np.concatenate([part for w in lists for part in (w, gap)])
        found: dict[tuple[int, int], int] = {}
        rows = self.candidates(x, begins, sizes).tolist()
        at = 0
        while at < len(rows):
            text, item, first = rows[at]
            n = len(self.words[item])
            allowed = int(self.search.error * n)
            at, end = at + 1, first + n + allowed + 1
            while at < len(rows) and rows[at][:2] == [text, item] and rows[at][2] - allowed <= end:
                end = rows[at][2] + n + allowed + 1
                at += 1
            a, b = max(first - allowed, int(begins[text])), min(end, int(begins[text] + sizes[text]))
            if b - a >= n - allowed:
                d = self.distance(item, x[a:b])
                if d <= allowed and d < found.get((text, item), allowed + 1):
                    found[text, item] = d
        return [(t, i, d) for (t, i), d in sorted(found.items())]


def item_blocks(items: DataFrame, search: Search, item_col: str, item_text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items that have a text, in blocks of about search.block; one empty block if there are none."""
    source = items.select(F.col(item_col), F.col(item_text_col).cast("string").alias("t")).where("t <> ''")
    blocks = max(1, -(-source.count() // search.block))
    for b in range(blocks):
        mine = source.where(F.pmod(F.xxhash64("t", item_col), F.lit(blocks)) == b) if blocks > 1 else source
        yield sorted(((r[0], r[1]) for r in mine.collect()), key=lambda r: (r[0] is None, str(r[0]), r[1]))


def _without_leaks(index) -> Callable[[list[str]], list[bool]]:
    hashes, own = WordHashes(), index.value

    def work(texts: list[str]) -> list[bool]:
        leaking = {t for t, _, _ in own.search_texts([hashes(t) for t in texts])}
        return [i not in leaking for i in range(len(texts))]

    return work


def reject_leaks(docs: DataFrame, items: DataFrame, search: Search = Search(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found (see find_leaks); one pass for each block of items."""
    for rows in item_blocks(items, search, item_col, item_text_col):
        docs = keep_rows(docs, text_col, partial(_without_leaks, docs.sparkSession.sparkContext.broadcast(Index(rows, search))), 3_000_000)
    return docs


def find_leaks(docs: DataFrame, items: DataFrame, search: Search = Search(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, item_col, distance, item_words: each document and item of which it holds a passage within error edits a word.

    Words are runs of word characters in lower case. distance is the least number of edits among the passages found. Items
    without words match nothing; null texts are empty; an empty table of either kind gives an empty result. Repeated rows of docs, null
    ids among them, are reported each; equal items too, so there are no ties to break. The items are read in blocks of a fixed size,
    each broadcast and searched for in all windows of all documents; no document is cut short, and of a long text about 30
    bytes a word are held. Other columns are left behind, whatever their names. Rows don't depend on how docs is partitioned.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item", T.IntegerType()), T.StructField("distance", T.IntegerType()), T.StructField("item_words", T.IntegerType())])
    out = None
    for rows in item_blocks(items, search, item_col, item_text_col):
        index = spark.sparkContext.broadcast(Index(rows, search))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hashes, own = WordHashes(), index.value
            for batch in batches:
                for a, z in groups(batch.column(1), 3_000_000):
                    found = own.search_texts([hashes(t) for t in texts_of(batch.column(1).slice(a, z - a))])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + t for t, _, _ in found], pa.int64())), pa.array([i for _, i, _ in found], pa.int32()), pa.array([d for _, _, d in found], pa.int32()), pa.array([len(own.words[i]) for _, i, _ in found], pa.int32())], names=schema.names)

        hits = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_col, items.schema[item_col].dataType)]))
        part = hits.join(F.broadcast(names), "item").select(id_col, item_col, "distance", "item_words")
        out = part if out is None else out.unionByName(part)
    return out
