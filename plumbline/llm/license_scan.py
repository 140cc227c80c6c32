"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A passage is a run of at most 2 - containment times a template's shingles. Templates of like length share windows. A window is so
long that any such run lies within one; the number of bands follows from the least similarity that the window then has, so that a
passage is missed with a stated probability. Windows start anew in each text and end with it, and what they retrieve is verified by
the best run near them, so the result for a text depends on nothing but the text and the templates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import groups, ship, texts_of
from plumbline.llm.decontaminate import WordHashes, mix


@dataclass(frozen=True)
class Scan:
    """containment: share of a template's shingles that a passage must hold. miss: probability that one isn't retrieved.

    rows of a band is 1: five-word shingles of templates are rare in other texts, so one equal minimum is selective enough, and
    fewer hash functions than with wider bands reach the same probability.
    """

    words: int = 5
    containment: float = 0.8
    miss: float = 1e-3
    rows: int = 1
    ratio: float = 1.25
    seed: int = 5


@dataclass
class Windows:
    """Templates of least to most shingles; windows of span * stride shingles start every stride shingles."""

    least: int
    most: int
    stride: int
    span: int
    bands: int
    keys: list[dict[int, list[int]]]
    filters: list[np.ndarray]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count]
    return mix(h, 41)


class Grid:
    """The windows of one kind over several texts: each text fills whole blocks of stride shingles, windows end with their text."""

    def __init__(self, w: Windows, begins: np.ndarray, sizes: np.ndarray, none: int):
        blocks = -(-sizes // w.stride)
        first = np.cumsum(blocks) - blocks
        self.shape = int(blocks.sum()), w.stride
        self.text = np.repeat(np.arange(len(sizes)), blocks)
        at = np.arange(self.shape[0]) - first[self.text]  # number of a block within its text
        self.starts = at * w.stride
        inside = self.starts[:, None] + np.arange(w.stride)
        self.index = np.where(inside < sizes[self.text][:, None], begins[self.text][:, None] + inside, none).astype(np.int32)
        left = blocks[self.text] - at
        self.short = [np.flatnonzero(left[: max(0, len(left) - k)] <= k) for k in range(1, w.span)]

    def minima(self, hashed: np.ndarray) -> np.ndarray:
        """Least value of each window; the last of hashed stands for no shingle."""
        least = hashed[self.index].min(1)
        out = least.copy()
        for k, short in enumerate(self.short, 1):
            later = least[k:].copy()
            later[short] = hashed[-1]
            np.minimum(out[: len(later)], later, out=out[: len(later)])
        return out


class Library:
    """Bands of all templates."""

    def __init__(self, templates: dict[str, str], s: Scan):
        hashes = WordHashes()
        self.scan, self.names = s, sorted(templates)
        self.shingles = [np.unique(shingles(hashes(templates[n]), s.words)) for n in self.names]
        short = [n for n, x in zip(self.names, self.shingles) if not len(x)]
        if short:
            raise ValueError(f"templates of under {s.words} words: {short}")
        by_size = sorted(range(len(self.names)), key=lambda i: len(self.shingles[i]))
        kinds: list[list[int]] = []
        for i in by_size:
            if kinds and len(self.shingles[i]) <= s.ratio * len(self.shingles[kinds[-1][0]]):
                kinds[-1].append(i)
            else:
                kinds.append([i])
        self.windows = []
        for members in kinds:
            least, most = len(self.shingles[members[0]]), len(self.shingles[members[-1]])
            stride = max(1, least // 4)
            span = -(-(self.longest(most) + stride - 1) // stride)
            alike = s.containment * least / (span * stride + (1 - s.containment) * least)
            bands = max(1, math.ceil(math.log(s.miss) / math.log1p(-min(1 - 1e-9, alike**s.rows))))
            self.windows.append(Windows(least, most, stride, span, bands, [], []))
        count = max((w.bands for w in self.windows), default=0) * s.rows
        self.factors = np.random.default_rng(s.seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for w, members in zip(self.windows, kinds):
            for b in range(w.bands):
                keys: dict[int, list[int]] = {}
                for i in members:
                    sig = [int((self.hashed(self.shingles[i], b * s.rows + r)).min()) for r in range(s.rows)]
                    keys.setdefault(self._join([np.uint64(x) for x in sig]), []).append(i)
                w.keys.append(keys)
                f = np.zeros(1 << 16, bool)
                f[[k >> 48 for k in keys]] = True
                w.filters.append(f)

    def hashed(self, x: np.ndarray, k: int) -> np.ndarray:
        return ((x * self.factors[k]) >> np.uint64(32)).astype(np.uint32)

    def _join(self, parts: list) -> int:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for p in parts:
                h = (h ^ np.uint64(p)) * np.uint64(0x9E3779B97F4A7C15)
        return int(h)

    def longest(self, n: int) -> int:
        """Shingles of the longest passage of a template of n."""
        return math.ceil(n * (2 - self.scan.containment))

    def candidates(self, sh: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, template, first shingle in the text) of windows with an equal band; the last of sh stands for no shingle."""
        out: set[tuple[int, int, int]] = set()
        for w in self.windows:  # one grid at a time: work space for a text is some 40 bytes a word
            g = Grid(w, begins, sizes, len(sh) - 1)
            for band in range(w.bands):
                key = np.zeros(g.shape[0], np.uint64)
                for k in range(band * self.scan.rows, (band + 1) * self.scan.rows):
                    h = self.hashed(sh, k)
                    h[-1] = 0xFFFFFFFF
                    key = (key ^ g.minima(h).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                hit = np.flatnonzero(w.filters[band][(key >> np.uint64(48)).astype(np.int64)])
                for at, x in zip(hit.tolist(), key[hit].tolist()):
                    for i in w.keys[band].get(x, ()):
                        out.add((int(g.text[at]), i, int(g.starts[at])))
        return out

    def best_run(self, i: int, sh: np.ndarray) -> tuple[int, int]:
        """Most different shingles of template i in a run of its longest length within sh, and the place of the first of them."""
        own, longest = self.shingles[i], self.longest(len(self.shingles[i]))
        found = np.searchsorted(own, sh)
        places = np.flatnonzero(own[np.minimum(found, len(own) - 1)] == sh)
        inside: dict[int, int] = {}
        best, where, back = 0, 0, 0
        which = found[places].tolist()
        places = places.tolist()
        for at, x in zip(places, which):
            while places[back] <= at - longest:
                y = which[back]
                inside[y] -= 1
                if not inside[y]:
                    del inside[y]
                back += 1
            inside[x] = inside.get(x, 0) + 1
            if len(inside) > best:
                best, where = len(inside), places[back]
        return best, where

    def search(self, lists: list[np.ndarray], every_window: bool = False) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word of the best passage), once for each text and template that match."""
        n = self.scan.words
        sizes = np.array([max(0, len(w) - n + 1) for w in lists], np.int64)
        if not sizes.sum():
            return []
        sh = np.concatenate([*(shingles(w, n) for w in lists), np.zeros(1, np.uint64)])
        begins = np.cumsum(sizes) - sizes
        span = {i: w.span * w.stride for w in self.windows for i, x in enumerate(self.shingles) if w.least <= len(x) <= w.most}
        out, near = [], sorted(self._all(sizes) if every_window else self.candidates(sh, begins, sizes))
        k = 0
        while k < len(near):
            text, i, first = near[k]
            best = (0, 0)
            while k < len(near) and near[k][:2] == (text, i):  # windows that overlap are verified as one
                a = near[k][2]
                end = a + span[i]
                while k < len(near) and near[k][:2] == (text, i) and near[k][2] <= end:
                    end = near[k][2] + span[i]
                    k += 1
                slack = self.longest(len(self.shingles[i]))
                a, end = max(0, a - slack), min(end + slack, int(sizes[text]))
                share, at = self.best_run(i, sh[begins[text] + a : begins[text] + end])
                if share > best[0]:
                    best = share, a + at
            if best[0] >= self.scan.containment * len(self.shingles[i]):
                out.append((text, i, best[0] / len(self.shingles[i]), best[1]))
        return out

    def _all(self, sizes: np.ndarray) -> list[tuple[int, int, int]]:
        """Every window for every template of its length: what retrieval saves, kept for tests."""
        return [(t, i, a) for w in self.windows for i, x in enumerate(self.shingles) if w.least <= len(x) <= w.most for t, n in enumerate(sizes.tolist()) for a in range(0, n, w.stride)]


def scan_licenses(docs: DataFrame, templates: dict[str, str], scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, license, containment, first_word: every document and template of whose shingles some passage holds enough.

    Words are runs of word characters in lower case; containment (six digits) is the best of the passages found and first_word the place
    of its first shingle of the template, counted in words from 0 (of equal passages the first). Whole texts of any length are scanned;
    null, empty and short ones match nothing, and an empty table gives an empty result. Repeated rows and rows with null ids are each
    reported; extra columns are left behind, whatever their names. Templates of fewer words than a shingle raise ValueError; their
    number bounds what is broadcast. Rows don't depend on how docs is partitioned.
    """
    ship(docs.sparkSession)
    library = docs.sparkSession.sparkContext.broadcast(Library(templates, scan))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), library.value
        for batch in batches:
            for a, z in groups(batch.column(1), 3_000_000):
                found = own.search([hashes(t) for t in texts_of(batch.column(1).slice(a, z - a))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + t for t, *_ in found], pa.int64())), pa.array([own.names[i] for _, i, *_ in found], pa.string()), pa.array([round(s, 6) for *_, s, _ in found], pa.float64()), pa.array([at for *_, at in found], pa.int64())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
