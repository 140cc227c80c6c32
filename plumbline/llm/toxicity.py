"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy.

A word is the bag of its character n-grams and itself, hashed to buckets. A stretch of text is the mean over the bags of its
distinct words and a fixed number of zero vectors, which keeps short texts from extremes; a document is the mean over its
stretches. An unseen misspelling shares most n-grams with the word it comes from, hence most of its vector.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import keep_rows, map_texts, release, ship, spool

WORD = re.compile(r"[^\W_]+")
MEMO_ENTRIES = 300_000


@dataclass(frozen=True)
class Settings:
    """Everything that fixes the model. sample and sample_bytes bound the labelled rows it is fitted on; scoring has no bound.

    A text of over longest bytes is left out of the fit alone.
    """

    sample: int = 6_000
    sample_bytes: int = 64 << 20
    longest: int = 1 << 20
    buckets: int = 1 << 18
    dims: int = 4
    low: int = 3
    high: int = 5
    least: int = 4  # documents of the sample that a bucket must be in to be trained; others stay zero
    pad: int = 300  # zero vectors in each mean
    stretch: int = 200  # words of a stretch, about
    epochs: int = 12
    batch: int = 32
    weight: float = 3.0  # of a toxic document against a clean one
    rate: float = 4.0
    seed: int = 7


def subwords(found: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram of <word> and of every whole word."""
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 2
    codes = np.frombuffer("".join([f"<{w}>" for w in found]).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.repeat(np.arange(len(found), dtype=np.int32), lengths)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the word's end
    buckets, numbers = [], []
    h = np.full(len(codes), 2166136261, np.uint32)
    for n in range(1, s.high + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(16777619)
        if n >= s.low:
            whole = np.flatnonzero(left[: len(h)] >= n)
            x = h[whole] * np.uint32(2654435769 + 2 * n)
            buckets.append((x ^ x >> np.uint32(15)) & np.uint32(s.buckets - 1))
            numbers.append(number[whole])
    if len(found):
        place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
        power = np.cumprod(np.concatenate([[1], np.full(int(lengths.max()), 31)]).astype(np.uint32), dtype=np.uint32)
        x = np.add.reduceat(codes * power[place], ends - lengths, dtype=np.uint32) * np.uint32(2654435769)
        buckets.append((x ^ x >> np.uint32(13)) & np.uint32(s.buckets - 1))
        numbers.append(np.arange(len(found), dtype=np.int32))
    return (np.concatenate(buckets).astype(np.int32), np.concatenate(numbers)) if buckets else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def gram_count(length: int, s: Settings) -> int:
    return 1 + sum(max(0, length + 3 - n) for n in range(s.low, s.high + 1))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def stretches(text: str, s: Settings) -> list[set[str]]:
    """The distinct words of each of the equal parts of a text; none for a wordless one."""
    found = words(text)
    n = -(-len(found) // s.stretch)
    return [set(found[len(found) * k // n : len(found) * (k + 1) // n]) for k in range(n)]


@dataclass
class Model:
    """After training only the score of each bucket matters: embedding times the difference of the two output rows."""

    settings: Settings
    bucket_score: np.ndarray
    bias: float
    base: float  # share of toxic documents in the fit

    def word_scores(self, found: list[str]) -> list[float]:
        ids, number = subwords(found, self.settings)
        return np.bincount(number, self.bucket_score[ids].astype(np.float64), len(found)).tolist() if found else []


def _batch(bags: list, chosen: np.ndarray) -> tuple:
    """Flat arrays of a batch, with the order that brings equal buckets together; the same in every epoch."""
    sizes = np.array([len(bags[i][0]) for i in chosen])
    ids = np.concatenate([bags[i][0] for i in chosen])
    weight = np.concatenate([bags[i][1] for i in chosen])
    for i in chosen:
        bags[i] = None  # each is in one batch only
    filled = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[filled]
    by = np.argsort(ids, kind="stable").astype(np.int32)
    heads = np.flatnonzero(np.diff(ids[by], prepend=-1)).astype(np.int32)
    return chosen, filled, starts, ids, weight, np.repeat(np.arange(len(chosen), dtype=np.int16), sizes), by, heads, ids[by][heads]


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    """Stochastic gradient descent over document batches; embeddings and softmax learn jointly with per-row step sizes."""
    rng = np.random.default_rng(s.seed)
    bags = []
    for t in texts:
        parts = stretches(t, s)
        every = sorted(set().union(*parts))
        flat, number = subwords(every, s)
        weight = np.zeros(len(every))
        at = {w: i for i, w in enumerate(every)}
        for part in parts:
            share = 1 / (len(parts) * (sum(gram_count(len(w), s) for w in part) + s.pad))
            weight[[at[w] for w in part]] += share
        ids, back = np.unique(flat, return_inverse=True)
        bags.append((ids.astype(np.int32), np.bincount(back, weight[number], len(ids)).astype(np.float32)))
    seen = np.zeros(s.buckets, np.int32)
    for ids, _ in bags:
        seen[ids] += 1
    kept = seen >= s.least
    for i, (ids, w) in enumerate(bags):
        bags[i] = ids[kept[ids]], w[kept[ids]]
    y = np.array(labels, np.int64)
    cost = np.where(y == 1, s.weight, 1).astype(np.float32)
    order = rng.permutation(len(bags))
    batches = [_batch(bags, order[k : k + s.batch]) for k in range(0, len(order), s.batch)]
    del bags
    emb = np.where(kept[:, None], rng.uniform(-1, 1, (s.buckets, s.dims)).astype(np.float32) / s.dims, np.float32(0))
    grad2 = np.full(s.buckets, 1e-8, np.float32)
    out, bias = np.zeros((2, s.dims), np.float32), np.zeros(2, np.float32)
    out2, bias2 = np.full((2, s.dims), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    steps, step = max(1, s.epochs * len(batches)), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(batches)):
            chosen, filled, starts, ids, weight, doc, by, heads, unique = batches[k]
            hidden = np.zeros((len(chosen), s.dims), np.float32)
            if len(ids):
                hidden[filled] = np.add.reduceat(emb[ids] * weight[:, None], starts, axis=0)
            logits = hidden @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            p *= cost[chosen][:, None]
            lr = s.rate * (1 - step / steps)
            step += 1
            to_hidden = p @ out
            g_out, g_bias = p.T @ hidden / len(chosen), p.mean(0)
            out2 += g_out**2
            bias2 += g_bias**2
            out -= lr * 0.5 * g_out / np.sqrt(out2)
            bias -= lr * 0.1 * g_bias / np.sqrt(bias2)
            if len(ids):
                total = np.add.reduceat((to_hidden[doc] * weight[:, None])[by], heads, axis=0)
                grad2[unique] += (total**2).mean(1)
                emb[unique] -= lr * 0.5 * total / np.sqrt(grad2[unique])[:, None]
    if not len(y):
        return Model(s, np.zeros(s.buckets, np.float32), -40.0, 0.0)
    return Model(s, (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), float(y.mean()))


def held_out(id_col: Column) -> Column:
    """crc32 of the decimal id, mod 5 is 0; null ids count as training rows' complement, that is, as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, y, text: the written rows that the model is fitted on, settings.sample of them and settings.sample_bytes of text at most.

    They are the labelled rows that aren't held out, in the order of the hash of their id. Null labels, null ids and labels without a document
    are left out. An id that is labelled more than once is toxic if any label says so; of several texts of an id the one with the least
    digest counts. So the rows are the same on every run.
    """
    every = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    chosen = every.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(settings.sample)
    short = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= settings.longest)
    found = short.join(F.broadcast(chosen), "id").groupBy("id", "y", "h").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    found = spool(found.withColumn("size", F.octet_length("text")), "labelled")
    room, past = settings.sample_bytes, None
    for r in found.select("h", "id", "size").orderBy("h", "id").collect():
        room -= r["size"]
        if room < 0:
            past = r
            break
    if past:
        found = found.where((F.col("h") < past["h"]) | (F.col("h") == past["h"]) & (F.col("id") < past["id"]))
    return found.select("id", "y", "text")


def _trained(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
    model = train([t for _, _, t in rows], [y for _, y, _ in rows], settings)
    yield pa.RecordBatch.from_arrays([pa.array([model.bucket_score.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.base])], names=["scores", "bias", "base"])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the sampled rows. One task trains it, so the driver only reads sizes and the model; a lost task is run again to the same result.

    The bound of the sample holds for the fit alone. Without any labels every score is next to 0.
    """
    ship(docs.sparkSession)
    rows = sampled(docs, labels, settings, id_col, text_col, label_col)
    found = rows.coalesce(1).mapInArrow(partial(_trained, settings=settings), "scores binary, bias double, base double").collect()
    release(rows)
    return Model(settings, np.frombuffer(found[0]["scores"], np.float32), found[0]["bias"], found[0]["base"]) if found else train([], [], settings)


def _work(model) -> Callable[[list[str]], dict]:
    m: Model = model.value
    memo: dict[str, float] = {}
    counts = [gram_count(n, m.settings) for n in range(64)]

    def work(texts: list[str]) -> dict:
        lists = [stretches(t, m.settings) for t in texts]
        every = set().union(*(part for parts in lists for part in parts))
        missing = [w for w in every if w not in memo]
        if len(memo) + len(missing) > MEMO_ENTRIES:
            memo.clear()
            missing = list(every)
        memo.update(zip(missing, m.word_scores(missing)))
        scores = []
        for parts in lists:
            z = 0.0
            for part in parts:
                n = sum(counts[k] if k < 64 else gram_count(k, m.settings) for k in map(len, part))
                z += math.fsum(map(memo.__getitem__, part)) / (n + m.settings.pad)
            z = m.bias + z / max(1, len(parts))
            scores.append(1 / (1 + math.exp(-min(40.0, max(-40.0, z)))) if parts else m.base)
        return {"score": scores, "predicted": [int(x >= 0.5) for x in scores]}

    return work


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1, of label 1), predicted (1 if score >= 0.5) for the whole text of every row.

    Null, empty and wordless texts score the share of toxic documents in the fit; without any labels all scores are next to 0. Repeated rows
    and null ids keep their rows, a text of any length is scored whole, extra columns are left behind. The model that is broadcast
    has a fixed number of buckets.
    """
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, id_col, text_col, partial(_work, docs.sparkSession.sparkContext.broadcast(model)), fields)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted: fit, then score every row of docs; an empty table gives an empty result."""
    scored = score(docs, fit(docs, labels, settings, id_col, text_col), id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def _clean(model) -> Callable[[list[str]], list[bool]]:
    work = _work(model)
    return lambda texts: [not x for x in work(texts)["predicted"]]


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic; null and wordless texts by the share of toxic documents."""
    return keep_rows(docs, text_col, partial(_clean, docs.sparkSession.sparkContext.broadcast(model)))
