"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import connected_components, join_unique, map_texts, release, spool

SEED = 42
#: Widths of the blocks; at most 3 differing bits leave 3 of 6 blocks alike, so any 3 blocks together are a key of 31 to 33 bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A bucket with more fingerprints is split by classes of bits, SPLITS times at most.
BUCKET, SPLITS = 256, 3
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")


def shingle_hashes(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """Big-endian XXH64 of every shingle of a text, in pieces: of a long text only one piece is held in words."""
    data, at, tail, none = text.encode().lower(), 0, [], True  # bytes: A-Z and ASCII white space only
    h = xxhash.xxh64_digest
    while at < len(data):
        cut = SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = cut.start() if cut else len(data)
        found = [*tail, *data[at:end].split()]
        at = end
        n = len(found) - words + 1
        tail = found[max(0, n) :]
        if n > 0:
            none = False
            joined = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
            yield np.frombuffer(b"".join([h(joined[a:b], seed) for a, b in zip(starts, ends[-n:].tolist())]), np.uint8).reshape(-1, 8)
    if none and tail:
        yield np.frombuffer(h(b" ".join(tail), seed), np.uint8).reshape(-1, 8)


def fingerprint(text: str, words: int) -> int:
    """Majority bits over the shingles of a text, unsigned; 0 if it has no word."""
    count, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words, SEED):
        n += len(hashes)
        for i in range(0, len(hashes), 65536):
            count += np.unpackbits(hashes[i : i + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big") if n else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _work(words: int) -> Callable[[list[str]], dict]:
    return lambda texts: {"fp": [_signed(fingerprint(t, words)) for t in texts]}


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp: the fingerprint as a signed long, one row per input row; null and blank texts have 0."""
    return map_texts(docs, id_col, text_col, partial(_work, words), [T.StructField("fp", T.LongType())])


def _block(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(fp: Column, keep: int) -> Column:
    """Every key of a fingerprint: the bits of keep of the blocks, with the number of the choice above them."""
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    keys = []
    for n, chosen in enumerate(combinations(range(len(BLOCKS)), keep)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(_block(fp, at[i], BLOCKS[i]))
        keys.append(key)
    return F.array(*keys)


def _masks(keep: int) -> list[int]:
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    return [_signed(sum(((1 << BLOCKS[i]) - 1) << at[i] for i in chosen)) for chosen in combinations(range(len(BLOCKS)), keep)]


def _classes(level: int, parts: int) -> list[int]:
    """The 64 bits in parts classes, by another digit of their numbers at each level."""
    return [_signed(sum(1 << b for b in range(64) if b // parts**level % parts == k)) for k in range(parts)]


def close_pairs(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """a, b (a < b): the pairs of distinct fingerprints, in column fp, that differ in 1 to distance bits.

    Blocks: at most distance blocks of len(BLOCKS) can differ, the others form the key. A bucket of over BUCKET fingerprints is
    split again the same way: of distance + 1 classes of bits one is alike. After SPLITS such steps only some 13 bits of a bucket are
    open, so it holds a few thousand fingerprints at most. A pair is only given out by the first key and the first classes that
    its sides share, so none comes twice. Nothing is capped.
    """
    if not 0 < distance < len(BLOCKS):
        raise ValueError(f"distance must be from 1 to {len(BLOCKS) - 1}")
    keep, parts = len(BLOCKS) - distance, distance + 1
    masks = _masks(keep)
    rows = distinct.select("fp", F.posexplode(_keys(F.col("fp"), keep)).alias("t", "key")).select("t", "key", "fp", F.expr("array()").cast("array<int>").alias("path"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for n, m in enumerate(masks):
        earlier = earlier | ((F.col("t") > n) & (differ.bitwiseAND(F.lit(m).cast("long")) == 0))
    out = None
    for level in range(SPLITS + 1):
        rows = spool(rows, "blocks")
        last = level == SPLITS
        crowded = None if last else spool(rows.groupBy("t", "key").count().where(F.col("count") > BUCKET).select("t", "key"), "crowded")
        last = last or crowded.isEmpty()
        calm = rows if last else rows.join(crowded, ["t", "key"], "left_anti")
        found = calm.select("t", "key", "path", F.col("fp").alias("a")).join(calm.select("t", "key", F.col("fp").alias("b")), ["t", "key"]).where("a < b")
        for k in range(level):
            first = F.lit(None).cast("int")
            for c, m in reversed(list(enumerate(_classes(k, parts)))):
                first = F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(c)).otherwise(first)
            found = found.where(first == F.get("path", F.lit(k)))
        found = found.where((F.bit_count(differ) <= distance) & ~earlier).select("a", "b")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        split = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in _classes(level, parts)])).alias("c", "bits")
        apart = rows.join(crowded, ["t", "key"], "left_semi").select("t", "key", "fp", "path", split)
        rows = apart.select("t", F.xxhash64("key", "c", "bits").alias("key"), "fp", F.array_append("path", F.col("c")).alias("path"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id: the smallest id that links of at most distance bits reach.

    One row per input row: repeated rows share a component, null texts have fingerprint 0 like blank ones, and a component of
    null ids only has a null component_id. An empty table gives an empty result. Extra columns are left behind. A text of any length is
    read whole, in pieces. Work goes over distinct fingerprints; a fingerprint or a component of very many rows is joined by broadcast.
    """
    marked = spool(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = spool(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = connected_components(close_pairs(distinct, distance))
    placed = spool(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    component = spool(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    known = spool(join_unique(placed, component, "root", "members").select("fp", "n", "component_id"), "components")
    release(distinct, placed, component)
    return join_unique(marked, known, "fp", "n").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of the smallest id of each component; of repeated rows of one id one stays.

    Rows without an id can't be chosen by it: they all stay. An empty table gives an empty result.
    """
    found = near_duplicates(docs, words, distance, id_col, text_col)
    return keep_first(docs, spool(found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")), "kept"), id_col)


def keep_first(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is in kept (ids and their rows, written); of repeated rows of one id one stays, rows without an id all."""
    # the list of ids grows with the documents: the join is shuffled at every size, and spills where an id list doesn't fit
    out = docs.join(kept.select(id_col).hint("merge"), id_col, "left_semi")
    if not kept.where("rows > 1").isEmpty():
        out = out.dropDuplicates([id_col])
    return out.unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
