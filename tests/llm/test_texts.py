"""Edge cases and brute force of the operators that give one row per text."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from plumbline.llm import media_chunks, piece_codec, simhash, token_count, toxicity

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "  a", "a  b   ", "\n\n a\n", "日本語 テスト", "▁x ▁▁ y", "😀 é é", "<s> </s> <unk>", "\t\t x\ty", "a　b", "\x00a", "aaaa" * 3000, " " * 50 + "x", "'sx don't", "a<|endoftext|>b <|endoftext|>"]


def key(x):
    return (x is None, x or 0)


def by_text(rows, docs, *columns):
    """Rows agree with what each text gives, whatever its id; every input row is there."""
    assert len(rows) == docs.count()
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}


def test_token_counts_equal_the_library(spark, edge_docs, no_docs):
    tok = Tokenizer.from_file(BYTES)
    rows = token_count.count_tokens(edge_docs, BYTES).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows), key=lambda r: (key(r[0]), r[1:]))
    want = []
    for r in edge_docs.collect():
        t = r.text or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want.append((r.doc_id, len(t.encode()), n, n > 1024))
    assert got == sorted(want, key=lambda r: (key(r[0]), r[1:]))
    assert token_count.count_tokens(no_docs, BYTES).collect() == []


def test_token_counts_of_hard_texts_and_other_files(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for path, count in ((BYTES, lambda t: len(Tokenizer.from_file(BYTES).encode(t, add_special_tokens=False).ids)), (public_tokenizers.path("word_bpe_49k.json"), lambda t: len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids)), (PIECES, lambda t: len(sp.encode(t)))):
        got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, path).collect()}
        assert got == {i: count(t) for i, t in enumerate(HARD)}


def test_whole_tokens_are_proven():
    spec = token_count.read_spec(BYTES)
    known, by_rank = token_count.prove_whole_tokens(spec)
    tok = Tokenizer.from_file(BYTES)
    assert by_rank and len(known) > 49_000
    assert all(len(e.ids) == 1 for e in tok.encode_batch(random.Random(1).sample(known, 2000), add_special_tokens=False))
    broken = {"model": {"vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, "merges": ["a b"]}, "added_tokens": []}
    known, by_rank = token_count.prove_whole_tokens(broken)
    assert "ab" in known and "abc" not in known and not by_rank


def test_pieces_equal_the_library_with_spans(spark, edge_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = piece_codec.PieceCodec(PIECES)
    for text, (ids, starts, ends) in zip(HARD, codec.encode(HARD)):
        assert ids == sp.encode(text, add_eos=True)
        pieces = sp.encode(text, return_type="proto").pieces
        n = len(text.encode())
        assert list(starts) == [p.begin for p in pieces] + [n] and list(ends) == [p.end for p in pieces] + [n]
    rows = piece_codec.piece_digests(edge_docs, PIECES).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in edge_docs.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows]
    assert sorted(got, key=lambda r: (key(r[0]), r[1:])) == sorted(want, key=lambda r: (key(r[0]), r[1:]))
    assert piece_codec.piece_digests(no_docs, PIECES).collect() == []


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    encoded = piece_codec.encode_pieces(docs, PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.text for r in piece_codec.decode_pieces(encoded, PIECES).collect()}
    assert got == {i: sp.decode(sp.encode(t, add_eos=True)) for i, t in enumerate(HARD)}


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("extra", [True, False])
def test_normaliser_equals_the_library(rule, extra):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=extra)
    spec = {a: v for n, _, v in piece_codec.proto_fields(library.serialized_model_proto()) if n == 3 for a, _, v in piece_codec.proto_fields(v)}
    mine = piece_codec.Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
    alphabet = ["a", "B", " ", "  ", "①", "ﬁ", "Å", "か", "゙", "\t", "　", "é", "é", "ｱ", "ﾞ", "​", "▁", "ß", "한", "😀", "\n", "½"]
    r = random.Random(3)
    for _i in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 12)))
        want, offsets = library.normalize(text, with_offsets=True)
        got, align = mine(text)
        assert got == want, repr(text)
        at, chars = 0, []
        for c in got:
            chars.append(len(text.encode()[: align[at]].decode(errors="ignore")))
            at += len(c.encode())
        assert chars == [int(x) for x in offsets][: len(chars)], repr(text)


def brute_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in edge_docs.collect() if r.text is None or len(r.text) < 50_000]
    assert len(rows) == edge_docs.count()
    got = {(r.doc_id, r.fingerprint) for r in rows}
    assert {(i, f"{f:016x}") for i, f in docs} <= got
    component = {}
    every = [(r.doc_id, int(r.fingerprint, 16)) for r in rows]
    for i, f in every:
        reach, grown = {f}, True
        while grown:
            more = {g for _, g in every for x in reach if bin(g ^ x).count("1") <= 3}
            grown, reach = more != reach, more | reach
        component[i, f] = min((j for j, g in every if g in reach and j is not None), default=None)
    assert all(r.component_id == component[r.doc_id, int(r.fingerprint, 16)] for r in rows)
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("bucket", [256, 4, 1])
def test_close_pairs_are_complete(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(0)
    centres = [r.getrandbits(64) for _ in range(10)]
    found = set(centres)
    for c in centres[:5]:
        for _i in range(40):
            x = c
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            found.add(x)
    found = [simhash._signed(x) for x in found]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(found) for b in found[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = [tuple(p) for p in simhash.close_pairs(spark.createDataFrame([(x,) for x in found], "fp long")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_deduplicate_keeps_one_of_each_group(spark, edge_docs):
    kept = simhash.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in simhash.near_duplicates(edge_docs).collect() if r.component_id is not None})
    assert ids.count(None) == 2


def test_media_round_trip(spark, edge_docs, no_docs):
    rows = media_chunks.media_features(edge_docs, media_chunks.Cuts(bits=1 << 12)).collect()
    want = []
    for r in edge_docs.collect():
        payload, n = media_chunks.payload_of(r.text or "")
        assert len(payload) % 576 == 0 and payload[:n] == (r.text or "").encode() and set(payload[n:]) <= {255}
        media = media_chunks.wave_header(len(payload)) + payload
        want.append((r.doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows]
    assert sorted(got, key=lambda r: (key(r[0]), r[1:])) == sorted(want, key=lambda r: (key(r[0]), r[1:]))
    assert len({r.feature for r in rows if r.payload_sha256 == rows[0].payload_sha256}) == 1
    assert media_chunks.media_features(no_docs).collect() == []


def test_filter_and_join_of_digests_give_the_same(spark, edge_docs):
    a, b = (sorted(map(repr, media_chunks.media_features(edge_docs, media_chunks.Cuts(bits=bits)).collect())) for bits in (1 << 29, 0))
    assert a == b
    docs = spark.createDataFrame([(i, f"start {i} " * 40 + "w " * 3000 * (i % 2)) for i in range(20)] + [(50, "w " * 3000)] * 3, "doc_id long, text string")
    for bits in (1 << 29, 0):
        packs, shared = media_chunks.store(docs, media_chunks.Cuts(bits=bits))
        digests = {media_chunks.digest(c) for r in packs.collect() for c in r.chunks if c is not None}
        assert not digests & {bytes(r.d) for r in shared.collect()} and shared.count() < 60


def test_features_by_plain_python(spark, edge_docs):
    texts = {r.doc_id: r.text or "" for r in edge_docs.where("doc_id is not null").collect() if len(r.text or "") < 2000}
    for r in media_chunks.media_features(edge_docs).collect():
        if r.doc_id in texts:
            data = texts[r.doc_id].encode()
            data += b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
            low = [x < 128 for x in data]
            assert r.feature == f"sum={sum(data)};energy={sum((x - 128) ** 2 for x in data)};crossings={sum(a != b for a, b in zip(low, low[1:]))}"
            wave = b"RIFF" + (36 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("10000000010001" + "00401f0000401f00000100" + "0800") + b"data" + len(data).to_bytes(4, "little")
            assert r.media_sha256 == hashlib.sha256(wave + data).hexdigest()


def test_chunks_follow_content():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(30_000))
    h = media_chunks.gear_hashes(data)
    gear = [int(x) for x in media_chunks.GEAR]
    for i in (0, 5, 31, 32, 100, 29_999):
        assert int(h[i]) == sum(gear[data[i - k]] << k for k in range(32) if i >= k) % 2**32
    a, b = media_chunks.cut(data), media_chunks.cut(b"shifted by some bytes" + data)
    assert b"".join(a) == data and len(set(a) & set(b)) >= len(a) - 2
    for odd in (b"", b"x", b"\0" * 50_000):
        assert b"".join(media_chunks.cut(odd)) == odd


def test_shared_chunks_are_stored_once(spark):
    passage = " ".join(f"word{i}" for i in range(2000))
    docs = spark.createDataFrame([(i, f"start {i} " * 40 + passage) for i in range(20)], "doc_id long, text string")
    packs, shared = media_chunks.store(docs)
    assert shared.agg({"n": "max"}).first()[0] == 20
    stored = sum(len(r.chunk) for r in shared.collect()) + sum(len(c or b"") for r in packs.collect() for c in r.chunks)
    assert stored < 0.3 * 20 * len(passage)
    assert media_chunks.load(packs, shared).count() == 20


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(4)
    clean = ["alpha", "river", "stone", "window", "garden", "paper", "quiet", "market", "winter", "number"]
    bad = ["vilescum", "idiotic", "moronish", "trashface"]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(clean) + r.choice(["", "s", "ly"]) for _ in range(r.randint(20, 120))]
        if i % 4 == 0:
            for _k in range(max(2, len(words) // 20)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, toxic):
    docs, labels = toxic
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 900
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([(r.doc_id % 4 == 0) == bool(r.predicted) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_catches_misspellings_and_edges(spark, toxic, edge_docs, no_docs):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    texts = [(1, "the river stone window vilescumm garden paper moronishh quiet idiotik market trashfacce"), (2, "the river stone window garden paper quiet market winter")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got[1] > got[2] and got[1] > 0.5 > got[2]
    assert toxicity.score(edge_docs, model).count() == edge_docs.count()
    assert toxicity.reject_toxic(edge_docs, model).columns == edge_docs.columns
    assert toxicity.score(no_docs, model).collect() == []
    empty = labels.limit(0)
    assert all(r.score < 1e-9 and not r.predicted for r in toxicity.classify(edge_docs, empty).collect())
    assert {r.score for r in toxicity.score(edge_docs.where("doc_id in (2, 3)"), model).collect()} == {model.base}


def test_labels_outside_the_fit_change_nothing(spark, toxic):
    from pyspark.sql import functions as F

    docs, labels = toxic
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.bucket_score, b.bucket_score)


def score_by_hand(text, model):
    """The score of a text by plain loops: FNV steps over n-grams, a rolled hash for whole words, a mean for each stretch."""
    s, mask = model.settings, 0xFFFFFFFF
    found = re.findall(r"[^\W_]+", text.lower())
    if not found:
        return model.base
    z, parts = 0.0, -(-len(found) // s.stretch)
    for k in range(parts):
        total, grams = 0.0, 0
        for word in set(found[len(found) * k // parts : len(found) * (k + 1) // parts]):
            w = [ord(c) for c in f"<{word}>"]
            slots = []
            for n in range(s.low, s.high + 1):
                for i in range(len(w) - n + 1):
                    h = 2166136261
                    for c in w[i : i + n]:
                        h = (h ^ c) * 16777619 & mask
                    x = h * (2654435769 + 2 * n & mask) & mask
                    slots.append((x ^ x >> 15) & (s.buckets - 1))
            x = sum(c * pow(31, i, 1 << 32) for i, c in enumerate(w)) * 2654435769 & mask
            slots.append((x ^ x >> 13) & (s.buckets - 1))
            total += sum(float(model.bucket_score[b]) for b in slots)
            grams += len(slots)
        z += total / (grams + s.pad)
    return 1 / (1 + math.exp(-(model.bias + z / parts)))


def test_scores_by_hand(spark, toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.limit(25).collect()] + ["", "  ", "É_é ß 日本 a", "x" * 5000, "vilescum " * 700]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        assert abs(r.score - score_by_hand(texts[r.doc_id], model)) < 1e-6


def test_fit_is_bounded_and_repeats_change_nothing(spark, toxic):
    from pyspark.sql import functions as F

    docs, labels = toxic
    want = toxicity.fit(docs, labels).bucket_score
    many = docs.union(docs.where("doc_id < 40")).union(docs.where("doc_id = 7")).union(spark.createDataFrame([(10_001, "y " * (1 << 20))], docs.schema))
    more = labels.union(labels.where("doc_id < 9")).union(spark.createDataFrame([(10_001, 1, 1)], labels.schema))
    assert np.array_equal(want, toxicity.fit(many.repartition(5), more.repartition(3)).bucket_score)
    for room in (0, 5_000, 1 << 26):
        sizes = [len(r.text) for r in toxicity.sampled(many, more, toxicity.Settings(sample_bytes=room)).collect()]
        assert sum(sizes) <= room and bool(sizes) == bool(room)
    assert len(sizes) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(900))
    model = toxicity.fit(docs, labels)
    as_bytes = docs.withColumn("text", F.col("text").cast("binary"))
    assert toxicity.reject_toxic(as_bytes, model).count() == toxicity.reject_toxic(docs, model).count() > 0
