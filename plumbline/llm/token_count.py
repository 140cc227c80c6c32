"""Token counts by whole-token shortcut.

Pre-tokens that are known to be one token are counted without merging; only the rest go through the merge rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import map_texts

#: The byte-level pre-tokeniser's public pattern.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MEMO_ENTRIES = 300_000


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as one printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_spec(tokenizer_path: str) -> dict:
    with open(tokenizer_path, encoding="utf-8") as f:
        return json.load(f)


def merge_alone(spelled: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The merge rules applied to one string, lowest rank first and leftmost among equals."""
    parts = list(spelled)
    while len(parts) > 1:
        rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def prove_whole_tokens(spec: dict) -> tuple[list[str], bool]:
    """Vocabulary strings that are a pre-token by themselves and that the merge rules turn, alone, into one token.

    The flag says that every entry made by a merge is such a string and that ids follow merge order. Then merging by the rank of the
    merged string equals merging by the rules: two neighbours could only merge against the rules into an entry that
    would not come out whole by itself.
    """
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ranks = {m: i for i, m in enumerate(merges)}
    alphabet = byte_alphabet()
    found, all_whole = [], True
    for spelled in vocab:
        if spelled in added:
            continue
        whole = all(c in alphabet for c in spelled) and len(merge_alone(spelled, ranks)) == 1
        all_whole = all_whole and whole
        try:
            text = bytes(alphabet[c] for c in spelled).decode() if whole else ""
        except UnicodeDecodeError:
            continue
        m = BYTE_LEVEL.match(text)
        if text and m and m.end() == len(text):
            found.append(text)
    ids = [vocab.get(a + b, -1) for a, b in merges]
    ordered = all(x < y for x, y in zip(ids, ids[1:])) and ids[:1] != [-1] and all(c in vocab and vocab[c] < ids[0] for c in alphabet)
    return sorted(found), all_whole and ordered


def shortcut_applies(spec: dict) -> bool:
    """True for byte-level BPE without normaliser, prefix space or post-processing of plain text."""
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and plain


def _rank_merger(spec: dict) -> Callable[[list[str]], list[int]]:
    """Token numbers of pre-tokens by rank, from the vocabulary file's own entries."""
    import tiktoken

    alphabet = byte_alphabet()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    merge = tiktoken.Encoding("pre-tokens", pat_str=BYTE_LEVEL.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda words: [*map(len, map(merge, map(str.encode, words)))]


def _library(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [*map(len, tok.encode_batch_fast(texts, add_special_tokens=False))] if texts else []


def _shortcut(path: str, known: list[str], by_rank: bool) -> Callable[[list[str]], list[int]]:
    spec = read_spec(path)
    merge = _rank_merger(spec) if by_rank else _library(path)
    whole = dict.fromkeys(known, 1)
    added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
    special = regex.compile("|".join(map(regex.escape, added))) if added else None
    memo = dict(whole)

    def count(texts: list[str]) -> list[int]:
        nonlocal memo
        lists, extra = [], []
        for t in texts:
            hits = len(special.findall(t)) if special else 0
            extra.append(hits)
            lists.append([x for part in special.split(t) for x in BYTE_LEVEL.findall(part)] if hits else BYTE_LEVEL.findall(t))
        every = set().union(*lists)
        missing = [w for w in every if w not in memo]
        if len(memo) + len(missing) > len(whole) + MEMO_ENTRIES:
            memo = dict(whole)
            missing = [w for w in every if w not in memo]
        memo.update(zip(missing, merge(missing)))
        return [sum(map(memo.__getitem__, x)) + n for x, n in zip(lists, extra)]

    return count


def _pieces(path: str) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def _work(path: str, proof, limit: int) -> Callable[[list[str]], dict]:
    count = _pieces(path) if path.endswith(".model") else _shortcut(path, *proof.value) if proof else _library(path)

    def work(texts: list[str]) -> dict:
        n = count(texts)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return work


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit: one row per input row, repeated rows included.

    Null or empty text: 0 tokens. Special strings inside a text count as the library's default has them (one token each).
    A whole text is always counted, however long. Other columns of docs are left behind, whatever their names.
    Byte-level BPE files take the shortcut; other .json files and .model files are counted by their library.
    """
    proof = None
    if not tokenizer_path.endswith(".model") and shortcut_applies(spec := read_spec(tokenizer_path)):
        proof = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(spec))  # bounded by the vocabulary
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(docs, id_col, text_col, partial(_work, tokenizer_path, proof, limit), fields)
