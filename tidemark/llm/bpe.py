"""Byte-level BPE in batched numpy rounds, and decoding.

The symbols of many words lie in one flat array. Each round looks up every adjacent pair's rank by binary search over
the sorted pair keys, merges the lowest-ranked pair of each word wherever it occurs, and drops finished words.
Special tokens inside a text become their ids, as the library does by default.

Null and empty texts have no ids. Texts are encoded whole; repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts_of
from tidemark.llm.tokens import WordCache, byte_letters

NONE = np.iinfo(np.int32).max


class Vocabulary:
    """What a byte-level BPE file says: token bytes, pair ranks and special tokens."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        left, right, made = (np.array(x, np.int64) for x in zip(*self.merges))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, invalid UTF-8 replaced as the library's decoder does."""
        n = self.lengths[ids]
        total = int(n.sum())
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        raw = self.blob[at].tobytes()
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def merge_rounds(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and each word's number of ids."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    sym, word = v.byte_ids[raw], np.repeat(np.arange(len(words)), sizes)
    done_sym, done_word = [], []
    while len(sym):
        key = sym[:-1] << 32 | sym[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        hit = (v.keys[at] == key) & (word[:-1] == word[1:])
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = np.where(hit, v.ranks[at], NONE)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
        over = low == NONE
        if over.any():  # words in which nothing merges are finished
            done_sym.append(sym[over])
            done_word.append(word[over])
        go = np.flatnonzero((rank == low) & ~over)
        if len(go):  # of overlapping pairs (aaa) the leftmost merges
            start = np.concatenate([[True], np.diff(go) != 1])
            run = np.maximum.accumulate(np.where(start, np.arange(len(go)), 0))
            go = go[(np.arange(len(go)) - run) % 2 == 0]
            sym[go] = v.made[at[go]]
        keep = ~over
        keep[go + 1] = False
        sym, word = sym[keep], word[keep]
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(words))


def encode_pieces(v: Vocabulary, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per piece) of pieces of text."""
    words: list[bytes] = []
    special_at, special_id, per = [], [], []
    for p in pieces:
        before = len(words)
        parts = v.marks.split(p) if any(m in p for m in v.special) else (p,)
        for part in parts:
            if part in v.special:
                special_at.append(len(words))
                special_id.append(v.special[part])
                words.append(b"")
            elif part:
                words += [w.encode("utf-8", "surrogatepass") for w in v.pretokens(part)]
        per.append(len(words) - before)
    ids, n = merge_rounds(v, words)
    if special_at:  # they take no part in merges
        n[special_at] = 1
        out = np.zeros(int(n.sum()), np.int64)
        is_special = np.zeros(len(out), bool)
        where = (np.cumsum(n) - n)[special_at]
        is_special[where] = True
        out[where] = special_id
        out[~is_special] = ids
        ids = out
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per)])]
    return ids.astype(np.uint32), np.diff(ends)


def encode_plain(v: Vocabulary, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per pre-token) of pre-tokens."""
    ids, n = merge_rounds(v, [p.encode() for p in parts])
    return ids.astype(np.uint32), n


_codecs: dict[str, tuple[Vocabulary, WordCache]] = {}


def codec(name: str) -> tuple[Vocabulary, WordCache]:
    """Vocabulary and word cache of a Python worker."""
    if name not in _codecs:
        _codecs.clear()
        v = Vocabulary(name)
        _codecs[name] = v, WordCache(lambda pieces: encode_pieces(v, pieces), keep_space=True, plain=lambda parts: encode_plain(v, parts))
    return _codecs[name]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``ids`` (array of int) to doc_id and text."""

    def run(batches):
        _, cache = codec(tokenizer)
        for b in slices(batches):
            ids, n = cache.encode_flat(texts_of(b["text"]))
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of doc_id and ids: doc_id and the decoded ``text``."""

    def run(batches):
        v, _ = codec(tokenizer)
        for b in batches:
            ids = [np.array(x, np.int64) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([v.decode(x).decode() for x in ids])], ["doc_id", "text"])

    return coded.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens and digests of the ids and of the decoded text."""

    def run(batches):
        v, cache = codec(tokenizer)
        names = np.array([str(i) for i in range(len(v.bytes))], dtype=object)
        for b in slices(batches):
            flat, n = cache.encode_flat(texts_of(b["text"]))
            ids = np.split(flat, np.cumsum(n)[:-1])
            listed = [hashlib.sha256(",".join(names[x].tolist()).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(v.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n), pa.array(listed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
