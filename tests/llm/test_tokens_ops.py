"""Ops 1, 3, 4 and 9 against the tokenizers library, on hostile texts and on a whole small table."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe, packing, queries, repair, tokens, transducer

SCHEMA = "doc_id long, text string, lang string, n_tokens long, part int, start long"
HOSTILE = [
    None, "", " ", "\n", "a<|endoftext|> b", "<|endoftext|><|endoftext|>x", "don't  stop\n\n 'tis x'll y'RE aaaaaaaa",
    "\xa0x 　y", "ä😀 日本語 x́", "12 3456  \t a", "!!!'s 's", "x'r", "x'l", " 'v", "a Ġword Ġx", "İ ΑΣ ﬁ", "a\x1cb c",
    "the cat\nthe cat", "the cat\nthe cat", "word " * 5000, "zq" * 30000,
]


def frame(spark, texts):
    rows = [(i if i != 3 else None, t, None, 7, 0, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def noise(n, seed=0):
    r = random.Random(seed)
    letters = list("aabcdestrvlm'''  \n\t!1é日　.") + ["'re", "'ll", " '", "the ", "<|endoftext|>"]
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 700))) for _ in range(n)]


def library(name, texts):
    return [np.array(e.ids, "<u4") for e in tokens.load(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_cache_equals_library(name, keep):
    texts = [t or "" for t in HOSTILE] + noise(150)
    got = tokens.library_cache(name, keep).encode_texts(texts)
    assert got == [x.tobytes() for x in library(name, texts)]


def test_cache_starts_anew_when_full():
    cache = tokens.WordCache(tokens.library_encoder(tokens.load("byte_bpe_50k.json")), True, limit=3)
    texts = ["a b c", "d e f", "a b"]
    assert [cache.encode_texts([t])[0] for t in texts] == [x.tobytes() for x in library("byte_bpe_50k.json", texts)]


def test_repair_encodes_a_pre_token_once_in_many():
    """450,000 different words, twice: a cache of 400,000 forgot the first ones and encoded them again."""
    letters, seen = "abcdefghijklmnopqrstuvwxyz", []
    words = ["".join(letters[i // 26**k % 26] for k in range(4)) for i in range(450_000)]

    def encode(parts):
        seen.append(len(parts))
        return np.zeros(len(parts), np.uint32), np.ones(len(parts), np.int64)

    cache = tokens.WordCache(encode, True, limit=repair.CACHE_WORDS, plain=encode)
    texts = [" ".join(["x", *words[i : i + 50_000]]) for i in range(0, len(words), 50_000)]
    assert [len(x) for t in (texts, texts) for x in cache.encode_texts(t)] == [4 * 50_001] * 18
    assert sum(seen) == len(words) + 1


def test_pre_tokens_and_marks_keep_their_places():
    """Marks, known, new and very long pre-tokens through a cache that forgets."""
    tokenizer = tokens.load("byte_bpe_50k.json")
    cache = tokens.WordCache(tokens.library_encoder(tokenizer), True, limit=3, plain=tokens.model_encoder(tokenizer))
    texts = ["", "a", " 's it's", "é" * 70 + " b\n" + "q" * 90, "\r", "\r\n a  b", "a b\nc, “d” 12 " + "z" * 65]
    want = [x.tobytes() for x in library("byte_bpe_50k.json", texts)]
    assert cache.encode_texts(texts) == want and [cache.encode_texts([t])[0] for t in texts] == want


def test_repair_files(spark, sf_dir):
    rows = docs(spark, sf_dir)
    got = queries.QUERIES["op1_repair_tokens"](spark, sf_dir).orderBy("doc_id").collect()
    want = [np.append(x, 2) for x in library("byte_bpe_50k.json", [r.text for r in rows])]
    start = 0
    assert len(got) == len(rows)
    for r, g, w in zip(rows, got, want):
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(w), zlib.crc32(w.astype("<u4").tobytes()))
        start += len(w)
    assert sum(g.n_symbols for g in got) < 0.9 * start


def test_repair_hostile_and_small_shards(spark):
    got = repair.read_documents(repair.write_shards(frame(spark, HOSTILE), "byte_bpe_50k.json", 2, shard_ids=50)).collect()
    got.sort(key=lambda r: r.start)
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == [i for i in range(len(HOSTILE)) if i != 3]
    order = [3] + [i for i in range(len(HOSTILE)) if i != 3]
    want = [np.append(x, 2) for x in library("byte_bpe_50k.json", [HOSTILE[i] for i in order])]
    assert [r.n_tokens for r in got] == [len(w) for w in want]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(w.astype("<u4").tobytes()) for w in want]
    assert [r.start for r in got] == np.cumsum([0] + [len(w) for w in want])[:-1].tolist()


def test_repair_keeps_every_id(spark):
    """The smallest and largest ids, nulls and repeats each keep a row."""
    ids = [None, None, -(1 << 63), -(1 << 63), 0, 5, 5, (1 << 63) - 1]
    df = spark.createDataFrame([(d, "same" if i % 2 else f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    got = sorted(repair.read_documents(repair.write_shards(df, "byte_bpe_50k.json", 2, shard_ids=4)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == ids
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_repair_random_access():
    r = np.random.default_rng(0)
    coded = [np.append(r.integers(0, 6, n), 2).astype("<u4") for n in (0, 1, 500, 3000, 0)] + [np.full(999, 4, "<u4")]
    row = repair._shard_row(0, 0, list(range(6)), [c.tobytes() for c in coded], 50257)
    shard = repair.Shard(row)
    for i, c in enumerate(coded):
        assert shard.document(i).tolist() == c.tolist()
        for a, b in ((0, 1), (0, len(c)), (len(c) // 3, len(c) // 2), (len(c) - 1, len(c))):
            assert shard.range(i, a, b).tolist() == c[a:b].tolist()
    assert len(shard.symbols) < sum(map(len, coded)) / 2


def test_empty_tables(spark):
    none = frame(spark, [])
    assert repair.read_documents(repair.write_shards(none, "byte_bpe_50k.json", 2)).count() == 0
    assert packing.pack(none, "word_bpe_49k.json", 1).count() == 0
    assert transducer.count_tokens(none, "byte_bpe_50k.json").count() == 0
    assert bpe.round_trip(none, "byte_bpe_50k.json").count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_packing(spark, sf_dir, small):
    if small:
        texts, ids = HOSTILE, [i if i != 3 else None for i in range(len(HOSTILE))]
        got, size = packing.pack(frame(spark, HOSTILE), "word_bpe_49k.json", 1, 64).collect(), 64
    else:
        rows = docs(spark, sf_dir)
        texts, ids = [r.text for r in rows], [r.doc_id for r in rows]
        got, size = queries.QUERIES["op3_concat_cut_packing"](spark, sf_dir).collect(), 2048
    want = {d: np.append(x, 1).astype("<u4") for d, x in zip(ids, library("word_bpe_49k.json", texts))}
    at = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        w = want[p.doc_id]
        assert p.doc_tokens == len(w) and p.start == at.get(p.doc_id, 0) and p.continues == (p.start > 0)
        assert p.ids_crc32 == zlib.crc32(w[p.start : p.start + p.length].tobytes())
        at[p.doc_id] = p.start + p.length
    assert at == {d: len(w) for d, w in want.items()}
    filled = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert all(n == size for s, n in filled.items() if s < max(filled)) and max(filled.values()) <= size
    assert sorted(filled) == list(range(len(filled)))


def test_token_counts(spark, sf_dir):
    texts = HOSTILE + noise(150, 1)
    got = transducer.count_tokens(frame(spark, texts), "byte_bpe_50k.json").collect()
    want = library("byte_bpe_50k.json", texts)
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [
        (len((t or "").encode()), len(w), len(w) > 1024) for t, w in zip(texts, want)
    ]
    rows = docs(spark, sf_dir)
    got = queries.QUERIES["op4_token_counts"](spark, sf_dir).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(x) for x in library("byte_bpe_50k.json", [r.text for r in rows])]


def test_segmenter_chunks_compose():
    table = transducer.character_classes(tokens.load("byte_bpe_50k.json"))
    tk = tokens.load("byte_bpe_50k.json")
    for text in noise(40, 2):
        classes = table[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        want = [s for _, (s, _) in tk.pre_tokenizer.pre_tokenize_str(text)]
        for chunk in (1, 2, 3, 7, 512):
            cuts, _ = transducer.boundaries(classes, np.array([0]), chunk)
            assert np.flatnonzero(cuts).tolist() == want


def test_counter_survives_a_full_table(monkeypatch):
    monkeypatch.setattr(transducer.Counter, "MAX_STATES", 50)
    c = transducer.TokenCounter("byte_bpe_50k.json", transducer.character_classes(tokens.load("byte_bpe_50k.json")))
    texts = noise(30, 3)
    for t in texts:
        assert c.counts([t])[1].tolist() == [len(library("byte_bpe_50k.json", [t])[0])]


def test_bpe_round_trip(spark, sf_dir):
    texts = HOSTILE + noise(100, 4)
    tk = tokens.load("byte_bpe_50k.json")
    got = bpe.round_trip(frame(spark, texts), "byte_bpe_50k.json").collect()
    for r, t, w in zip(got, texts, library("byte_bpe_50k.json", texts)):
        assert r.n_tokens == len(w)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, w.tolist())).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(w.tolist(), skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.encode_documents(frame(spark, texts), "byte_bpe_50k.json")
    assert [r.ids for r in coded.collect()] == [w.tolist() for w in library("byte_bpe_50k.json", texts)]
    assert [r.text for r in bpe.decode_documents(coded, "byte_bpe_50k.json").collect()] == [t or "" for t in texts]
    assert queries.QUERIES["op9_bpe_round_trip"](spark, sf_dir).count() == len(docs(spark, sf_dir))


def test_decoding_broken_utf8():
    v, tk = bpe.Vocabulary("byte_bpe_50k.json"), tokens.load("byte_bpe_50k.json")
    ids = np.array([v.byte_ids[0xE6], v.byte_ids[0x41], v.byte_ids[0xFF]])
    assert v.decode(ids).decode() == tk.decode(ids.tolist(), skip_special_tokens=False)


class Caught:
    """A frame that hands out the function given to mapInArrow."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_packing_second_pass_leaves_workers_small(monkeypatch):
    """The first pass's cache stayed in the workers, and whole batches (10,000 documents) were cut at once."""
    monkeypatch.setattr(packing, "with_part_offsets", lambda *_: Caught())
    tokens.library_cache("word_bpe_49k.json", False).encode_texts(["a b"])
    n, raw = 250_000, np.arange(250_000, dtype="<u2").tobytes()
    at = [i * n for i in range(40)]
    columns = [pa.array(range(40)), pa.array(at), pa.array([7] * 40), pa.array([raw] * 40, pa.binary())]
    out = list(packing.cut(None)(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "part_pos", "part_start", "ids"])])))
    assert not tokens._caches
    assert len(out) > 4 and max(b.nbytes for b in out) < 6_000_000
    assert b"".join(x for b in out for x in b["ids"].to_pylist()) == raw * 40


def test_encoding_makes_few_indices_and_no_second_lookup(monkeypatch):
    """Indices of all ids at once took some 60 bytes an id; a new pre-token was looked up again after it had been added."""
    cache = tokens.library_cache("byte_bpe_50k.json", True)
    tracemalloc.start()
    ids, n = cache.encode_flat(["a " * 1_000_000 + "b"] * 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == n.sum() == 2_000_002 and peak < 40 * len(ids)
    sought, find = [], tokens._Half.find
    monkeypatch.setattr(tokens._Half, "find", lambda self, pieces: (sought.extend(pieces), find(self, pieces))[1])
    cache.encode_flat(["qzxv wvxq qzxv"])
    assert sought.count(" wvxq") == 2  # once in either half
