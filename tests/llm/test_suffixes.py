import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import common, queries, suffixes


def brute(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, sha256)"""
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - 49):
                w = raw[i : i + 50]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if d is not None:
            for i in range(len(raw) - 49):
                if least[raw[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((-1 if d is None else d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array(seed):
    r = random.Random(seed)
    for _ in range(60):
        text = [r.choice([2, 3, 4][: r.randint(1, 3)]) for _ in range(r.randint(0, 80))] + [0]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_small_rows(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(2, 9)))
    shared = ["".join(word() for _ in range(20)) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = ["".join(word() for _ in range(r.randint(0, 12))) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            a = r.randint(0, 20)
            parts.insert(r.randint(0, 3), s[a : a + r.randint(45, 90)])
        rows.append((i, "".join(parts)))
    rows += [(200, rows[7][1]), (201, rows[7][1]), (201, rows[7][1]), (201, rows[8][1]), (202, None), (203, ""), (None, rows[9][1]), (None, None)]
    rows += [(204, "x" * 49), (205, "x" * 50), (206, "x" * 400), (207, "ab" * 300), (208, "ab" * 40 + "q"), (-5, rows[11][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source", "1 as tid", "2 as ranges")
    assert result(suffixes.dedup_report(df)) == brute(rows)
    cut = suffixes.cut_docs(df)
    assert cut.columns == df.columns
    kept = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.filter("doc_id < 120").collect()}
    whole = {(d, h) for d, _, _, _, h in brute(rows) if 0 <= d < 120 and h != hashlib.sha256(b"").hexdigest()}
    assert len(kept & whole) > 0.9 * len(whole)  # the rest was cut inside a character
    assert suffixes.dedup_report(df.limit(0)).count() == 0 and suffixes.cut_docs(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_frequent_minimizers(spark, hot):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9)))
    phrase = " a phrase of forty bytes that all of us hold "
    rows = [(i, " ".join(word() for _ in range(8)) + phrase + " ".join(word() for _ in range(r.randint(1, 8)))) for i in range(150)]
    rows += [(200 + i, rows[r.randint(0, 149)][1][5 : r.randint(60, 130)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: n for d, _, n, _, _ in brute(rows)}
    got = {}
    for x in suffixes.covered_ranges(df, hot).collect():
        got[x.doc_id] = sum(e - s for s, e in suffixes._merged(x.ranges))
    assert got == {d: n for d, n in want.items() if n}


def test_columns_of_any_name(spark):
    text = "the same passage of more than fifty bytes stands in two documents"
    rows = [(1, text, 1, "k", "d", "t", "r"), (2, "x " + text, 2, "k", "d", "t", "r"), (None, text, 3, None, None, None, None), (3, None, 4, "", "", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _key string, _doc string, _tid string, _ranges string")
    df = df.selectExpr("*", "1 as keys", "2 as class_id", "3 as key", "4 as ranges", "5 as tid", "6 as doc", "7 as `a.b`")
    got = {(r.doc_id, r.text): r for r in suffixes.cut_docs(df).collect()}
    assert set(got) == {(1, text), (2, "x "), (None, text), (3, None)} and got[2, "x "].n_chars == 2
    assert [got[2, "x "][c] for c in df.columns[3:]] == ["k", "d", "t", "r", 1, 2, 3, 4, 5, 6, 7]


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(queries.QUERIES["op5_suffix_dedup"](spark, sf_dir)) == brute(rows)


def test_trimmed_pieces_keep_their_owners():
    r = random.Random(9)
    for _ in range(200):
        core, n = "".join(r.choice("ab") for _ in range(8)), r.randint(2, 6)
        lefts = ["".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(3)]
        rights = ["".join(r.choice("ab") for _ in range(r.randint(4, 9))) for _ in range(3)]
        pieces = list({(le := r.choice(lefts)) + core + r.choice(rights): len(le) for _ in range(n)}.items())
        text, middle, owners = [p.encode() for p, _ in pieces], [m for _, m in pieces], [r.randint(0, 9) for _ in pieces]
        if len(text) > 1:
            got = suffixes.piece_owners(text, middle, owners, 12)
            for p, m, o, g in zip(text, middle, owners, got):
                for i in range(len(p) - 11):
                    want = min(w for q, k, w in zip(text, middle, owners) if 0 <= k - m + i and q[k - m + i : k - m + i + 12] == p[i : i + 12])
                    assert want >= g[i] and min([w for q, w in zip(text, owners) if p[i : i + 12] in q]) <= g[i]


def test_a_task_holds_one_range_of_minimizers(spark):
    """Dealt by hash, several ranges met in one task and one Arrow batch."""
    sent = spark.range(640).selectExpr("cast(id % 64 as int) as range")
    held = suffixes._dealt(sent, 64).selectExpr("range", "spark_partition_id() as p").distinct().collect()
    assert len(held) == 64 and {r.p for r in held} == set(range(64))


def test_ranges_of_minimizers_are_even():
    """Minimizers are small hashes: by their size the first of 64 ranges held a quarter of them."""
    h, *_ = suffixes.minimizers([random.Random(5).randbytes(400_000)])
    counts = np.bincount(suffixes._to_range(h, 64), minlength=64)
    assert len(counts) == 64 and counts.max() < 1.5 * counts.mean()


def test_a_stored_step_leaves_no_shuffle_files(spark):
    """They stood on disk beside the next step's and those of the step after it."""
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(common.CLEANUP, None)
    df = common.stored(spark.range(5000).selectExpr("id % 1000 as k").groupBy("k").count())
    until = time.time() + 10  # Spark deletes them in the background
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert df.filter("count = 5").count() == 1000 and spark.conf.get(common.CLEANUP, None) == setting
