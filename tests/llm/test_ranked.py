import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from tidemark.llm import queries, ranked

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms, df = len(counted), sum(n for *_, n in counted), Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(often * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, often in Counter(terms_of(text)).items() if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows_of(queries.QUERIES["op13_hybrid_ranked_search"](spark, sf_dir)) == brute(docs, items)


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = sorted(con.execute(queries.RANKED_SQL).fetchall(), key=str)
    assert rows_of(queries.QUERIES["op13_hybrid_ranked_search"](spark, "/root/testdata/sf0.001")) == want


HOSTILE = [
    (1, "Apple banana APPLE"), (1, "apple, cherry!"), (2, None), (3, ""), (4, " \t-- "), (None, "banana é̀ É apple"), (None, "cherry"),
    (5, "ÄPFEL äpfel x1 X1"), (6, "a\x00b\x7fc"), (7, "long " * 50_000 + "apple"), (8, "common"), (9, "common"), (10, "common"),
    *((i, "tie tie " + "common " * (i % 3)) for i in range(100, 130)),
]
ASKED = [(1, "apple apple Banana"), (1, "apple apple Banana"), (2, None), (3, "..."), (None, "common tie"), (4, "nowhere"), (5, "B é̀ x1 äpfel ÄPFEL")]


def test_hostile_rows(spark, monkeypatch):
    docs = spark.createDataFrame(HOSTILE, "doc_id long, text string").selectExpr("*", "'x' as n", "1 as terms", "2 as `a.b`")
    items = spark.createDataFrame(ASKED, "item_id long, text string").selectExpr("*", "0 as score")
    want = brute(HOSTILE, ASKED)
    assert rows_of(ranked.search(docs, items)) == want
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 2)  # several blocks
    monkeypatch.setattr(ranked, "PIECE", 1000)  # long texts in pieces
    assert rows_of(ranked.search(docs, items)) == want
    assert ranked.search(docs.limit(0), items).count() == 0 and ranked.search(docs, items.limit(0)).count() == 0


def test_skips_documents_that_only_hold_common_terms():
    """Where short lists decide, most documents are never scored, and the result is that of scoring all."""
    r = np.random.default_rng(5)
    n = 8000
    common = [(d, t) for d in range(n) for t in range(30) if r.random() < 0.8]
    rare = [(int(d), 30 + t) for t in range(20) for d in r.choice(n, 40, replace=False)]
    at, terms = (np.array(x) for x in zip(*(common + rare)))
    tfs = r.integers(1, 4, len(at))
    shard = ranked.Shard(np.arange(n), np.ones(n, bool), np.full(n, 100), at, terms, tfs)
    asked = np.arange(50)
    weights = np.where(asked < 30, 200, 6000)
    best = ranked.Best(10)
    shard.search(asked, weights, best)
    scores = np.zeros(n, np.int64)
    np.add.at(scores, at, weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 800)))
    want = np.lexsort((np.arange(n), -scores))[:10]
    assert best.ids.tolist() == want.tolist() and best.score.tolist() == scores[want].tolist()
    assert shard.scored < n / 4


def test_lengths_beyond_64_bits():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "n": [1 << 50], "terms": [[0]], "tfs": [[1]]})
    shard = ranked.shard_of(batch, 1 << 20, 1 << 60)
    assert shard.value.tolist() == [10**9 // (1000 + 8 * (25 + (75 * (1 << 70) >> 60)))]
