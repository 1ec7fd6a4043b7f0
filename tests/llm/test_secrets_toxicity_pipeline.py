import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np

import corpus_pipeline
from tests.llm.test_near import brute as near_brute
from tidemark.llm import queries, secrets, suffixes, tokens, toxicity


def naive_spans(text):
    """All spans with every window's entropy counted anew."""
    found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    for m in secrets.CANDIDATE.finditer(text):
        run = m.group()
        if any(a.fullmatch(run) for a in secrets.ALLOW):
            continue
        covered = np.zeros(len(run), bool)
        for i in range(len(run) - 19):
            w = run[i : i + 20]
            e = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            if all(c in "0123456789" for c in w):
                kind = "digits"
            elif all(c in "0123456789abcdefABCDEF" for c in w) and any(c in "0123456789" for c in w):
                kind = "hex"
            else:
                kind = "letters" if w.isalpha() else "mixed"
            if e >= secrets.THRESHOLDS[kind] - 1e-9:
                covered[i : i + 20] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
        found += [(m.start() + a, 3, m.start() + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return sorted(found)


def samples(n=300, seed=0):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 12)):
            parts.append(r.choice([
                "word", "the-long-winding-road-of-words", "password: hunter22", "SECRET='ab'", "api_key=\"" + "".join(r.choice("abcdef0123456789") for _ in range(40)),
                "AKIA" + "".join(r.choice("ABCDEFGHIJ0123456789") for _ in range(r.randint(10, 20))), "".join(r.choice("abcdef0123456789") for _ in range(r.randint(15, 40))),
                "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.randint(18, 70))), "------------------------!", "é" * 30,
                "toſken=abcdefgh", "token:=x=y==123456", "123456789012345678901234567890", "550e8400-e29b-41d4-a716-446655440000", "a" * 500,
            ]))
        out.append(r.choice([" ", "\n", ""]).join(parts))
    return out


def test_scan_against_naive():
    for t in samples() + ["", "token=" * 50, "-" * 5000 + "!"]:
        assert secrets.scan(t) == naive_spans(t)


def test_digit_runs_can_be_secrets():
    assert secrets.scan("id 83920174650918273645 end") == [(3, 3, 23)]
    assert secrets.scan("id 11111222221111122222 end") == []


def test_long_words_enter_whole():
    assert len(toxicity._grams("a" * 90)) == 90
    assert toxicity._grams("a" * 60 + "bad") != toxicity._grams("a" * 60 + "dab")


def test_secret_query(spark, sf_dir):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op2_secret_scan"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = naive_spans(rows[r.doc_id])
        text = lambda s: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s)
        assert r.spans == text(spans)
        assert r.base_sha256 == hashlib.sha256(text([s for s in spans if s[1] < 3]).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_secrets_hostile_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 0), (2, "password=abcdef12 x", 1), (2, "password=abcdef12 x", 1)], "doc_id long, text string, n_chars long")
    df = df.selectExpr("*", "'s' as spans", "1 as n_hex")
    got = secrets.digest(secrets.find_secrets(df)).collect()
    assert sorted(r.n_assign for r in got) == [0, 0, 1, 1]
    out = secrets.redact_docs(df)
    assert out.columns == df.columns
    assert sorted((r.text or "-", r.n_chars) for r in out.select("text", "n_chars").collect() if r.text) == [("[SECRET] x", 10)] * 2
    assert secrets.digest(secrets.find_secrets(df.limit(0))).count() == 0


def test_gradients():
    n = toxicity.Network({"a": 1, "b": 2}, np.array([0.5, -0.5], np.float32), 1)
    inputs = n.word_inputs(["a", "b", "cde"])
    at = np.full((2, toxicity.WINDOW), -1)
    at[0, :3], at[1, :2] = [0, 1, 2], [2, 0]
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    y = np.array([1, 0])
    g = n.gradients(inputs, n.vectors(inputs).astype(np.float64), at, y, np.ones(2))

    def loss():
        return np.mean(np.log1p(np.exp(-n.logits(n.vectors(inputs).astype(np.float64), at) * (2 * y - 1))))

    for k, flat in ((k, v.ravel()) for k, v in n.p.items()):
        for i in np.argsort(-abs(g[k].ravel()))[:2]:
            flat[i] += 1e-3
            up = loss()
            flat[i] -= 2e-3
            down = loss()
            flat[i] += 1e-3
            assert abs(g[k].ravel()[i] - (up - down) / 2e-3) < 1e-4, k


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 72, 73, 500):
        covered = {i for s in toxicity.window_starts(n) for i in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n))


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in test for b, y in test if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.75  # six toxic documents are held out at this size


def test_toxicity_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, "x y"), (2, "")], "doc_id long, text string").selectExpr("*", "0.5 as score", "1 as toxic")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(df, none) is None
    assert [r.score for r in toxicity.score(df, None).collect()] == [0.0] * 3
    net = toxicity.train(["bad words here"] * 6 + ["fine words there"] * 6, [1] * 6 + [0] * 6)
    assert toxicity.score(df, net).count() == 3 and toxicity.score(df.limit(0), net).count() == 0


def test_pipeline_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({queries.QUALITY_SQL}) where kept").fetchall()}
    docs = [r for r in con.sql("select doc_id, text from documents order by doc_id").fetchall() if r[0] in kept]
    docs = [r for r, c in zip(docs, near_brute(docs)) if c[0] == c[1]]
    least, texts = {}, {}
    for i, t in docs:
        raw = t.encode()
        for k in range(len(raw) - 49):
            least.setdefault(raw[k : k + 50], i)
    for i, t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        left = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any() or left.strip(" "):
            texts[i] = left
    texts = {i: secrets.redact(t, naive_spans(t)) for i, t in texts.items()}
    tokenizer = tokens.load("word_bpe_49k.json")
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    got = {}
    pieces = corpus_pipeline.run(spark, d).orderBy("doc_id", "start").collect()
    for p in pieces:
        assert p.start == len(got.setdefault(p.doc_id, []))
        got[p.doc_id] += np.frombuffer(p.ids, "<u2").tolist()
    assert got == want
    assert sum(p.length for p in pieces) == sum(map(len, want.values()))


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert suffixes.WINDOW == 50
