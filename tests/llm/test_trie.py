import hashlib
import math
import re
import zlib

import duckdb
import pytest

from tidemark.llm import queries, trie

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    """Nodes of (conv_id, turn, role, text) rows, one prefix at a time."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), x))
    own = {c: [(r, x) for *_, r, _, x in sorted(s)] for c, s in own.items()}
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        s = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(s) + 1):
            members, ends = nodes.setdefault(tuple(s[:d]), ([], []))
            members.append(c)
            if d == len(s):
                ends.append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        mine = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in mine) if mine else 1
        saved[k] = sum(saved[x] for x in mine) + ((len(nodes[k][0]) - 1) * len(WORDS.findall(k[-1][1])) if k else 0)
    sha = lambda e: hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()
    return sorted(
        ((min(m), len(k), min(nodes[k[:-1]][0]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], sha(e)) for k, (m, e) in nodes.items()), key=str
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_and_sql(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = rows_of(queries.QUERIES["op11_burst_trie"](spark, sf_dir))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert got == sorted(con.execute(queries.TRIE_SQL).fetchall(), key=str)


def hostile():
    rows = [(c, t, "user", f"turn {t} a") for c in range(40, 58) for t in range(c % 5)]  # shared starts, some without own turns
    rows += [(0, None, None, None), (0, 3, "user", "x"), (0, 3, "user", "x"), (0, 3, "system", "x"), (1, 0, "user", ""), (1, 1, "", "user")]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "below zero"), (-20, 0, "user", "y"), (-20, 1, "user", "z"), (23, 0, "a", "b"), (23, 0, "ab", "")]
    rows += [(c, t, "user", f"long {t}" + (" end" if t == 25 + c % 3 else "")) for c in (1000, 1001, 1002, 1003, 1021) for t in range(26 + c % 3)]
    rows += [(c, t, "user", "copy") for c in range(200, 230) for t in range(9)]  # one path
    return rows + [(60 + c, t, "user", "x" * (t + 1) if t < c else "tail") for c in range(12) for t in range(c + 1)]  # a caterpillar


@pytest.mark.parametrize("limits", [(1024, 1 << 16, 4096), (2, 10, 9)])
def test_hostile_rows(spark, monkeypatch, limits):
    """Bursting by number and by length, and paths cut into levels, give the same nodes."""
    for name, value in zip(("PATHS", "TURNS", "LONG"), limits):
        monkeypatch.setattr(trie, name, value)
    rows = hostile()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as words", "2 as depth", "3 as `a.b`")
    assert rows_of(trie.prefix_trie(df)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).count() == 0 and trie.prefix_trie(df).columns == trie.RESULT


def test_many_ends_are_hashed_in_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 100)
    rows = [(c, b"a" if c % 3 else b"b") for c in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, key binary").select("key", "conv_id").repartition(5)
    want = {k: hashlib.sha256(",".join(str(c) for c, key in rows if key == k).encode()).hexdigest() for k in (b"a", b"b")}
    assert {bytes(r.key): r.ends for r in trie.ends_of(df).collect()} == want
