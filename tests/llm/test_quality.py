"""Quality rules against a plain count over hostile rows."""

import re

import pytest

from tidemark.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def counted(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(held), failed,
    )


GOOD = " ".join(f"the n{i}a and of{i} is word{i}" for i in range(12))
TEXTS = [
    None, "", " ", "\n\n\x0b\x0c\r\t", "word", "a b c a b c", "a a a a a", "a a", GOOD, GOOD, "same\nsame\n\nsame \n", "x" * 200_000,
    " ".join(f"w{i} the of" for i in range(1500)), "the of and " * 400, "é ü   日本 🙂\x1c🙂", "# * $ % & | < > !?",
    "\r\n".join(["line the of"] * 30), GOOD + " " + GOOD, "a b c\nb c a\nc a b", "\x00 nul \x00 nul \x00 nul",
]


def test_counts_on_hostile_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, GOOD)], "doc_id long, text string")
    got = quality.judge(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = GOOD if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(text), r.doc_id
        assert r.kept is False if r.base_failed else r.kept in (True, False)
    assert {r.doc_id for r in got if r.kept} >= {8, 9, None}


def test_keep_good_with_clashing_columns(spark):
    names = ["_text", "_words", "_row", "_lines", "kept", "n_words", "base_failed", "_hashes", "_in_text"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate([GOOD, None, GOOD])]
    out = quality.keep_good(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", *names]
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize("f", [quality.judge, quality.keep_good])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_of_any_name_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang as `a.b`", "2.0 as n_words")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in quality.judge(docs.select("doc_id", "text")).select("doc_id", "kept").collect() if r.kept}
    assert kept and {r.doc_id: r["a.b"] for r in got.collect()} == {r.doc_id: r["a.b"] for r in docs.collect() if r.doc_id in kept}
