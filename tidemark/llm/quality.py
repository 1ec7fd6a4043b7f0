"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null and empty texts have no words: they fail the base rule and are not kept. Texts of any length are judged whole;
repeated rows are judged alike, and columns the rules don't need pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \\t\\n\\u000b\\u000c\\r"

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for on was with as are this by from be at "
    "der die das und den von zu mit ist des auf für im nicht eine ein dem sich "
    "de la le les des et en un une du que qui dans pour est par sur au "
    "el los las del y una por con se para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are SQL expressions over the counts that ``counts`` projects.
RULES = (
    Rule("word_chars / nullif(n_words, 0)", 2.5, 12.0),
    Rule("n_symbols / nullif(n_words, 0)", high=0.1),
    Rule("n_marks / nullif(n_words, 0)", high=0.25),
    Rule("n_stop", low=2),
    Rule("n_dup_lines / greatest(n_lines, 1)", high=0.5),
    Rule("n_bullets / greatest(n_lines, 1)", high=0.9),
    Rule("n_ellipsis / greatest(n_lines, 1)", high=0.3),
)

BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def compile_rules(rules=RULES) -> Column:
    """One Boolean expression that holds where every rule does; a null measure fails its rule."""
    tests = []
    for r in rules:
        if r.low is not None:
            tests.append(f"coalesce(({r.measure}) >= {r.low!r}D, false)")
        if r.high is not None:
            tests.append(f"coalesce(({r.measure}) <= {r.high!r}D, false)")
    return F.expr(" AND ".join(tests) or "true")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules read; helper columns start with an underscore and are dropped at the end."""
    stops = ", ".join(f"'{w}', '{w.capitalize()}', '{w.upper()}'" for w in dict.fromkeys(STOP_WORDS))
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    flat = "_text"
    for c in SPACE[1:].split("\\")[1:]:
        flat = f"replace({flat}, '\\{c}', ' ')"
    df = df.withColumn("_words", F.expr(f"array_remove(split({flat}, ' '), '')"))
    df = df.withColumn("_lines", F.expr("filter(split(_text, '\n'), x -> btrim(x, '" + SPACE + "') != '')"))
    df = df.withColumns({
        "n_words": F.expr("cast(size(_words) as bigint)"),
        "word_chars": F.expr("cast(length(array_join(_words, '')) as bigint)"),
        "n_symbols": F.expr("cast(regexp_count(_text, '[#*$%&|<>]') as bigint)"),
        "n_marks": F.expr("cast(regexp_count(_text, '[!?]') as bigint)"),
        "n_lines": F.expr("cast(size(_lines) as bigint)"),
        "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)"),
        "n_bullets": F.expr("cast(size(filter(_lines, x -> ltrim(x) rlike '^[-*\u2022]')) as bigint)"),
        "n_ellipsis": F.expr("cast(size(filter(_lines, x -> rtrim(x) like '%...' or rtrim(x) like '%\u2026')) as bigint)"),
        "n_stop": F.expr(f"cast(size(array_intersect(_words, array({stops}))) as bigint)"),
        "_hashes": F.expr(
            "if(size(_words) < 4, cast(array() as array<bigint>),"
            " transform(sequence(1, size(_words) - 2), i -> xxhash64(_words[i - 1], _words[i], _words[i + 1])))"
        ),
    })
    # Windows sorted by hash: equal ones meet; where no hash repeats, nothing is sorted. The words themselves decide.
    df = df.withColumn(
        "_windows",
        F.expr(
            "if(size(array_distinct(_hashes)) = size(_hashes), cast(array() as array<struct<h:bigint,p:int>>),"
            " sort_array(transform(_hashes, (h, i) -> struct(h, i as p))))"
        ),
    )
    same = (
        "_words[{a}.p] = _words[{b}.p] and _words[{a}.p + 1] = _words[{b}.p + 1] and _words[{a}.p + 2] = _words[{b}.p + 2]"
    )
    near = "coalesce(get(_windows, k {d}).h = x.h and " + same.format(a="x", b="get(_windows, k {d})") + ", false)"
    df = df.withColumn(
        "_starts",
        F.expr(
            f"sort_array(transform(filter(_windows, (x, k) -> {near.format(d='- 1')} or {near.format(d='+ 1')}), x -> x.p))"
        ),
    )
    df = df.withColumn(
        "n_repeat_words",
        F.expr(
            "aggregate(transform(_starts, (p, k) -> if(k = 0, 3, least(3, p - get(_starts, k - 1)))),"
            " 0L, (a, x) -> a + cast(x as bigint))"
        ),
    )
    return df.drop("_text", "_words", "_lines", "_hashes", "_windows", "_starts")


EXTRA = ("n_marks", "n_lines", "n_bullets", "n_ellipsis", "n_stop")


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept``. A projection: no shuffle, no Python, one pass over the scan."""
    df = counts(docs, text).withColumn("base_failed", F.expr(BASE_FAILED))
    return df.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with their columns."""
    df = docs.select(*(F.col(f"`{c}`").alias(f"_in_{c}") for c in docs.columns if c != "text"), "text")
    # The row number keeps the optimizer from pushing the verdict below the counts, which would write every count out
    # again inside the predicate and grow the plan without bound.
    judged = judge(df, rules).withColumn("_row", F.monotonically_increasing_id()).filter("kept and _row >= 0")
    return judged.select(*("text" if c == "text" else F.col(f"`_in_{c}`").alias(c) for c in docs.columns))
