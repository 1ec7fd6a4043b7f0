"""Secret scans: pattern matches plus sliding-window Shannon entropy over candidate strings.

Base kinds (assign, access, hex) are the leftmost non-overlapping matches of fixed patterns; matches that are too short
are dropped. The entropy scan looks at every maximal run of token characters: a window slides over the run, counts are
updated as one character enters and one leaves, and windows whose entropy reaches the threshold of their character
class are merged into one span. Runs on the allow-list are suppressed.

Null and empty texts have no spans. Texts are scanned whole, whatever their length; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import released, slices, texts_of

KINDS = ("assign", "access", "hex", "entropy")

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more are the long ones among all maximal runs
MIN_ASSIGN, MIN_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WINDOW = 20
#: Entropy in bits per character that a window must reach, by the class of its characters (ten digits give 3.32 at most).
THRESHOLDS = {"digits": 2.9, "hex": 2.6, "letters": 4.1, "mixed": 3.7}

#: Candidates matching one of these are no secrets: UUIDs, words joined by marks, one repeated character, and paths.
ALLOW = (
    re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"),
    re.compile(r"[-_/=+]*(?:[A-Za-z][a-z]*[-_/=+]+)*(?:[A-Za-z][a-z]*)?"),
    re.compile(r"[A-Z]+(?:[-_/=+]+[A-Z]+)*"),
    re.compile(r"(.)\1*"),
)

_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 2)]
_DIGIT, _HEX_LETTER = frozenset("0123456789"), frozenset("abcdefABCDEF")


def _class(digits: int, hexes: int, letters: int, window: int) -> str:
    if digits == window:
        return "digits"
    if digits + hexes == window and digits:
        return "hex"
    return "letters" if letters == window else "mixed"


def entropy_spans(run: str, window: int = WINDOW, thresholds=THRESHOLDS) -> Iterator[tuple[int, int]]:
    """Merged [start, end) ranges of the windows of ``run`` whose entropy reaches their class's threshold."""
    count: dict[str, int] = {}
    total = 0.0  # sum of n * log2(n) over the counts
    digits = hexes = letters = 0
    start = end = -1
    log_w = math.log2(window)
    for i, c in enumerate(run):
        n = count.get(c, 0)
        count[c] = n + 1
        total += _NLOGN[n + 1] - _NLOGN[n]
        digits += c in _DIGIT
        hexes += c in _HEX_LETTER
        letters += c.isalpha()
        if i >= window:
            out = run[i - window]
            n = count[out]
            count[out] = n - 1
            total += _NLOGN[n - 1] - _NLOGN[n]
            digits -= out in _DIGIT
            hexes -= out in _HEX_LETTER
            letters -= out.isalpha()
        if i >= window - 1 and log_w - total / window >= thresholds[_class(digits, hexes, letters, window)] - 1e-9:
            if start >= 0 and i - window + 1 <= end:
                end = i + 1
            else:
                if start >= 0:
                    yield start, end
                start, end = i - window + 1, i + 1
    if start >= 0:
        yield start, end


def scan(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, index in KINDS, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not any(a.fullmatch(run) for a in ALLOW):
            found += [(m.start() + a, 3, m.start() + b) for a, b in entropy_spans(run)]
    found.sort()
    return found


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``spans`` (array of kind, start, end in code points). One Arrow pass over id and text, no shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in slices(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] for t in texts_of(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(spans, kind)], ["doc_id", "spans"])

    return src.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text, from ``find_secrets``' rows."""
    order = "array_position(array('assign','access','hex','entropy'), x.kind)"
    ranked = found.withColumn(
        "spans", F.expr(f"transform(sort_array(transform(spans, x -> struct(x.start, {order} as k, x.end, x.kind))), x -> x)")
    )
    text = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(spans, x -> x.kind != 'entropy')"
    count = "cast(size(filter(spans, x -> x.kind = '{0}')) as bigint) as n_{0}"
    return ranked.selectExpr(
        "doc_id", *(count.format(k) for k in KINDS), f"sha2({text.format(base)}, 256) as base_sha256", f"{text.format('spans')} as spans"
    )


def redact_docs(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark; ``n_chars``, where there, follows. Null texts stay null."""

    @F.pandas_udf("string")
    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([None if t is None else redact(t, s) if (s := scan(t)) else t for t in texts], dtype=object)
        released()

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
