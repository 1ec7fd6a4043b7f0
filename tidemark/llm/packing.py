"""Packing by concatenate and cut.

First pass: each task encodes its documents, keeps a running start within its partition and writes the ids. One row per
partition gives token totals, whose prefix sum is each partition's global offset. Second pass: a document's global start
decides where the fixed windows cut it, without any shuffle of ids. Every window but the last is full, so nothing is
padded but the end of the last one. Pieces that continue a document over a window's boundary say so (``continues``).

Null texts are empty documents of the end id alone; null and repeated doc_ids keep a row per document; a very long text
spans as many windows as it needs; an empty table gives no pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import leaving_nothing, slices, stored, texts_of, with_part_offsets

SEQUENCE = 2048

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " continues boolean, ids binary"
)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """First pass: (part, part_pos, doc_id, n, ids) with ids as 16-bit little-endian, written to the shared folder."""
    if tokens.load(tokenizer).get_vocab_size() > 1 << 16:
        raise ValueError("ids are kept in 16 bits; choose a vocabulary of at most 65,536")

    def run(batches):
        from pyspark import TaskContext

        part, pos = TaskContext.get().partitionId(), 0
        cache, end = tokens.library_cache(tokenizer, False), np.array([end_id], "<u2").tobytes()
        for b in slices(batches):
            ids, n = cache.encode_flat(texts_of(b["text"]))
            raw, ends = ids.astype("<u2").tobytes(), (2 * np.cumsum(n)).tolist()
            coded = pa.array([raw[s:e] + end for s, e in zip([0, *ends], ends)], pa.binary())
            n = n + 1
            at = pos + np.cumsum(n) - n
            pos += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part), pa.int32()), pa.array(at), b["doc_id"], pa.array(n), coded], ["part", "part_pos", "doc_id", "n", "ids"]
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(src.mapInArrow(leaving_nothing(run), "part int, part_pos long, doc_id long, n long, ids binary"))


def cut(coded: DataFrame, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Second pass: pieces of all documents; ``ids`` holds a piece's 16-bit ids if with_ids."""
    placed = with_part_offsets(coded, "part", "n", "part_start")

    def run(batches):
        tokens.forget()  # the first pass is over
        for b in slices(batches, "ids"):
            rows = []
            for doc, at, base, raw in zip(*(b[c].to_pylist() for c in ("doc_id", "part_pos", "part_start", "ids"))):
                g, n, wide = at + base, len(raw) // 2, np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                bounds = [g, *range((g // sequence + 1) * sequence, g + n, sequence), g + n]
                for p, q in zip(bounds, bounds[1:]):
                    a, z = p - g, q - g
                    rows.append((doc, a, z - a, zlib.crc32(wide[4 * a : 4 * z]), n, p // sequence, p % sequence, a > 0, raw[2 * a : 2 * z] if with_ids else None))
            if rows:
                types = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues", "ids"],
                )

    return placed.select("doc_id", "part_pos", "part_start", "ids").mapInArrow(leaving_nothing(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    return cut(encoded(docs, tokenizer, end_id), sequence, with_ids)
