"""Token-id files compressed by Re-Pair, with random access.

Documents are dealt to shards in ascending doc_id order. In each shard frequent id pairs are replaced by new symbols
(nonterminals) in rounds, until no pair is frequent any more: a round takes the most frequent pairs that cannot overlap,
replaces every occurrence, and brings the counts of the pairs around these places up to date. No pair crosses a document's end, so each document expands on its own; every rule's expansion
length is stored, so a range of ids is found without expanding what lies before it.

File format (one Parquet row per shard, binary fields little-endian): part, shard, before (ids of the part's earlier
shards), n_ids, doc_ids int64, doc_nulls (a bit per document, set where its doc_id is null), doc_lengths
uint32 (ids per document), doc_symbols uint32 (symbols per document), left/right uint32 and lengths uint32 (rules; rule r
is symbol base + r), base, width (bytes per symbol: 2, or 3 with the highest bytes behind the rest), symbols.

Null texts are empty documents that hold the end id only. Rows with a null or repeated doc_id keep a row each (nulls
first, equal ones in any order, spread over partitions). Very long documents stay whole in a shard of their own size. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import slices, stored, texts_of, with_part_offsets

SHARD_IDS = 400_000
#: A rule takes 12 bytes and an occurrence of its pair saves 2 to 3, so rarer pairs are no gain.
MIN_COUNT, MAX_SYMBOLS = 6, 1 << 24
#: Pre-tokens a worker keeps (some 150 bytes each): new ones become rarer with every text, and a forgotten one is encoded anew.
CACHE_WORDS = 1_200_000

SHARD_SCHEMA = (
    "part int, shard int, before long, n_docs long, n_ids long, base int, width int, doc_ids binary, doc_nulls binary, doc_lengths binary,"
    " doc_symbols binary, left binary, right binary, lengths binary, symbols binary"
)

_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
SHARD_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in SHARD_SCHEMA.split(", "))])


def _choose(keys: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """The most frequent pairs of which none can overlap another: no symbol is a left and a right part at once. Pairs
    far less frequent than the first wait for a later round, in which they may have become part of others."""
    often = np.flatnonzero(counts * 64 > counts.max())
    order = often[np.lexsort((keys[often], -counts[often]))]
    best = keys[order]
    sides, taken = bytearray(int(max((best >> 32).max(), (best & 0xFFFFFFFF).max())) + 1), []  # 1: a left part, 2: a right part
    for k, a, b in zip(best.tolist(), (best >> 32).tolist(), (best & 0xFFFFFFFF).tolist()):
        if sides[a] & 2 or sides[b] & 1:
            continue
        sides[a] |= 1
        sides[b] |= 2
        taken.append(k)
        if len(taken) == limit:
            break
    return np.array(sorted(taken), np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(keys)
    start = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[start], np.diff(np.append(start, len(found)))


def compress(ids: np.ndarray, last: np.ndarray, base: int, max_symbols: int = MAX_SYMBOLS, min_count: int = MIN_COUNT):
    """(symbols, last, left, right, lengths): ``last`` marks each document's last id, over which no pair goes.

    Rounds go on until no pair occurs ``min_count`` times. Pairs are counted once; then a round takes off what stood
    around its replaced places and adds what stands there now. Pairs of older symbols only become rarer, so what is
    once below the least count is forgotten."""
    sym, left, right = ids.astype(np.int64), [], []
    lengths = np.ones(base, np.int64)
    key = lambda at: sym.take(at) << 32 | sym.take(at + 1)
    keys, counts = _counted(key(np.flatnonzero(~last[:-1])))
    while True:
        often = counts >= min_count
        keys, counts = keys[often], counts[often]
        if not len(keys) or len(lengths) >= max_symbols:
            break
        chosen = _choose(keys, counts, max_symbols - len(lengths))
        side = np.zeros(len(lengths), np.uint8)  # 1: a left part, 2: a right part, 3: both (a pair of one symbol)
        side[chosen >> 32] = 1
        side[chosen & 0xFFFFFFFF] |= 2
        mine = side.take(sym)
        at = np.flatnonzero((mine[:-1] & (mine[1:] >> 1)).view(bool) & ~last[:-1])
        found = key(at)
        rule = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
        ok = chosen[rule] == found
        at, rule = at[ok], rule[ok]
        first = np.concatenate([[True], np.diff(at) != 1])[: len(at)]  # in runs of one symbol every other pair is replaced
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        ok = (np.arange(len(at)) - run) % 2 == 0
        at, rule = at[ok], rule[ok]
        # Pairs by the place of their left symbol: each replaced pair and its neighbours, once each.
        before = (at - 1)[np.concatenate([[True], np.diff(at) != 2])[: len(at)]]
        around = np.concatenate([before[before >= 0], at, (at + 1)[at + 2 < len(sym)]])
        gone, less = _counted(key(around[~last[around]]))
        sym[at] = len(lengths) + rule
        last = last.copy()
        last[at] |= last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        now = at - np.arange(len(at))  # where the new symbols stand
        sym, last = sym[keep], last[keep]
        before = (now - 1)[np.concatenate([[True], np.diff(now) != 1])[: len(now)]]
        around = np.concatenate([before[before >= 0], now[now + 1 < len(sym)]])
        new, more = _counted(key(around[~last[around]]))
        where = np.minimum(np.searchsorted(keys, gone), len(keys) - 1)
        hit = keys[where] == gone
        counts[where[hit]] -= less[hit]
        young = (new >> 32 >= len(lengths)) | (new & 0xFFFFFFFF >= len(lengths))
        keys, counts = np.concatenate([keys, new[young]]), np.concatenate([counts, more[young]])
        again, back = new[~young], more[~young]  # touched twice over: not really gone
        if len(again):
            where = np.minimum(np.searchsorted(keys[: len(keys) - int(young.sum())], again), len(keys) - 1)
            hit = keys[where] == again
            counts[where[hit]] += back[hit]
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        left.append(chosen >> 32)
        right.append(chosen & 0xFFFFFFFF)
        lengths = np.concatenate([lengths, lengths[left[-1]] + lengths[right[-1]]])
    none = np.zeros(0, np.int64)
    return sym, last, np.concatenate([none, *left]), np.concatenate([none, *right]), lengths[base:]


def _planes(sym: np.ndarray, width: int) -> bytes:
    """Symbols of two bytes each or, with a third, in a plane of its own behind the others."""
    return sym.astype("<u2").tobytes() + ((sym >> 16).astype(np.uint8).tobytes() if width == 3 else b"")


def expand(sym: np.ndarray, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: each pass writes out all nonterminals by one level."""
    sym = sym.astype(np.int64)
    while len(at := np.flatnonzero(sym >= base)):
        rule = sym[at] - base
        width = np.ones(len(sym), np.int64)
        width[at] = 2
        to = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[to] = sym
        out[to[at]] = left[rule]
        out[to[at] + 1] = right[rule]
        sym = out
    return sym


class Shard:
    """A shard row as read back; documents and ranges of ids are decoded on demand."""

    def __init__(self, row: dict):
        ints = {k: np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("doc_lengths", "doc_symbols", "left", "right", "lengths")}
        self.__dict__.update(ints)
        self.base = row["base"]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.doc_nulls = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8), count=len(self.doc_ids)).astype(bool)
        n = len(row["symbols"]) // row["width"]
        self.symbols = np.frombuffer(row["symbols"], "<u2", n).astype(np.int64)
        if row["width"] == 3:
            self.symbols |= np.frombuffer(row["symbols"], np.uint8, n, 2 * n).astype(np.int64) << 16
        self.ends = np.cumsum(self.doc_symbols)

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[self.ends[i] - self.doc_symbols[i] : self.ends[i]], self.base, self.left, self.right)

    def range(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of document i; only symbols whose expansion meets the range are expanded."""
        sym = self.symbols[self.ends[i] - self.doc_symbols[i] : self.ends[i]].astype(np.int64)
        size = np.ones(len(sym), np.int64)
        big = sym >= self.base
        size[big] = self.lengths[sym[big] - self.base]
        end = np.cumsum(size)
        a, b = np.searchsorted(end, start, "right"), np.searchsorted(end - size, stop, "left")
        skip = start - (int(end[a] - size[a]) if a < len(end) else start)
        return expand(sym[a:b], self.base, self.left, self.right)[skip : skip + stop - start]

    def all(self) -> np.ndarray:
        """Every document's ids: rules are written out once, then all symbols in one gather."""
        flat = expand(self.base + np.arange(len(self.left)), self.base, self.left, self.right)
        table = np.concatenate([np.arange(self.base), flat]).astype(np.uint32)
        size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        begin = np.cumsum(size) - size
        return tokens.taken(table, begin.take(self.symbols), size.take(self.symbols))


def _shard_row(part: int, shard: int, docs: list, coded: list[bytes], base: int, before: int = 0) -> dict:
    ids = np.frombuffer(b"".join(coded), "<u4")
    n = np.array([len(c) // 4 for c in coded], np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(n) - 1] = True
    sym, last, left, right, lengths = compress(ids, last, base)
    ends = np.flatnonzero(last) + 1
    width = 2 if base + len(left) <= 1 << 16 else 3
    u4 = lambda x: x.astype("<u4").tobytes()
    return {
        "part": part, "shard": shard, "before": before, "n_docs": len(docs), "n_ids": len(ids), "base": base, "width": width,
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "doc_nulls": np.packbits([d is None for d in docs]).tobytes(), "doc_lengths": u4(n),
        "doc_symbols": u4(np.diff(np.concatenate([[0], ends]))), "left": u4(left), "right": u4(right), "lengths": u4(lengths),
        "symbols": _planes(sym, width),
    }


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes, orders by doc_id, compresses and writes; returns the rows of the written files, read back."""
    base = tokens.load(tokenizer).get_vocab_size()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def pack(batches):
        from pyspark import TaskContext

        part, shard, before, docs, coded, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        cache = tokens.library_cache(tokenizer, True, CACHE_WORDS)
        end = np.array([end_id], "<u4").tobytes()

        def row():
            return pa.RecordBatch.from_pylist([_shard_row(part, shard, docs, coded, base, before)], SHARD_ARROW)

        for b in slices(batches):
            for d, c in zip(b["doc_id"].to_pylist(), cache.encode_texts(texts_of(b["text"]))):
                docs.append(d)
                coded.append(c + end)
                size += len(c) // 4 + 1
                if size >= shard_ids:
                    yield row()
                    shard, before, docs, coded, size = shard + 1, before + size, [], [], 0
        if docs:
            yield row()

    # Range bounds are sampled from the bare scan; encoding comes after the shuffle, so it runs once.
    # The salt spreads equal ids; unlike a hash of the text it costs the sampling no look at the texts.
    order = [F.asc_nulls_first("doc_id"), "_salt"]
    ordered = src.withColumn("_salt", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    return stored(ordered.mapInArrow(pack, SHARD_SCHEMA))


def read_documents(shards: DataFrame) -> DataFrame:
    """Decodes shards: one row per document with doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = with_part_offsets(shards, "part", "n_ids", "part_start").withColumn("start", F.col("part_start") + F.col("before"))

    def decode(batches):
        import zlib

        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                ids = shard.all().astype("<u4")
                ends = np.cumsum(shard.doc_lengths)
                begins = ends - shard.doc_lengths
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begins.tolist(), ends.tolist())]
                doc = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_nulls)
                start = pa.array(begins + row["start"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc, start, pa.array(shard.doc_lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array(shard.doc_symbols, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"],
                )

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")
