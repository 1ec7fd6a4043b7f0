"""Suffix-array dedup: every byte covered by a 50-byte string that also starts in a smaller document goes.

Spark brings equal strings together, suffix arrays decide. Each 50-byte window is assigned to its minimizer: the
leftmost smallest hash among the short strings inside it. Equal windows have equal minimizers, so they meet:

1. A task sends the minimizers of its texts, as packed arrays, to ranges of hash values; a range's task finds those that
   more than one document holds and answers to buckets of documents.
2. Runs of shared minimizers are cut into stretches by content, so equal passages give equal stretches. Those are
   aggregated to one with its smallest document: every other document is covered by it there.
3. Each different stretch sends its minimizers with their windows (about 65 bytes) to ranges again; the different
   pieces of a minimizer are suffix-sorted, and windows that meet in the suffix array share the smallest document.
   The windows of a frequent minimizer (``HOT``) are compared one by one instead, by their digests in an aggregation
   that Spark combines in every task, so that no task gathers all its contexts.
4. Covered ranges return to their documents, which cut them out.

Copies are never expanded into pairs: a string that many documents hold is one piece with one smallest document, and a
task sends a hot minimizer to its range once. Tables of earlier steps are deleted once their successor is written.

The suffix array is built by linear grouping: suffixes are first grouped by their Lyndon prefix, by handling groups in
descending order and moving what precedes each group (previous-smaller pointers) behind its own group's rest; then each
group's order is emitted in one ascending pass. Nothing is renamed and nothing recurses.

Null texts are empty; rows with a null doc_id have no smaller document and are none; rows that repeat a doc_id are judged
each on its own text, and do not cover each other; texts of any length are used whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, dropped, released, restored, slices, stored, texts_of
from tidemark.llm.tokens import gather

WINDOW, GRAM = 50, 20
#: Bytes of text per range of hash values.
RANGE_BYTES = 6_000_000
#: Bytes of text whose minimizers a task sends at once.
PART_CHARS = 6_000_000
#: A minimizer that stands in so many places is frequent; so many of the most frequent ones at most are listed.
HOT, HOT_LIST = 4096, 1 << 20


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by grouping; the last symbol must be the only smallest one."""
    n = len(text)
    size: dict[int, int] = {}
    for c in text:
        size[c] = size.get(c, 0) + 1
    start, at = {}, 0
    for c in sorted(size):
        start[c] = at
        at += size[c]
    group = [start[c] for c in text]  # a group's name is where it starts in the array
    length = {start[c]: size[c] for c in size}
    array, place, fill = [0] * n, [0] * n, dict(start)
    for i, c in enumerate(text):
        array[fill[c]] = i
        place[i] = fill[c]
        fill[c] += 1
    smaller = [-1] * n  # previous suffix of a smaller group
    top = n - 1
    while top >= 0:
        g = group[array[top]]
        members = sorted(array[g : top + 1])
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in pointed.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):  # more repeats of this prefix behind it: further back
            moved: dict[int, int] = {}
            for p in by_count[c]:
                h = group[p]
                m = moved.get(h, 0)
                end = h + length[h] - 1 - m
                q, a = array[end], place[p]
                array[a], place[q] = q, a
                array[end], place[p] = p, end
                moved[h] = m + 1
            for h, m in moved.items():
                new = h + length[h] - m
                if m < length[h]:
                    length[h] -= m
                    length[new] = m
                    for p in array[new : new + m]:
                        group[p] = new
        top = g - 1
    out, nxt, placed = [0] * n, {g: g for g in length}, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[nxt[g]] = s
            nxt[g] += 1
            placed[s] = True
            s = smaller[s]
    return out


def window_owners(pieces: list[bytes], owners: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each piece (all different), the smallest owner of each of its windows among all pieces."""
    if len(pieces) == 1:
        return [np.full(max(len(pieces[0]) - window + 1, 0), owners[0], np.int64)]
    text: list[int] = []
    begin = []
    for p in pieces:
        begin.append(len(text))
        text += [c + 2 for c in p]
        text.append(1)
    text.append(0)
    joined = b"\x00".join(pieces)
    piece_of = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces])
    room = np.array([b + len(p) - window for b, p in zip(begin, pieces)])
    found = [np.full(max(len(p) - window + 1, 0), o, np.int64) for p, o in zip(pieces, owners)]
    run: list[int] = []
    last = None

    def close():
        least = min(owners[piece_of[i]] for i in run)
        for i in run:
            k = piece_of[i]
            found[k][i - begin[k]] = least

    for i in suffix_array(text):
        if i >= len(piece_of) or i > room[piece_of[i]]:
            continue  # too short for a window; such a suffix never parts equal windows' group
        here = joined[i : i + window]
        if here != last and run:
            close()
            run = []
        run.append(i)
        last = here
    if run:
        close()
    return found


_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
#: Positions inside a block have so many bits; minimizers are chosen by the other bits of the hash, then by position.
PLACE_BITS = 24
#: Short texts are hashed in groups of about this many bytes, which stay in a core's cache.
BLOCK = 1 << 16


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes (16 to 24 of them), from three loads of eight bytes."""
    wide = data.astype(np.uint64)
    for d in (1, 2, 4):
        wide = wide[:-d] | wide[d:] << np.uint64(8 * d)
    n = len(data) - gram + 1
    h = wide[:n] * _C[0]
    h ^= h >> np.uint64(29)
    h += wide[8 : 8 + n] * _C[1]
    h ^= h >> np.uint64(32)
    h *= _C[2]
    h += wide[gram - 8 : gram - 8 + n] * _C[3]
    h ^= h >> np.uint64(31)
    h *= _C[1]
    h ^= h >> np.uint64(32)
    return h


def _block_minimizers(data: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """Runs of windows with one minimizer, of texts joined in ``data``: (hash, text, first, last, place), in the block."""
    h = gram_hashes(data, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    low = h & ~mask | np.arange(len(h), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while width < span:  # minimum over twice the width each time; the last step overlaps
        d = min(width, span - width)
        low = np.minimum(low[d:], low[:-d])
        width += d
    ends = np.append(starts[1:], len(data))
    inside = np.ones(len(low), bool)  # windows that cross a text's end don't count
    for e in ends[:-1].tolist():
        inside[max(e - window + 1, 0) : e] = False
    at = np.flatnonzero(inside)
    place = (low[at] & mask).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))[: len(at)]
    first, last = at[cut], at[np.append(cut[1:], len(at)) - 1] if len(at) else at
    place = place[cut]
    return h[place], np.searchsorted(starts, first, "right") - 1, first, last, place


def minimizers(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """(hash, text, first window, last window, place) of each maximal run of windows of a text that share a minimizer.

    A minimizer is a window's gram of the smallest hash, the leftmost of equals. Texts too long for a block are hashed
    in overlapping parts."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    limit = 1 << PLACE_BITS

    def add(numbers: list[int], offsets: list[int], parts: list[bytes]) -> None:
        size = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(size) - size
        data = np.frombuffer(b"".join(parts), np.uint8)
        if len(data) < window:
            return
        h, t, first, last, place = _block_minimizers(data, starts, window, gram)
        base = np.array(offsets, np.int64)[t] - starts[t]
        for column, value in zip(out, (h, np.array(numbers, np.int64)[t], first + base, last + base, place + base)):
            column.append(value)

    numbers, parts, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t) < window:
            continue
        if len(t) > BLOCK:
            for a in range(0, len(t) - window + 1, limit - window):
                add([i], [a], [t[a : a + limit - 1]])
            continue
        numbers.append(i)
        parts.append(t)
        size += len(t)
        if size > BLOCK:
            add(numbers, [0] * len(parts), parts)
            numbers, parts, size = [], [], 0
    if parts:
        add(numbers, [0] * len(parts), parts)
    if not out[0]:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    found = [np.concatenate(c) for c in out]
    order = np.argsort(found[1], kind="stable")  # long texts went ahead of shorter ones
    return tuple(c[order] for c in found)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _reach(parts: list[bytes]) -> list[int]:
    """For each string, its longest common prefix with any other: sorted neighbours have it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    near = [_common(parts[i], parts[j]) for i, j in zip(order, order[1:])]
    out = [0] * len(parts)
    for k, i in enumerate(order):
        out[i] = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
    return out


def piece_owners(pieces: list[bytes], middles: list[int], owners: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """``window_owners`` of pieces around one minimizer, at ``middles``. Only the part of a piece that reaches as far
    from the minimizer as it agrees with some other piece can hold a shared window; the rest is not sorted."""
    right = _reach([p[m:] for p, m in zip(pieces, middles)])
    left = _reach([p[:m][::-1] for p, m in zip(pieces, middles)])
    found = [np.full(len(p) - window + 1, o, np.int64) for p, o in zip(pieces, owners)]
    begin = [m - n for m, n in zip(middles, left)]
    kept = [i for i in range(len(pieces)) if left[i] + right[i] >= window]
    if kept:
        parts = [pieces[i][begin[i] : middles[i] + right[i]] for i in kept]
        least: dict[bytes, int] = {}
        for i, p in zip(kept, parts):
            least[p] = min(owners[i], least.get(p, owners[i]))
        sorted_out = dict(zip(least, window_owners(list(least), list(least.values()), window)))
        for i, p in zip(kept, parts):
            o = sorted_out[p]
            found[i][begin[i] : begin[i] + len(o)] = o
    return found


def _to_range(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Ranges of a second hash: minimizers are the smallest of their windows' hashes, so by themselves they crowd in the first
    ranges, 16 times the average there. Hashes that agree in their upper 48 bits share a range."""
    m = (h >> np.uint64(16)) * _C[0]
    m ^= m >> np.uint64(32)
    m *= _C[1]
    return ((m >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


SENT = "range int, docs binary, tids binary, buckets binary, hashes binary, times binary, local binary, first binary"
SHARED = "bucket int, docs binary, tids binary, local binary, first binary, hot long, times long"


def _batch(schema: str, columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _local(local: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The rows used, and places among them as packed bytes."""
    used, local = np.unique(local, return_inverse=True)
    return used, local.astype("<u4" if len(used) > 1 << 16 else "<u2").tobytes()


def _places(raw: bytes, n_rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if n_rows > 1 << 16 else "<u2")


def _short(h: np.ndarray) -> bytes:
    """The upper 48 bits of hashes: a false match costs a look at the bytes, no more."""
    return (h >> np.uint64(32)).astype("<u4").tobytes() + ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _long(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(raw, "<u2", n, 4 * n)


def _anchors_sent(n_ranges: int):
    """Packed minimizers, one row per range. Of those that two documents of a slice share, only one takes part in the
    search, with their number; the others need no range to find them out and are sent on as such (no hashes)."""

    def run(batches):
        for b in slices(batches, limit=PART_CHARS):
            released()
            docs, tids, buckets = (b[c].to_numpy() for c in ("doc_id", "tid", "bucket"))
            h, local, first, _, _ = minimizers([t.encode() for t in texts_of(b["text"])])
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, first, local = h[order], first[order], local[order]
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.append(cut, len(h)))
            d = docs[local]
            differ = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)
            sure = np.repeat(differ, times)
            sure[cut] = False
            rows = [[] for _ in range(8)]

            def send(to, keep, hashes, many):
                used, places = _local(local[keep])
                values = (to, docs[used].tobytes(), tids[used].tobytes(), buckets[used].astype("<i4").tobytes(), hashes, many, places, first[keep].astype("<u4").tobytes())
                for column, value in zip(rows, values):
                    column.append(value)

            if sure.any():
                send(int(np.bitwise_xor.reduce(tids ^ docs) % n_ranges), np.flatnonzero(sure), b"", b"")
            # All places of one document's repeated minimizer are looked for; of a shared one, its first place only.
            kept = np.flatnonzero(~sure)
            many = np.ones(len(h), np.int64)
            many[cut] = np.where(differ, times, 1)
            to = _to_range(h[kept], n_ranges)
            order = np.argsort(to, kind="stable")
            kept, to = kept[order], to[order]
            bounds = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                k = kept[s:e]
                send(int(to[s]), k, _short(h[k]), many[k].astype("<u4").tobytes())
            yield _batch(SENT, rows)

    return run


def _groups(batches, key: str):
    """Consecutive rows of a sorted partition by key, as lists of dicts. Rows are large: few of a batch are copied at once."""
    now, rows = None, []
    for b in batches:
        for r in (r for i in range(0, b.num_rows, 8) for r in b.slice(i, 8).to_pylist()):
            if r[key] != now and rows:
                yield now, rows
                rows = []
            now = r[key]
            rows.append(r)
    if rows:
        yield now, rows


def _dealt(sent: DataFrame, n_ranges: int) -> DataFrame:
    """Each range in a partition of its own. Dealt by hash, some task gets several, which Spark hands to it in one batch: that batch
    stands in the JVM, in the worker and as Python bytes at the same time."""
    return sent.repartitionById(n_ranges, F.col("range")).sortWithinPartitions("range")


def _shared_anchors(often_from: int):
    """Per range and bucket of documents: places of minimizers that several documents hold. Rows without a bucket name
    the frequent ones (48 bits) with their numbers."""

    def run(batches):
        for _, rows in _groups(batches, "range"):
            # What was sent on without hashes only goes to its buckets.
            for r in (r for r in rows if not r["hashes"]):
                docs, tids, buckets = (np.frombuffer(r[c], t) for c, t in (("docs", "<i8"), ("tids", "<i8"), ("buckets", "<i4")))
                yield answers(docs, tids, buckets, _places(r["local"], len(docs)).astype(np.int64), np.frombuffer(r["first"], "<u4"))
            rows = [r for r in rows if r["hashes"]]
            if not rows:
                continue
            docs, tids, buckets = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("docs", "<i8"), ("tids", "<i8"), ("buckets", "<i4")))
            before = np.cumsum([0] + [len(r["docs"]) // 8 for r in rows])
            local = np.concatenate([_places(r["local"], len(r["docs"]) // 8).astype(np.int64) + n for r, n in zip(rows, before)])
            first = np.concatenate([np.frombuffer(r["first"], "<u4") for r in rows])
            h = np.concatenate([_long(r["hashes"]) for r in rows])
            times = np.concatenate([np.frombuffer(r["times"], "<u4") for r in rows]).astype(np.int64)
            del rows
            order = np.argsort(h, kind="stable")
            hs, ds = h[order], docs[local[order]]
            cut = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
            number = np.add.reduceat(times[order], cut)
            differ = (np.minimum.reduceat(ds, cut) != np.maximum.reduceat(ds, cut)) | (np.maximum.reduceat(times[order], cut) > 1)
            keep = order[np.repeat(differ, np.diff(np.append(cut, len(hs))))]
            often = differ & (number >= often_from)
            yield answers(docs, tids, buckets, local[keep], first[keep], hs[cut[often]].tolist(), number[often].tolist())
        released()

    def answers(docs, tids, buckets, local, first, hot=(), number=()):
        out = [[] for _ in range(7)]
        order = np.argsort(buckets[local], kind="stable")
        local, first = local[order], first[order]
        owner = buckets[local]
        bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else [0]
        for s, e in zip(bounds[:-1], bounds[1:]):
            used, places = _local(local[s:e])
            values = (int(owner[s]), docs[used].tobytes(), tids[used].tobytes(), places, first[s:e].astype("<u4").tobytes(), None, None)
            for column, value in zip(out, values):
                column.append(value)
        for column in out[:5]:
            column += [None] * len(hot)
        out[5] += hot
        out[6] += number
        return _batch(SHARED, out)

    return run


def _hot_list(shared: DataFrame) -> np.ndarray:
    """The most frequent minimizers (48 bits), at most ``HOT_LIST`` of them: 8 bytes each on the driver and on workers."""
    found = shared.filter("bucket is null").orderBy(F.desc("times"), "hot").limit(HOT_LIST).select("hot").toArrow()["hot"]
    return np.sort(found.to_numpy().astype(np.uint64))


STRETCH = "s1 long, s2 long, doc_id long, tid long, start int, stretch binary, hot boolean"
#: One in so many minimizers ends a stretch, so that equal passages are cut alike wherever they stand.
CUT = 16


def _stretches(frequent):
    """Runs of shared minimizers of a bucket's documents, cut where a minimizer's hash says so; ``hot`` ones hold a
    frequent minimizer."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [t.encode() for t in texts_of(left["text"])]
        docs, tids = (left[c].to_numpy() for c in ("doc_id", "tid"))
        row_of = {k: i for i, k in enumerate(zip(docs.tolist(), tids.tolist()))}
        held = []
        for r in right.to_pylist():
            rows = zip(np.frombuffer(r["docs"], "<i8").tolist(), np.frombuffer(r["tids"], "<i8").tolist())
            row = np.array([row_of.get(k, -1) for k in rows], np.int64)
            held.append(row[_places(r["local"], len(row))] << 32 | np.frombuffer(r["first"], "<u4"))
        h, t, first, last, _ = minimizers(texts)
        at = np.flatnonzero(np.isin(t << 32 | first, np.concatenate(held))) if held and len(h) else np.zeros(0, np.int64)
        cut = (np.diff(at) != 1) | (t[at[1:]] != t[at[:-1]]) | (h[at[:-1]] % np.uint64(CUT) == 0)
        opens = at[np.concatenate([[True], cut])[: len(at)]]
        closes = at[np.concatenate([cut, [True]])[: len(at)]]
        begin, end, owner = first[opens].tolist(), (last[closes] + WINDOW).tolist(), t[opens]
        pieces = [texts[i][s:e] for i, s, e in zip(owner.tolist(), begin, end)]
        s1, s2 = ([f(p) - (1 << 63) for p in pieces] for f in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest))
        often = np.concatenate([[0], np.cumsum(np.isin(h[at] >> np.uint64(16), frequent.value))])
        some = np.diff(often[np.searchsorted(at, np.append(opens, len(h)))]) > 0
        released()
        return pa.Table.from_batches([_batch(STRETCH, (s1, s2, docs[owner], tids[owner], begin, pieces, some))])

    return run


PIECE = "hash long, s1 long, s2 long, least long, off int, middle int, piece binary"


def _pieces(frequent):
    """The windows of each minimizer of different stretches that is not frequent, with the stretch's smallest document."""

    def run(batches):
        for b in slices(batches, "stretch", PART_CHARS // 4):
            s1, s2, least = (b[c].to_numpy() for c in ("s1", "s2", "least"))
            raws = b["stretch"].to_pylist()
            h, row, first, last, place = minimizers(raws)
            k = np.flatnonzero(~np.isin(h >> np.uint64(16), frequent.value))
            h, row, first, last, place = (c[k] for c in (h, row, first, last, place))
            pieces = [raws[i][s : e + WINDOW] for i, s, e in zip(row.tolist(), first.tolist(), last.tolist())]
            yield _batch(PIECE, (h.view(np.int64), s1[row], s2[row], least[row], first, place - first, pieces))

    return run


HOT_PIECE = "d1 long, d2 long, s1 long, s2 long, least long, off int, size int, piece binary"


def _digests(pieces: list[bytes]):
    return ([f(p) - (1 << 63) for p in pieces] for f in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest))


def _hot_pieces(frequent):
    """The windows of each frequent minimizer of different stretches."""

    def run(batches):
        for b in slices(batches, "stretch", PART_CHARS // 4):
            s1, s2, least = (b[c].to_numpy() for c in ("s1", "s2", "least"))
            raws = b["stretch"].to_pylist()
            h, row, first, last, _ = minimizers(raws)
            k = np.flatnonzero(np.isin(h >> np.uint64(16), frequent.value))
            row, first, last = row[k], first[k], last[k]
            pieces = [raws[i][s : e + WINDOW] for i, s, e in zip(row.tolist(), first.tolist(), last.tolist())]
            yield _batch(HOT_PIECE, (*_digests(pieces), s1[row], s2[row], least[row], first, last - first + WINDOW, pieces))

    return run


def _one_by_one(batches):
    """The windows of pieces, each as a piece without its bytes."""
    for b in slices(batches, "piece", PART_CHARS // 16):
        raws = b["piece"].to_pylist()
        n = np.array([len(r) - WINDOW + 1 for r in raws], np.int64)
        row, place = np.repeat(np.arange(len(raws)), n), gather(np.zeros(len(n), np.int64), n)
        pieces = [raws[i][s : s + WINDOW] for i, s in zip(row.tolist(), place.tolist())]
        s1, s2, least, off = (b[c].to_numpy()[row] for c in ("s1", "s2", "least", "off"))
        yield _batch(HOT_PIECE, (*_digests(pieces), s1, s2, least, off + place, np.full(len(row), WINDOW), [None] * len(row)))


def _by_digest(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of pieces that a smaller document than their own holds, and the pieces that none does: an aggregation that
    Spark combines in every task, and a join that may be skewed."""
    lows = pieces.groupBy("d1", "d2").agg(F.min("least").alias("low"))
    both = pieces.join(lows.hint("merge"), ["d1", "d2"])
    end = F.col("off") + F.col("size")
    return both.filter("least > low").select("s1", "s2", F.col("off").alias("start"), end.alias("end")), both.filter("least = low").drop("low")


OWNED = "s1 long, s2 long, start int, end int"


def _owned(batches):
    """Pieces sorted by minimizer -> windows of a stretch that a smaller document than the stretch's own holds."""

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        h, s1, s2, owner, off, middle = (b[c].to_numpy() for c in ("hash", "s1", "s2", "least", "off", "middle"))
        coded = b["piece"].dictionary_encode()
        piece, texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(cut, len(h)))
        group = np.repeat(np.arange(len(cut)), size)
        one = np.minimum.reduceat(piece, cut) == np.maximum.reduceat(piece, cut)
        least = np.minimum.reduceat(owner, cut)
        # groups of one text: it belongs to its smallest document
        length = pc.binary_length(b["piece"]).to_numpy()
        alike = np.flatnonzero(one[group] & (owner > least[group]))
        out = [[s1[alike]], [s2[alike]], [off[alike]], [(off + length)[alike]]]
        # the others, once for each text of a group
        mixed = np.flatnonzero(~one[group] & (least < np.maximum.reduceat(owner, cut))[group])
        if len(mixed):
            order = mixed[np.lexsort((owner[mixed], piece[mixed], group[mixed]))]
            g, p = group[order], piece[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
            text_of = np.cumsum(new) - 1
            tops = order[new]
            raws = texts.take(pa.array(piece[tops])).to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], g[new][1:] != g[new][:-1]])).tolist()
            owners, middles = owner[tops].tolist(), middle[tops].tolist()
            found: list[np.ndarray] = []
            for s, e in zip(starts, [*starts[1:], len(tops)]):
                found += piece_owners(raws[s:e], middles[s:e], owners[s:e])
            width = np.array([len(f) for f in found], np.int64)
            n = width[text_of]
            row = np.repeat(order, n)
            flat = np.concatenate(found)[gather((np.cumsum(width) - width)[text_of], n)]
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            under = np.flatnonzero(flat < owner[row])
            row, place = row[under], place[under]
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(place) != 1)])[: len(row)]
            final = np.concatenate([first[1:], [True]])[: len(row)]
            for column, value in zip(out, (s1[row[first]], s2[row[first]], off[row[first]] + place[first], off[row[first]] + place[final] + WINDOW)):
                column.append(value)
        return _batch(OWNED, [np.concatenate(c) for c in out])

    # A batch's last group goes on in the next one.
    held: list[pa.RecordBatch] = []
    for b in batches:
        h = b["hash"].to_numpy()
        if not len(h):
            continue
        change = np.flatnonzero(h[1:] != h[:-1])
        if held and h[0] != held[-1]["hash"][-1].as_py():
            yield judge(pa.concat_batches(held))
            held = []
        if not len(change):
            held.append(b)
            continue
        at = int(change[-1]) + 1
        yield judge(pa.concat_batches([*held, b.slice(0, at)]))
        held = [b.slice(at)]
    if held:
        yield judge(pa.concat_batches(held))
    released()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")


def covered_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, tid, ranges): byte ranges that smaller documents cover; tid tells rows of one doc_id apart by text."""
    src = _keyed(docs).filter(f"doc_id is not null and octet_length(text) >= {WINDOW}")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(int(size // RANGE_BYTES), 8)
    src = src.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, tid), {n_ranges}) as int)"))
    sent = src.mapInArrow(_anchors_sent(n_ranges), SENT)
    shared = stored(_dealt(sent, n_ranges).mapInArrow(_shared_anchors(hot), SHARED))
    frequent = docs.sparkSession.sparkContext.broadcast(_hot_list(shared))
    texts = src.dropDuplicates(["doc_id", "tid"]) if _repeats(src) else src
    held = shared.filter("bucket is not null").drop("hot", "times")
    stretches = stored(texts.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_stretches(frequent), STRETCH))
    dropped(shared)
    different = stretches.groupBy("s1", "s2", "stretch").agg(F.min("doc_id").alias("least"))
    pieces = different.mapInArrow(_pieces(frequent), PIECE).repartition(n_ranges, "hash").sortWithinPartitions("hash")
    owned = stored(pieces.mapInArrow(_owned, OWNED))
    # Frequent minimizers: equal pieces first, then the windows of one of each, one by one.
    some = stretches.filter("hot").groupBy("s1", "s2", "stretch").agg(F.min("doc_id").alias("least"))
    pieces = stored(some.mapInArrow(_hot_pieces(frequent), HOT_PIECE))
    under, left = _by_digest(pieces)
    windows = stored(left.mapInArrow(_one_by_one, HOT_PIECE))
    under = under.unionByName(_by_digest(windows)[0])
    parts = owned.unionByName(under).groupBy("s1", "s2").agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    held = stretches.select("s1", "s2", "doc_id", "tid", "start", F.octet_length("stretch").alias("size"))
    least = held.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
    whole = held.join(least, ["s1", "s2"])
    covered = whole.filter("doc_id > least").select("doc_id", "tid", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("z"))
    # windows that the smallest document of a stretch shares with still smaller ones
    first = whole.filter("doc_id = least").join(parts, ["s1", "s2"]).select("doc_id", "tid", "start", F.explode("parts").alias("p"))
    first = first.select("doc_id", "tid", (F.col("start") + F.col("p.start")).alias("a"), (F.col("start") + F.col("p.end")).alias("z"))
    ranges = F.collect_list(F.struct(F.col("a").cast("int").alias("start"), F.col("z").cast("int").alias("end")))
    found = stored(covered.unionByName(first).groupBy("doc_id", "tid").agg(ranges.alias("ranges")))
    dropped(stretches, owned, pieces, windows)
    return found


def _repeats(src: DataFrame) -> bool:
    """Whether a doc_id with its text stands in several rows."""
    return bool(src.groupBy("doc_id", "tid").count().filter("count > 1").limit(1).count())


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["start"], r["end"]) for r in (() if ranges is None else ranges)):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([r[0], r[1]])
    return [(s, e) for s, e in out]


def _cut(raw: bytes, runs) -> bytes:
    at, out = 0, []
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    return b"".join(out + [raw[at:]])


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    joined = _keyed(docs).join(covered_ranges(docs), ["doc_id", "tid"], "left")

    def run(batches):
        for b in slices(batches, limit=PART_CHARS // 3):
            out = [[] for _ in range(4)]
            for text, ranges in zip(texts_of(b["text"]), b["ranges"].to_pylist()):
                raw, runs = text.encode(), _merged(ranges)
                kept = _cut(raw, runs)
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            yield _batch(REPORT, [b["doc_id"], *out])

    return joined.select("doc_id", "text", "ranges").mapInArrow(run, REPORT)


def cut_docs(docs: DataFrame) -> DataFrame:
    """``docs`` without the covered bytes; texts of which nothing but white space is left go. ``n_chars`` follows.

    Characters cut in two lose their other half too. Null and empty texts, rows without a doc_id, and columns of any
    name come back as they are; of rows that repeat a doc_id each is cut by its own text."""

    @F.pandas_udf("string")
    def kept(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, ranges in parts:
            cut = [t if r is None else _cut(t.encode(), _merged(r)).decode("utf-8", "ignore") for t, r in zip(text, ranges)]
            yield pd.Series(cut, dtype=object)
        released()

    named = ["doc_id", "text", *({"n_chars"} & set(docs.columns))]
    df = aside(docs, *named).withColumn("key", F.xxhash64("text"))
    found = covered_ranges(docs).withColumnsRenamed({"doc_id": "doc", "tid": "key_of"})
    joined = df.join(found, (F.col("doc_id") == F.col("doc")) & (F.col("key") == F.col("key_of")), "left")
    out = joined.withColumn("text", F.when(F.col("ranges").isNull(), F.col("text")).otherwise(kept("text", "ranges")))
    out = out.filter(F.col("ranges").isNull() | (F.btrim("text") != ""))
    if "n_chars" in named:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restored(out, docs.columns, *named)
