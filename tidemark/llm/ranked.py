"""Ranked lexical search by hybrid evaluation: accumulators from short lists, then documents at a time over long ones.

Items are a stated query set, read in blocks whose vocabulary is bounded (``BLOCK_TERMS``). For each block every document
is read once: its length and the occurrences of the block's terms become a row of postings, written to the shared folder.
Counts of documents, terms and documents per term come from these rows. A task then takes a batch of documents as a shard
with one list per term, sorted by document. For an item it adds up the short lists first (term at a time); their sums are
one more iterator, bounded by its largest sum per window of documents. Windows are then visited in the order of documents:

- a window whose bound (sums and long lists) can't reach the kth score is skipped, no list of it is read;
- where the long lists alone can't reach it, only documents that hold a sum are scored, by lookups in the long lists;
- elsewhere the whole window is scored.

The best sums are scored first, and the kth score is carried from shard to shard of a task, so that it is high early. Only
k rows per item leave a task.

Scores are those of the contract: w * ((1000000000 * tf) div (1000 * tf + 8 * m)) per occurrence of a term in the item,
m = 25 + (75 * n * N) div L, w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Null and empty texts hold no term; such documents count nowhere and such items have no rows. Rows that repeat a doc_id are
documents of their own, and so are items; a null doc_id ranks before others of its score. Ties go to the smaller doc_id.
Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import slices, stored

#: Items and distinct terms of items in a block.
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 18
#: Documents of a window; a list is short if it holds at most one in ``SHORT`` documents of its shard.
WINDOW, SHORT = 256, 32
#: Bytes of a text that are split into terms at once.
PIECE = 4_000_000

# Everything between terms becomes a space, A-Z lower case; bytes from 0x80 on belong to letters beyond ASCII.
_TABLE = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)).lower()


def pieces(text: str):
    """Lists of the text's terms, as UTF-8 bytes; no list is much longer than ``PIECE`` bytes, no term is cut."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    start = 0
    while start < len(raw):
        end = start + PIECE
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def postings(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; ``terms`` are numbers of the vocabulary, ascending."""

    def run(batches):
        for b in slices(batches):
            ids, sizes, ends, terms, tfs = [], [], [0], [], []
            for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                n, counts = 0, Counter()
                for words in pieces(text or ""):
                    n += len(words)
                    counts.update(words)
                if n:
                    found = sorted((vocabulary[t], counts[t]) for t in counts.keys() & vocabulary.keys())
                    terms += [t for t, _ in found]
                    tfs += [f for _, f in found]
                    ids.append(i)
                    sizes.append(n)
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """The k best (score, doc_id) so far; a null doc_id comes first among equal scores."""

    def __init__(self, k: int):
        self.k, self.score, self.known, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document has to reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least
        if good.any():
            score, known, ids = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.known, known), (self.ids, ids)))
            order = np.lexsort((ids, known, -score))[: self.k]
            self.score, self.known, self.ids = score[order], known[order], ids[order]


class Shard:
    """A batch of documents with one list per term, cut into windows of documents.

    ``ids`` and ``known``: doc_ids and whether they aren't null; ``m``: the documents' length part of the score; ``at``,
    ``terms``, ``tfs``: document number, term and occurrences of each posting."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        order = np.lexsort((at, terms))
        self.ids, self.known, self.n = ids, known, len(ids)
        self.at, tf = at[order].astype(np.int64), tfs[order].astype(np.int64)
        self.value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.at])
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.edges = np.arange(0, self.n + WINDOW, WINDOW)
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.scored = 0  # documents whose whole score was asked for

    def windows(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        """(first posting of each window, largest value of each window) of a long list; made once."""
        if s not in self.long:
            first = s + np.searchsorted(self.at[s:e], self.edges)
            most = np.zeros(len(self.edges) - 1, np.int64)
            full = np.flatnonzero(np.diff(first))
            most[full] = np.maximum.reduceat(self.value[:e], first[full])
            self.long[s] = first, most
        return self.long[s]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds the shard's best documents for an item to ``best``."""
        i = np.searchsorted(self.terms, terms)
        held = i < len(self.terms)
        held[held] = self.terms[i[held]] == terms[held]
        lists = [(self.starts[j], self.ends[j], int(w)) for j, w in zip(i[held], weights[held]) if w > 0]
        short = [x for x in lists if x[1] - x[0] <= max(self.n // SHORT, 1)]
        rest = [x for x in lists if x[1] - x[0] > max(self.n // SHORT, 1)]
        sums = np.zeros(self.n, np.int64)
        for s, e, w in short:
            sums[self.at[s:e]] += w * self.value[s:e]
        summed = np.flatnonzero(sums)
        tables = [(s, e, w, *self.windows(s, e)) for s, e, w in rest]
        most = np.maximum.reduceat(sums, self.edges[:-1]) if self.n else sums
        reach = sum((w * peak for _, _, w, _, peak in tables), np.zeros(len(self.edges) - 1, np.int64))
        if len(summed):
            first = np.sort(summed[np.argsort(-sums[summed], kind="stable")[: best.k]])
            trial = Best(best.k)  # scored here for their kth score only: their windows are visited as well
            trial.add(self.whole(first, sums, tables), self.known[first], self.ids[first])
            floor = max(best.least, trial.least)
        else:
            floor = best.least
        for x in np.flatnonzero(most + reach >= floor):
            floor = max(floor, best.least)
            if most[x] + reach[x] < floor:
                continue
            a, b = int(self.edges[x]), min(int(self.edges[x + 1]), self.n)
            if reach[x] < floor:
                lo, hi = np.searchsorted(summed, (a, b))
                at = summed[lo:hi]
                at = at[sums[at] + reach[x] >= floor]
                score = self.whole(at, sums, tables)
            else:
                at, score = np.arange(a, b), sums[a:b].copy()
                for _, _, w, start, _ in tables:
                    s, e = start[x], start[x + 1]
                    score[self.at[s:e] - a] += w * self.value[s:e]
                self.scored += b - a
            best.add(score, self.known[at], self.ids[at])

    def whole(self, at: np.ndarray, sums: np.ndarray, tables) -> np.ndarray:
        """Scores of documents ``at`` (ascending): their sums and what the long lists hold for them."""
        score = sums[at].copy()
        self.scored += len(at)
        for s, e, w, _, _ in tables:
            p = s + np.searchsorted(self.at[s:e], at)
            ok = p < e
            ok[ok] = self.at[p[ok]] == at[ok]
            score[ok] += w * self.value[p[ok]]
        return score


def shard_of(batch, n_docs: int, n_terms: int) -> Shard:
    """The shard of a batch of postings; ``n_docs`` and ``n_terms`` are the corpus's N and L."""
    n = batch["n"].to_numpy()
    if 75 * int(n.max(initial=0)) * n_docs < 1 << 63:
        m = 25 + (75 * n * n_docs) // n_terms
    else:
        m = np.array([25 + (75 * x * n_docs) // n_terms for x in n.tolist()], np.int64)
    lists = batch["terms"]
    at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    ids = batch["doc_id"]
    return Shard(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), m, at, lists.flatten().to_numpy(), batch["tfs"].flatten().to_numpy())


def _blocks(items: DataFrame):
    """Blocks of items, each a list of (item_id, {term: occurrences}), whose vocabulary is bounded."""
    block, words = [], set()
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        counts = Counter()
        for piece in pieces(r["text"] or ""):
            counts.update(piece)
        if block and (len(block) == BLOCK_ITEMS or len(words | counts.keys()) > BLOCK_TERMS):
            yield block
            block, words = [], set()
        if counts:
            block.append((r["item_id"], counts))
            words |= counts.keys()
    if block:
        yield block


def _search(documents: DataFrame, block: list, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in block for t in c}))}
    rows = stored(postings(documents, vocabulary))
    total = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], max(total["terms"], 1)
    df = np.zeros(len(vocabulary), np.int64)
    for t, c in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most BLOCK_TERMS or one item's
        df[t] = c
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    asked = []
    for item, counts in block:
        terms = np.array(sorted(vocabulary[t] for t in counts), np.int64)
        often = {vocabulary[t]: c for t, c in counts.items()}
        asked.append((item, terms, np.array([often[t] for t in terms.tolist()], np.int64) * weight[terms]))

    def run(batches):
        best = [Best(k) for _ in asked]
        for b in batches:
            if b.num_rows:
                shard = shard_of(b, n_docs, n_terms)
                for (_, terms, weights), found in zip(asked, best):
                    shard.search(terms, weights, found)
        number = np.repeat(np.arange(len(asked)), [len(x.ids) for x in best])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        ids = pa.array(join([x.ids for x in best], np.int64), pa.int64(), mask=~join([x.known for x in best], bool).astype(bool))
        items = pa.array([asked[i][0] for i in number.tolist()], pa.int64())
        scores = pa.array(join([x.score for x in best], np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), items, ids, scores], ["number", "item_id", "doc_id", "score"])

    found = rows.mapInArrow(run, "number long, item_id long, doc_id long, score long")
    first = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item, best first."""
    spark = documents.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items):
        out = out.unionByName(_search(documents, block, k))
    return out
