"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt to blocks. A first pass sends each query to one block: the kth score found there is a floor that no
result can lie below. In the second pass queries, in blocks of their own, meet all candidate blocks with their floors; a
pair of blocks is one task's work. A task sorts its candidates once per dimension and, for each query, walks all lists
at once from their best ends, a row of each list at first, then more; it scores what it meets for the first time, until no
unseen candidate can reach the floor or the kth score. Only k rows per query and block leave a task.

The bound is the inner product of the query with the lists' last values. It is tight where few dimensions carry the
scores; in many dimensions of equal weight it lies above all scores until most rows have been met.

Components become floor(1024 * x) as integers. Vectors that are null, empty, or hold a null or non-finite component take
no part; neither do candidates of another dimension than the query's. Ties go to the smaller vec_id, so a list is walked
until its bound is strictly below the kth score. Rows with a null vec_id take no part. Rows that repeat a vec_id are
vectors of their own: each is a candidate of the others, and each makes a query (with the same query_id and ranks of its
own) where the vec_id is a query's. Products that could leave 64 bits are summed as Python integers; a result that no 64-bit
score can show, or a component that no 64-bit integer can, is an error. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored

CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and its components as integers, valid rows only."""
    sound = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return (
        vectors.selectExpr("cast(vec_id as bigint) as vec_id", "cast(embedding as array<double>) as v")
        .filter(f"vec_id is not null and v is not null and {sound}")
        .selectExpr("vec_id", "transform(v, x -> if(abs(1024 * x) < 9.2e18, cast(floor(1024 * x) as bigint), raise_error('component beyond 64 bits'))) as v")
    )


class SortedLists:
    """A block of candidates with one list per dimension, ascending by component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, rids: np.ndarray | None = None):
        """``rids``: numbers of the rows, by which a query knows its own; the ids where they are not given."""
        order = np.lexsort((ids if rids is None else rids, ids))
        self.ids, self.rows, self.rids = ids[order], rows[order], (ids if rids is None else rids)[order]
        self.up = np.argsort(self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, self.up, axis=0)

    def top(self, own: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best candidates but the row ``own``, best first, ties by vec_id. Candidates that score
        less than ``floor`` may be missing. ``scored`` then holds how many were scored."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        down = q[used] > 0  # large components first where the query's is positive
        weight = q[used]
        seen = np.zeros(n, bool)
        best_at, best = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        depth = step = scored = 0
        while depth < n:
            # the best that a candidate can reach that no list has shown yet
            bound = int(np.where(down, self.values[n - 1 - depth, used], self.values[depth, used]) @ weight)
            least = max((x for x in (floor, best[-1] if len(best) == k else None) if x is not None), default=None)
            if least is not None and bound < least:
                break
            step = max(1, step * 2)
            end = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.up[n - end : n - depth, used[down]].ravel()] = True
            fresh[self.up[depth:end, used[~down]].ravel()] = True
            if not len(used):
                fresh[:], end = True, n  # a zero query: every score is 0
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            new = new[self.rids[new] != own]
            scored += len(new)
            at, score = np.concatenate([best_at, new]), np.concatenate([best, self.rows[new] @ q])
            order = np.lexsort((at, -score))[:k]
            best_at, best = at[order], score[order]
            depth = n if seen.all() else end
        self.scored = scored
        return self.ids[best_at], best


def _matrix(ids: pa.Array, rids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, rids, rows) by dimension."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, at = vectors.flatten().to_numpy(), np.cumsum(lengths) - lengths
    ids, rids = ids.to_numpy(), rids.to_numpy()
    return {
        int(d): (ids[m], rids[m], flat[at[m][:, None] + np.arange(d)]) for d in np.unique(lengths) for m in [np.flatnonzero(lengths == d)]
    }


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products of rows of ``a`` and ``b`` and all bounds on them stay within 64 bits."""
    most = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    return most[0] * most[1] * max(a.shape[1], 1) < 1 << 62


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose vec_id is divisible by ``every``."""
    rows = stored(integer_vectors(vectors).withColumn("rid", F.monotonically_increasing_id()))
    is_query = f"vec_id % {every} = 0"
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.expr(is_query)).alias("q")).first()
    n_c, n_q = -(-max(sizes["n"], 1) // CANDIDATE_BLOCK), -(-max(sizes["q"], 1) // QUERY_BLOCK)
    blocks = lambda n: f"explode(sequence(0, {n - 1}))"
    queries = rows.filter(is_query)
    candidates = rows.selectExpr("vec_id as held_id", "rid as held_rid", "v as held_v", f"cast(pmod(xxhash64(rid, 2), {n_c}) as int) as held_cb")

    def search(with_floor: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [[], [], [], []]
            if left.num_rows and right.num_rows:
                floors = dict(zip(left["rid"].to_pylist(), left["floor"].to_pylist())) if with_floor else {}
                asked = _matrix(*(left[c].combine_chunks() for c in ("vec_id", "rid", "v")))
                held = _matrix(*(right[c].combine_chunks() for c in ("held_id", "held_rid", "held_v")))
                for d, (ids, rids, qs) in asked.items():
                    if d in held:
                        theirs, their_rids, vs = held[d]
                        if not _fits(qs, vs):
                            qs, vs = qs.astype(object), vs.astype(object)
                        lists = SortedLists(theirs, vs, their_rids)
                        for i, r, q in zip(ids.tolist(), rids.tolist(), qs):
                            found, scores = lists.top(r, q, k, floors.get(r))
                            for column, value in zip(out, ([r] * len(found), [i] * len(found), found.tolist(), scores.tolist())):
                                column += value
            return pa.table([pa.array(c, pa.int64()) for c in out], ["row", "query_id", "vec_id", "score"])

        return run

    found = "row long, query_id long, vec_id long, score long"
    home = queries.selectExpr("vec_id", "rid", "v", f"cast(pmod(xxhash64(rid, 3), {n_c}) as int) as cb")
    first = home.groupBy("cb").cogroup(candidates.groupBy("held_cb")).applyInArrow(search(False), found)
    floors = first.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(f"n = {k}")
    floors = stored(floors.select("row", "floor")).hint("merge")
    asked = queries.join(floors, F.col("rid") == F.col("row"), "left").drop("row")
    asked = asked.selectExpr("vec_id", "rid", "v", "floor", f"cast(pmod(xxhash64(rid, 1), {n_q}) as int) as qb", f"{blocks(n_c)} as cb")
    pairs = candidates.select("*", F.expr(f"{blocks(n_q)} as held_qb"))
    met = asked.groupBy("cb", "qb").cogroup(pairs.groupBy("held_cb", "held_qb")).applyInArrow(search(True), found)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
