"""Boosted regression trees over one binned copy of the rows, any number of models at once.

A model is a train window (the rows before a position of every asset) with its parameters; the last rows of the window
validate. Windows of up to ``GROUP_ROWS`` rows are dealt out by model, and a task grows a model from its rows. Beyond that all
models grow in step: a pass over the rows adds up, per model and open tree node, the residuals and rows of every feature's
bins; the sums meet per model, which is where the splits are chosen. Only splits come to the driver, and only trees go back,
so what the driver holds grows with models and trees, not with rows; ``MODELS`` bounds the models of a pass. A task evaluates
the trees so far on its own rows, so nothing but the binned copy is ever stored or shuffled whole. Both ways take the same
steps, and so give the same trees.

Missing values have a bin of their own and go to the side that fits better. The asset is a category: its values are ordered
by mean residual and cut like numbers. Trees grow level by level, best splits first while leaves are left.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import HORIZON

#: Bins of a number besides the missing one, values of the category, models grown in one pass.
BINS, CATEGORIES, MODELS = 48, 254, 128
VALIDATION = 63
#: Rows of a train window that are one task's at most: some 1 KB each while it works.
GROUP_ROWS = 200_000
#: Share of features and rows that a tree sees; rows are drawn anew every ``REDRAW`` trees.
SHARE, REDRAW = 0.8, 5
#: Prior rows in the mean residual that orders categories.
SMOOTH = 10.0


@dataclass(frozen=True)
class Spec:
    """One model: rows with pos < ``train_end`` are its train window."""

    model: int
    train_end: int
    leaves: int = 15
    min_rows: int = 50
    rate: float = 0.1
    l2: float = 1.0
    rounds: int = 1000
    patience: int = 50


@dataclass
class Tree:
    """Parallel lists; a node with feature -1 is a leaf. ``left_bins`` of a node tell which bins go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left_bins: list[np.ndarray | None] = field(default_factory=lambda: [None])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, left_bins: np.ndarray, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.left_bins[node], self.left[node] = feature, left_bins, len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.left_bins.append(None)
            self.left.append(0)
            self.value.append(v)
        return self.left[node], self.left[node] + 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at, open_rows = np.zeros(len(x), np.int32), {0: np.arange(len(x))}
        for node, f in enumerate(self.feature):  # children come after their parents
            if f >= 0:
                rows = open_rows.pop(node)
                goes = self.left_bins[node][x[rows, f]]
                for child, mine in ((self.left[node], rows[goes]), (self.left[node] + 1, rows[~goes])):
                    open_rows[child] = mine
                    at[mine] = child
        return at


class Forest:
    """Trees as a few arrays, which is what goes to the tasks: node k of all trees splits on ``feature[k]``, its children are
    ``left[k]`` and the node after it."""

    def __init__(self, base: float, trees: list[Tree]):
        sizes = [len(t.feature) for t in trees]
        self.base, self.roots = base, np.cumsum([0, *sizes])[:-1].astype(np.int32)
        join = lambda parts, kind: np.concatenate([np.array(x, kind) for x in parts]) if parts else np.zeros(0, kind)
        self.feature, self.value = join([t.feature for t in trees], np.int16), join([t.value for t in trees], np.float64)
        self.left = join([np.array(t.left) + r for t, r in zip(trees, self.roots)], np.int32)
        masks = [m for t in trees for m in t.left_bins]
        self.goes = np.zeros((len(masks), max((len(m) for m in masks if m is not None), default=0)), bool)
        for k, m in enumerate(masks):
            if m is not None:
                self.goes[k, : len(m)] = m

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for root in self.roots:
            at, live = np.full(len(x), root, np.int32), np.arange(len(x))
            while len(live := live[self.feature[at[live]] >= 0]):
                node = at[live]
                at[live] = self.left[node] + ~self.goes[node, x[live, self.feature[node]]]
            out += self.value[at]
        return out


@dataclass
class Model:
    spec: Spec
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    loss: float = float("inf")  # on the validation rows, after the last tree
    best: int = 0
    n_train: int = 0
    n_val: int = 0

    def forest(self) -> Forest:
        return Forest(self.base, self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forest().predict(x)


# ---- binning -----------------------------------------------------------------------------------------------------------


def bins_of(df: DataFrame, names: list[str], before: int) -> dict:
    """Bin edges from the rows with pos < ``before``, which every model may know, and the categories."""
    q = [i / BINS for i in range(1, BINS)]
    early = df.filter(F.col("pos") < before)
    row = early.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")), q, 5000).alias(n) for n in names)).first()
    assets = sorted(r[0] for r in df.select("asset").distinct().limit(CATEGORIES + 1).collect())
    return {"names": names, "edges": [np.unique(row[n] or []) for n in names], "assets": assets if len(assets) <= CATEGORIES else None}


def binned(df: DataFrame, bins: dict, keep: list[str]) -> DataFrame:
    """``keep`` and ``x``: a byte per feature, the asset last; 0 is missing. Beyond ``CATEGORIES`` assets share values by hash."""
    names, edges, known = bins["names"], bins["edges"], bins["assets"]
    number = {a: i + 1 for i, a in enumerate(known)} if known is not None else None

    def run(batches):
        for b in batches:
            x = np.zeros((b.num_rows, len(names) + 1), np.uint8)
            for j, (n, e) in enumerate(zip(names, edges)):
                v = b[f"_f_{n}"].to_numpy(zero_copy_only=False)
                x[:, j] = np.where(np.isnan(v), 0, np.searchsorted(e, v) + 1)
            assets = b["asset"].to_pylist()
            x[:, -1] = [number.get(a, 0) if number is not None else zlib.crc32(a.encode()) % CATEGORIES + 1 for a in assets]
            column = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), column], [*keep, "x"])

    rows = df.select(*keep, *(F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))).alias(f"_f_{n}") for n in names))
    return rows.mapInArrow(run, f"{', '.join(f'{k} {dict(df.dtypes)[k]}' for k in keep)}, x binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def roles(pos: np.ndarray, spec: Spec, validation: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(train, validate) of rows; ``horizon`` rows between them are purged. Short windows validate nothing."""
    if spec.train_end <= validation + horizon:
        return pos < spec.train_end, np.zeros(len(pos), bool)
    start = spec.train_end - validation
    return pos < start - horizon, (pos >= start) & (pos < spec.train_end)


def _drawn(pos: np.ndarray, asset: np.ndarray, draw: int) -> np.ndarray:
    """The rows that a draw takes, by a hash of their place."""
    h = (pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (asset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64((draw + 1) * 0x165667B19E3779F9 % (1 << 64))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)) % np.uint64(1000) < np.uint64(int(SHARE * 1000))


# ---- a pass ------------------------------------------------------------------------------------------------------------


def _part(x, y, pos, starts: np.ndarray) -> tuple:
    """Rows as (bins, cells of the bins, y, pos)."""
    bins = _matrix(x, len(starts) - 1)
    return bins, bins.astype(np.int64) + starts[:-1], y.to_numpy(), pos.to_numpy()


def _add_up(part: tuple, spec: Spec, ahead, n_trees: int, tree: Tree, nodes: list[int], validation: int, horizon: int, held: np.ndarray, sums: np.ndarray) -> None:
    """Adds the rows of a part to a model's sums; ``ahead`` gives what its trees so far predict for rows."""
    x, flat, y, pos = part
    width, cells = x.shape[1], sums.shape[1]
    train, val = roles(pos, spec, validation, horizon)
    if val.any() and len(tree.feature) == 1:
        held[0] += float(((y[val] - ahead(np.flatnonzero(val))) ** 2).sum())
        held[1] += int(val.sum())
    rows = np.flatnonzero(train)
    held[2] += len(rows)
    rows = rows[_drawn(pos[rows], x[rows, -1], n_trees // REDRAW)]
    if len(nodes) > 1 or nodes[0]:
        at = tree.leaf_of(x[rows])
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        rows, at = rows[place[at] >= 0], place[at][place[at] >= 0]  # only rows in open nodes
    else:
        at = np.zeros(len(rows), np.int64)
    if len(rows):
        left = y[rows] - ahead(rows)
        where = (flat[rows] + at[:, None] * cells).ravel()
        sums[:, :, 0] += np.bincount(where, np.repeat(left, width), len(nodes) * cells).reshape(len(nodes), cells)
        sums[:, :, 1] += np.bincount(where, minlength=len(nodes) * cells).reshape(len(nodes), cells)


def _packed(held: dict, sums: dict) -> pa.RecordBatch:
    blobs = [held[k].tobytes() + sums[k].tobytes() for k in sums]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], ["model", "sums"])


def _histograms(growing: list, starts: np.ndarray, validation: int, horizon: int):
    """Adds up sums per (model, open node, feature, bin): (model, task's sums)."""
    cells = int(starts[-1])
    sent = [(m.spec, m.forest(), len(m.trees), tree, nodes) for m, tree, nodes in growing]

    def run(batches):
        sums = {spec.model: np.zeros((len(nodes), cells, 2)) for spec, *_, nodes in sent}
        held = {spec.model: np.zeros(4) for spec, *_ in sent}  # squared error and rows to validate, rows to train, sum of y
        for b in batches:
            if not b.num_rows:
                continue
            part = _part(b["x"], b["y"], b["pos"], starts)
            for spec, forest, n_trees, tree, nodes in sent:
                ahead = lambda rows, forest=forest: forest.predict(part[0][rows])
                _add_up(part, spec, ahead, n_trees, tree, nodes, validation, horizon, held[spec.model], sums[spec.model])
        yield _packed(held, sums)

    return run


@lru_cache(maxsize=8)
def _padded(starts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(cells of the numbers' bins, a row per feature, -1 behind its last; bins of each)."""
    size = np.diff(starts[:-1])
    k = np.arange(max(size, default=2))
    return np.where(k < size[:, None], np.array(starts[:-2], np.int64)[:, None] + k, -1), size


def best_split(g: np.ndarray, n: np.ndarray, starts: np.ndarray, allowed: np.ndarray, spec: Spec) -> tuple | None:
    """(gain, feature, bins that go left, left value, right value) of a node's sums; None where no split gains.

    Cuts of a number send its lower bins left, and the missing ones left or right; cuts of the category (the last feature)
    send the values of lower mean residual left."""
    a, b = starts[0], starts[1]
    total_g, total_n = g[a:b].sum(), n[a:b].sum()
    if total_n < 2 * spec.min_rows:
        return None
    score = lambda s, k: s * s / (k + spec.l2)
    gains = lambda ok, sg, sn: np.where(ok & (sn >= spec.min_rows) & (total_n - sn >= spec.min_rows), score(sg, sn) + score(total_g - sg, total_n - sn) - whole, -1.0)
    values = lambda sg, sn: tuple(float(spec.rate * s / (c + spec.l2)) for s, c in ((sg, sn), (total_g - sg, total_n - sn)))
    whole, last, best = score(total_g, total_n), len(starts) - 2, None
    at, size = _padded(tuple(starts.tolist()))
    numbers = np.flatnonzero(allowed[:last])
    if len(numbers):
        at, size = at[numbers], size[numbers, None]
        mine_g, mine_n = (np.where(at >= 0, v[at], 0.0) for v in (g, n))
        # lower bins left, the missing ones right, then the missing ones left too
        sg, sn = (np.zeros((len(numbers), 2, at.shape[1] - 1)) for _ in range(2))
        for out, mine in ((sg, mine_g), (sn, mine_n)):
            out[:, 0, :-1] = np.cumsum(mine[:, 1:], axis=1)[:, :-1]
            out[:, 1, 0] = mine[:, 0]
            out[:, 1, 1:] = out[:, 0, :-1] + mine[:, :1]
        k = np.arange(at.shape[1] - 1)
        gain = gains(np.stack([k < size - 2, (k < size - 1) & (mine_n[:, :1] > 0)], axis=1), sg, sn)
        top = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[top] > 1e-9:
            i, with_missing, k = map(int, top)
            mask = np.zeros(int(size[i, 0]), bool)
            mask[(0 if with_missing else 1) : (k + 1 if with_missing else k + 2)] = True
            best = (float(gain[top]), int(numbers[i]), mask, *values(sg[top], sn[top]))
    if allowed[last]:
        mine_g, mine_n = (v[starts[last] : starts[last + 1]] for v in (g, n))
        order = np.argsort(mine_g / (mine_n + SMOOTH), kind="stable")
        order = order[mine_n[order] > 0]
        sg, sn = np.cumsum(mine_g[order])[:-1], np.cumsum(mine_n[order])[:-1]
        gain = gains(True, sg, sn)
        if len(gain) and (top := int(np.argmax(gain))) >= 0 and gain[top] > max(1e-9, best[0] if best else 0):
            mask = np.zeros(len(mine_n), bool)
            mask[order[: top + 1]] = True
            best = (float(gain[top]), last, mask, *values(sg[top], sn[top]))
    return best


_FOUND = "model int, n_val double, sse double, n_train double, base double, node int, gain double, feature int, mask binary, low double, high double"


def _splits(growing: list, starts: np.ndarray):
    """Sums meet per model; the splits of its open nodes come out. At the first tree the mean of y is taken off."""
    known = {m.spec.model: (m.spec, m.base, len(m.trees), nodes) for m, _, nodes in growing}
    cells, width = int(starts[-1]), len(starts) - 1
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _FOUND.split(", ")])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b["model"].to_pylist(), b["sums"].to_pylist()):
                v = np.frombuffer(blob)
                total[k] = total[k] + v if k in total else v
        out = []
        for k, v in total.items():
            spec, base, n_trees, nodes = known[k]
            (sse, n_val, n_train, _), sums = v[:4], v[4:].reshape(len(nodes), cells, 2)
            first = not n_trees and base == 0.0
            allowed = np.ones(width, bool)
            if width > 2:
                allowed[np.random.default_rng((k, n_trees)).permutation(width)[: int(width * (1 - SHARE))]] = False
            for node, (g, n) in zip(nodes, (s.T for s in sums)):
                if first:
                    seen = n[: starts[1]].sum()
                    base = float(g[: starts[1]].sum() / seen) if seen else 0.0
                    g = g - base * n
                s = best_split(g, n, starts, allowed, spec)
                row = (k, n_val, sse, n_train, base, node)
                out.append((*row, s[0], s[1], s[2].tobytes(), s[3], s[4]) if s else (*row, -1.0, -1, b"", 0.0, 0.0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * len(schema), schema.types)], schema=schema)

    return run


def _grow(one_pass, specs: list[Spec]) -> list[Model]:
    """Models of ``specs``: passes until every one has stopped. A pass takes (model, tree, open nodes) and gives ``_FOUND``."""
    models = {s.model: Model(s) for s in specs}
    state = {k: (Tree(), [0]) for k in models}  # the tree that grows and its open nodes
    while state:
        growing = [(models[k], tree, nodes) for k, (tree, nodes) in state.items()]
        found: dict[int, list] = {}
        for r in one_pass(growing):  # a row per open node
            found.setdefault(r["model"], []).append(r)
        for k in list(state):
            m, (tree, nodes), rs = models[k], state[k], found.get(k, [])
            whole = len(tree.feature) == 1
            if rs and whole:
                m.n_train, m.n_val = int(rs[0]["n_train"]), int(rs[0]["n_val"])
                if m.trees or m.base:
                    loss = rs[0]["sse"] / m.n_val if m.n_val else -float(len(m.trees))
                    if loss < m.loss - 1e-12:
                        m.loss, m.best = loss, len(m.trees)
                    if len(m.trees) >= m.spec.rounds or len(m.trees) - m.best >= m.spec.patience:
                        rs = []
                else:
                    m.base = rs[0]["base"]
            full = sum(f < 0 for f in tree.feature)
            opened = []
            for r in sorted((r for r in rs if r["feature"] >= 0), key=lambda r: (-r["gain"], r["node"])):
                if full < m.spec.leaves:
                    opened += tree.split(r["node"], r["feature"], np.frombuffer(r["mask"], bool), (r["low"], r["high"]))
                    full += 1
            if opened and full < m.spec.leaves:
                state[k] = (tree, sorted(opened))
            elif len(tree.feature) > 1:
                m.trees.append(tree)
                state[k] = (Tree(), [0])
            else:
                del m.trees[m.best if m.loss < float("inf") else len(m.trees) :]
                del state[k]
    return [models[s.model] for s in specs]


def _in_a_task(specs: list[Spec], starts: np.ndarray, validation: int, horizon: int):
    """Grows the model of a group from the rows of its window."""
    known = {s.model: s for s in specs}

    def run(group: pa.Table) -> pa.Table:
        spec = known[group["model"][0].as_py()]
        group = group.sort_by([("pos", "ascending"), ("x", "ascending"), ("y", "ascending")])  # sums don't depend on the rows' order
        part = _part(*(group[c].combine_chunks() for c in ("x", "y", "pos")), starts)
        ahead, seen = np.zeros(group.num_rows), 0

        def one_pass(growing):
            nonlocal ahead, seen
            (m, tree, nodes), = growing
            if not m.trees:
                ahead = np.full(group.num_rows, m.base)
            for t in m.trees[seen:]:
                ahead += np.array(t.value)[t.leaf_of(part[0])]
            seen = len(m.trees)
            held, sums = np.zeros(4), np.zeros((len(nodes), int(starts[-1]), 2))
            _add_up(part, spec, lambda rows: ahead[rows], seen, tree, nodes, validation, horizon, held, sums)
            return [r for b in _splits(growing, starts)([_packed({spec.model: held}, {spec.model: sums})]) for r in b.to_pylist()]

        (model,) = _grow(one_pass, [spec])
        return pa.table({"model": pa.array([spec.model], pa.int32()), "grown": pa.array([pickle.dumps(model)], pa.binary())})

    return run


def grow(rows: DataFrame, specs: list[Spec], bins: dict, validation: int = VALIDATION, horizon: int = HORIZON) -> list[Model]:
    """Models of ``specs`` on (pos, y, x); rows without y take no part. ``rows`` is read twice, or, with more than ``GROUP_ROWS`` in
    a window, once per tree level: stage it."""
    width = [len(e) + 2 for e in bins["edges"]] + [CATEGORIES + 1 if bins["assets"] is None else len(bins["assets"]) + 1]
    starts = np.concatenate([[0], np.cumsum(width)])
    # asset positions beyond every window are never read; a task without rows of a model adds zeros
    data = rows.filter(f"y is not null and pos < {max(s.train_end for s in specs)}").select("pos", "y", "x")
    if data.count() <= GROUP_ROWS:
        ends = rows.sparkSession.createDataFrame([(s.model, s.train_end) for s in specs], "model int, train_end int")
        dealt = data.join(F.broadcast(ends), F.col("pos") < F.col("train_end")).repartition(len(specs), "model")
        grown = dealt.groupBy("model").applyInArrow(_in_a_task(specs, starts, validation, horizon), "model int, grown binary")
        found = {r["model"]: pickle.loads(r["grown"]) for r in grown.collect()}  # a row per model
        return [found.get(s.model, Model(s)) for s in specs]

    def one_pass(growing):
        sums = data.mapInArrow(_histograms(growing, starts, validation, horizon), "model int, sums binary")
        return sums.repartition("model").mapInArrow(_splits(growing, starts), _FOUND).collect()

    return [m for i in range(0, len(specs), MODELS) for m in _grow(one_pass, specs[i : i + MODELS])]


def predict(rows: DataFrame, models: list[Model], model: str, out: str, x: str = "x") -> DataFrame:
    """Adds ``out``: the prediction of the model whose number is in the column ``model``; NULL where there is none."""
    known, columns = {m.spec.model: m.forest() for m in models}, rows.columns

    def run(batches):
        for b in batches:
            numbers, value = b[model].to_pylist(), np.full(b.num_rows, np.nan)
            if b.num_rows:
                data = _matrix(b[x], len(b[x][0].as_py()))
                for k in set(numbers) & known.keys():
                    mine = np.array([n == k for n in numbers])
                    value[mine] = known[k].predict(data[mine])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(value, pa.float64(), mask=np.isnan(value))], [*columns, out])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + f", `{out}` double")
