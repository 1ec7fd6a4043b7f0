"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the vector of its form (for frequent words of the training sample) beside the mean of the vectors of
its letter trigrams (for all words). Two gated recurrent layers read a window of words in both directions, attention
weighs their states, and a linear layer gives the window's logit. All windows of a text, half overlapping, are scored;
the text's score is that of its worst window. Training sees documents, not windows: of a toxic one the worst window
counts as toxic, of a clean one its worst and some random windows count as clean.

The network is fitted on at most ``SAMPLE`` labelled documents per class, the first by a hash of doc_id, from rows that
are not held out. It never sees lang, source, doc_id or a held-out label.

Null and empty texts have one window without words and so a score too. Texts are scored whole; repeated rows get equal
scores; without labels of both classes every score is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts_of

SAMPLE = 900
WINDOW, STRIDE = 48, 24
VOCABULARY, GRAMS = 6000, 2048
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
EPOCHS, MIN_STEPS, BATCH, RATE = 4, 120, 256, 0.01
_WORD = re.compile(r"\w+")


def fold(doc_id) -> F.Column:
    """0 for held-out rows: crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(word: str) -> list[int]:
    w = f"^{word}$".encode()
    return [((w[i] * 961 + w[i + 1] * 31 + w[i + 2]) * 2654435761 >> 7) % GRAMS for i in range(len(w) - 2)]


def window_starts(n: int) -> list[int]:
    """Starts of half-overlapping windows that cover n words; a text without words has one empty window."""
    return list(range(0, max(n - WINDOW, 0) + STRIDE, STRIDE)) if n > WINDOW else [0]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """The parameters, forward and backward passes. Gates lie side by side: reset, update, new."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary
        small = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"words": 0.1 * small(len(vocabulary) + 1, WORD_DIM), "grams": small(GRAMS, CHAR_DIM), "att": small(2 * h), "out": small(2 * h), "bias": np.full(1, -1, np.float32)}
        self.p["words"][1:, 0] = odds  # a start from which the worst windows are worth learning from
        for side in "fb":
            self.p |= {f"W{side}": small(d, 3 * h), f"U{side}": small(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}

    def word_inputs(self, words: list[str]):
        """(vocabulary index, trigram lists flattened, their word) of different words."""
        grams = [_grams(w) for w in words]
        of = np.repeat(np.arange(len(words)), [len(g) for g in grams])
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64), np.array([x for g in grams for x in g], np.int64), of

    def vectors(self, inputs) -> np.ndarray:
        index, grams, of = inputs
        n = np.bincount(of, minlength=len(index)).astype(np.float32)
        if len(grams):
            total = np.stack([np.bincount(of, weights=self.p["grams"][grams, k], minlength=len(index)) for k in range(CHAR_DIM)], 1)
        else:
            total = np.zeros((len(index), CHAR_DIM))
        return np.concatenate([self.p["words"][index], (total / np.maximum(n, 1)[:, None]).astype(np.float32)], 1)

    def _scan(self, side: str, gates: np.ndarray, at: np.ndarray, keep=None):
        """States over time; ``gates`` are input projections by word, ``at`` the words of each window (-1: none)."""
        n, t = at.shape
        u, h3 = self.p[f"U{side}"], HIDDEN
        state, out = np.zeros((n, h3), np.float32), np.empty((t, n, h3), np.float32)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            x, m = gates[at[:, k]], (at[:, k] >= 0)[:, None]
            rec = state @ u
            rz = _sigmoid(x[:, : 2 * h3] + rec[:, : 2 * h3])
            new = np.tanh(x[:, 2 * h3 :] + rz[:, :h3] * rec[:, 2 * h3 :])
            nxt = new + rz[:, h3:] * (state - new)
            if keep is not None:
                keep.append((k, state, rec[:, 2 * h3 :], rz, new, m))
            state = np.where(m, nxt, state)
            out[k] = state
        return out

    def logits(self, vectors: np.ndarray, at: np.ndarray, keep=None) -> np.ndarray:
        p = self.p
        saved = {side: [] for side in "fb"} if keep is not None else {"f": None, "b": None}
        states = [self._scan(s, np.append(vectors @ p[f"W{s}"] + p[f"c{s}"], np.zeros((1, 3 * HIDDEN), np.float32), 0), at, saved[s]) for s in "fb"]
        h = np.concatenate(states, 2)
        mask = (at.T >= 0)[:, :, None]
        a = np.exp(np.clip(h @ p["att"], -30, 30))[:, :, None] * mask
        a = a / np.maximum(a.sum(0), 1e-9)
        pooled = (a * h).sum(0)
        if keep is not None:
            keep.update(saved=saved, h=h, a=a, pooled=pooled)
        return pooled @ p["out"] + p["bias"]

    def gradients(self, inputs, vectors, at, labels, weights):
        """Gradients of the weighted logistic loss over windows."""
        p, keep, g = self.p, {}, {}
        logit = self.logits(vectors, at, keep)
        d = ((_sigmoid(logit) - labels) * weights / len(labels)).astype(np.float32)
        g["bias"], g["out"] = d.sum(keepdims=True), keep["pooled"].T @ d
        dpool = d[:, None] * p["out"]
        h, a = keep["h"], keep["a"]
        score = (dpool * h).sum(2)
        da = a[:, :, 0] * (score - (a[:, :, 0] * score).sum(0))
        g["att"] = np.einsum("tn,tnh->h", da, h)
        dh = a * dpool + da[:, :, None] * p["att"]
        dvec = np.zeros_like(vectors)
        h1 = HIDDEN
        for i, side in enumerate("fb"):
            u, flow = p[f"U{side}"], np.zeros((len(labels), h1), np.float32)
            du = np.zeros_like(u)
            dgates = np.zeros((len(vectors) + 1, 3 * h1), np.float32)
            for k, before, rec, rz, new, m in reversed(keep["saved"][side]):
                flow = flow + dh[k, :, i * h1 : (i + 1) * h1]
                live = flow * m
                r, z = rz[:, :h1], rz[:, h1:]
                dnew = live * (1 - z) * (1 - new * new)
                dz = live * (before - new) * z * (1 - z)
                dr = dnew * rec * r * (1 - r)
                gate = np.concatenate([dr, dz, dnew], 1)
                back = np.concatenate([dr, dz, dnew * r], 1)
                du += before.T @ back
                np.add.at(dgates, at[:, k], gate)
                flow = flow * ~m + live * z + back @ u.T
            dgates = dgates[:-1]
            g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = du, vectors.T @ dgates, dgates.sum(0)
            dvec += dgates @ p[f"W{side}"].T
        index, grams, of = inputs
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], index, dvec[:, :WORD_DIM])
        n = np.maximum(np.bincount(of, minlength=len(index)), 1)
        g["grams"] = np.zeros_like(p["grams"])
        np.add.at(g["grams"], grams, (dvec[:, WORD_DIM:] / n[:, None])[of])
        return g


def _windows(words: list[int]) -> np.ndarray:
    starts = window_starts(len(words))
    out = np.full((len(starts), WINDOW), -1, np.int32)
    for i, s in enumerate(starts):
        part = words[s : s + WINDOW]
        out[i, : len(part)] = part
    return out


def train(texts: list[str], labels: list[int], seed: int = 0) -> Network:
    """Fits the network on labelled texts."""
    r = np.random.default_rng(seed)
    y = np.array(labels)
    lists = [words_of(t) for t in texts]
    seen = {1: {}, 0: {}}
    for ws, c in zip(lists, y.tolist()):
        for w in set(ws):
            seen[c][w] = seen[c].get(w, 0) + 1
    common = {w: seen[0].get(w, 0) + seen[1].get(w, 0) for w in seen[0].keys() | seen[1].keys()}
    ranked = sorted((w for w, n in common.items() if n >= 4), key=lambda w: (-common[w], w))[:VOCABULARY]
    n1, n0 = y.sum(), (1 - y).sum()
    odds = np.array([np.log((seen[1].get(w, 0) + 1) / (n1 + 2)) - np.log((seen[0].get(w, 0) + 1) / (n0 + 2)) for w in ranked], np.float32)
    net = Network({w: i + 1 for i, w in enumerate(ranked)}, odds if len(ranked) else np.zeros(0, np.float32), seed)
    number: dict[str, int] = {}
    docs = [_windows([number.setdefault(w, len(number)) for w in ws]) for ws in lists]
    inputs = net.word_inputs(list(number))
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    windows = np.concatenate(docs)
    # The first round's worst windows: the largest sums of positive log-odds.
    gain = np.append(np.maximum(np.append(0, odds)[inputs[0]], 0), 0)
    value = gain[windows].sum(1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = epoch = 0
    while epoch < EPOCHS or step < MIN_STEPS:
        if epoch:
            vec = net.vectors(inputs)
            value = np.concatenate([net.logits(vec, windows[i : i + 4096]) for i in range(0, len(windows), 4096)])
        worst = np.lexsort((-value, owner))[np.append(0, np.cumsum([len(d) for d in docs]))[:-1]]
        clean = np.flatnonzero(y[owner] == 0)
        extra = r.choice(clean, min(len(clean), 2 * len(docs)), replace=False)
        chosen = np.concatenate([worst, extra])
        r.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            ids = chosen[a : a + BATCH]
            used, at = np.unique(windows[ids], return_inverse=True)
            at = at.reshape(len(ids), WINDOW) - (used[0] == -1)
            used = used[used >= 0]
            step += 1
            if not len(used):
                continue
            keep = np.isin(inputs[2], used)
            part = inputs[0][used], inputs[1][keep], np.searchsorted(used, inputs[2][keep])
            label = y[owner[ids]]
            grad = net.gradients(part, net.vectors(part), at, label, np.ones(len(ids)))
            for k, gk in grad.items():
                m, v = moment[k]
                m += 0.1 * (gk - m)
                v += 0.001 * (gk * gk - v)
                net.p[k] -= (RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        epoch += 1
    return net


class Scorer:
    """A network with the input projections of the words met so far."""

    LIMIT = 150_000

    def __init__(self, net: Network):
        self.net, self.number = net, {}
        self.gates = {s: np.zeros((0, 3 * HIDDEN), np.float32) for s in "fb"}

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.number) > self.LIMIT:
            self.__init__(self.net)
        lists = [words_of(t) for t in texts]
        number, before = self.number, len(self.number)
        docs = [_windows([number.setdefault(w, len(number)) for w in ws]) for ws in lists]
        if len(number) > before:
            vec = self.net.vectors(self.net.word_inputs(list(number)[before:]))
            for s in "fb":
                self.gates[s] = np.concatenate([self.gates[s], vec @ self.net.p[f"W{s}"] + self.net.p[f"c{s}"]])
        rows = np.concatenate(docs)
        gates = {s: np.append(self.gates[s], np.zeros((1, 3 * HIDDEN), np.float32), 0) for s in "fb"}
        logit = np.concatenate([self._logits(gates, rows[i : i + 4096]) for i in range(0, len(rows), 4096)])
        return _sigmoid(np.maximum.reduceat(logit, np.append(0, np.cumsum([len(d) for d in docs]))[:-1]).astype(np.float64))

    def _logits(self, gates, at):
        net, p = self.net, self.net.p
        h = np.concatenate([net._scan(s, gates[s], at) for s in "fb"], 2)
        a = np.exp(np.clip(h @ p["att"], -30, 30))[:, :, None] * (at.T >= 0)[:, :, None]
        return ((a / np.maximum(a.sum(0), 1e-9)) * h).sum(0) @ p["out"] + p["bias"]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Trains on the first ``sample`` rows of each class by a hash of doc_id, held-out rows apart."""
    seen = labels.filter("doc_id is not null and toxic in (0, 1)").filter(fold("doc_id") != 0).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = seen.filter("toxic = 1").orderBy(*order).limit(sample).union(seen.filter("toxic = 0").orderBy(*order).limit(sample))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    found.sort(key=lambda r: (r.doc_id, r.text or ""))
    y = [r.toxic for r in found]
    return train([r.text or "" for r in found], y) if 0 < sum(y) < len(y) else None


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for b in slices(batches):
            texts = texts_of(b["text"])
            s = [scorer.scores(texts[i : i + 1000]) if scorer else np.zeros(len(texts[i : i + 1000])) for i in range(0, len(texts), 1000)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
