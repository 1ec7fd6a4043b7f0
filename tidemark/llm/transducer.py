"""Token counts by finite-state transducers, without making tokens.

Two machines are compiled from a byte-level BPE vocabulary.

* The segmenter reads character classes and says where pre-tokens begin. It has twelve states. A text is cut into
  chunks; each chunk's map from entry state to exit state is found on its own, maps compose through a parallel prefix
  scan, and so every chunk learns its true entry state without reading what lies before it.
* The counter reads the bytes of pre-tokens; each transition is annotated with the number of tokens by which the
  prefix's count changes (it may fall, when a longer token forms). Its states are compiled as input reaches them: a
  state holds the bytes that a token may still span and, for each place in them where one could begin, the last token
  before it. A token may end a prefix only if no merge could join it with the token before; the first byte of a
  pre-token leads back to the root, so chunk maps of the counter are constant after their first boundary and each
  lane simply runs on to the first boundary of the next chunk. A pre-token of many chunks is counted in parts: their
  maps, made at the entry state that the bytes before a part lead to, compose from part to part.

Null and empty texts have no tokens; texts are counted whole; special tokens inside texts count as one.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.bpe import Vocabulary
from tidemark.llm.common import slices, texts_of

CHUNK = 512

# Character classes and segmenter states.
LETTER, L_STMD, L_E, L_RV, L_L, NUMBER, OTHER, QUOTE, BLANK, WHITE = range(10)
START, IN_L, IN_N, IN_O, ONE_BLANK, ONE_WHITE, RUN_BLANK, RUN_WHITE, AFTER_QUOTE, QUOTE_RV, QUOTE_L, CUT = range(12)
N_CLASS, N_STATE = 10, 12
HERE, BEFORE = 1, 2  # outputs: a pre-token begins at this character, at the one before it


def _segmenter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) for each state and class."""
    to, out = np.zeros((N_STATE, N_CLASS), np.uint8), np.zeros((N_STATE, N_CLASS), np.uint8)
    run = {NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O} | dict.fromkeys((LETTER, L_STMD, L_E, L_RV, L_L), IN_L)
    for s in range(N_STATE):
        for c in range(N_CLASS):
            blank = c in (BLANK, WHITE)
            if blank and s in (ONE_BLANK, ONE_WHITE, RUN_BLANK, RUN_WHITE):
                to[s, c] = RUN_BLANK if c == BLANK else RUN_WHITE
            elif blank:
                to[s, c], out[s, c] = (ONE_BLANK if c == BLANK else ONE_WHITE), HERE
            elif s in (ONE_BLANK, RUN_BLANK):  # a word takes one blank before it
                to[s, c], out[s, c] = run[c], BEFORE if s == RUN_BLANK else 0
            elif s in (IN_L, IN_N, IN_O) and run[c] == s:
                to[s, c] = s
            else:
                to[s, c], out[s, c] = (AFTER_QUOTE if c == QUOTE else run[c]), HERE
                if s == RUN_WHITE:
                    out[s, c] |= BEFORE
            if s == AFTER_QUOTE and not blank:  # 's 't 'm 'd are whole; 're 've 'll need one more letter
                if c == L_STMD:
                    to[s, c], out[s, c] = CUT, 0
                elif c in (L_RV, L_L):
                    to[s, c], out[s, c] = (QUOTE_RV if c == L_RV else QUOTE_L), 0
                elif run[c] == IN_O:
                    to[s, c], out[s, c] = IN_O, 0
                else:
                    to[s, c], out[s, c] = run[c], HERE
            if s in (QUOTE_RV, QUOTE_L):
                if (s, c) in ((QUOTE_RV, L_E), (QUOTE_L, L_L)):
                    to[s, c], out[s, c] = CUT, 0
                else:  # not a contraction: the letter began a word
                    to[s, c] = to[IN_L, c]
                    out[s, c] = out[IN_L, c] | BEFORE
    return to, out


TO, OUT = (x.ravel() for x in _segmenter())


def character_classes(tokenizer) -> np.ndarray:
    """The class of every code point, as the tokenizer itself splits it: what joins a letter is a letter, and so on."""
    table = np.full(0x110000, OTHER, np.uint8)
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    for a in range(0, len(points), 1 << 14):
        part = np.array(points[a : a + (1 << 14)])
        text = "".join(f"\na{chr(c)}1" for c in part)
        cuts = np.zeros(len(text), bool)
        cuts[[s for _, (s, _) in split(text)]] = True
        table[part[~cuts[2::4]]] = LETTER
        table[part[~cuts[3::4] & cuts[2::4]]] = NUMBER
    for c in points:  # white space between two marks is a token of its own
        if (chr(c).isspace() or unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc")) and len(split(f"!{chr(c)}!")) == 3:
            table[c] = WHITE
    table[ord(" ")] = BLANK
    table[ord("'")] = QUOTE
    for letters, kind in (("stmd", L_STMD), ("e", L_E), ("rv", L_RV), ("l", L_L)):
        table[[ord(x) for x in letters]] = kind
    return table


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Row-wise composition of state maps."""
    return np.take_along_axis(then, first.astype(np.int64), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps (rows) under composition, by doubling."""
    d = 1
    while d < len(maps):
        maps = np.concatenate([maps[:d], compose(maps[:-d], maps[d:])])
        d *= 2
    return maps


def boundaries(classes: np.ndarray, doc_starts: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(a pre-token begins at this character, chunk starts) for the joined texts that begin at ``doc_starts``."""
    n = len(classes)
    ends = np.append(doc_starts[1:], n)
    per = -(-(ends - doc_starts) // chunk)
    first = np.cumsum(per) - per
    begin = np.repeat(doc_starts, per) + (np.arange(int(per.sum())) - np.repeat(first, per)) * chunk
    stop = np.minimum(begin + chunk, np.repeat(ends, per))
    opens = np.zeros(len(begin), bool)
    opens[first] = True
    # Chunk maps: all entry states run side by side until they have met (or the chunk ends), then one lane goes on.
    maps = np.tile(np.arange(N_STATE, dtype=np.uint8), (len(begin), 1))
    maps[opens] = START
    live = np.arange(len(begin))
    pos = begin.copy()
    while len(live := live[(pos[live] < stop[live]) & (maps[live] != maps[live, :1]).any(axis=1)]):
        maps[live] = TO[maps[live].astype(np.int64) * N_CLASS + classes[pos[live]][:, None]]
        pos[live] += 1
    state = maps[:, 0].astype(np.int64)
    met = (maps == maps[:, :1]).all(axis=1)
    live = np.flatnonzero(met & (pos < stop))
    while len(live):
        state[live] = TO[state[live] * N_CLASS + classes[pos[live]]]
        pos[live] += 1
        live = live[pos[live] < stop[live]]
    maps[met] = state[met, None].astype(np.uint8)
    scanned = prefix_scan(maps)
    entry = np.full(len(begin), START, np.int64)
    entry[1:] = scanned[:-1, START]
    entry[opens] = START
    # The chunks run once more from their true entry states, with outputs.
    here = np.zeros(n, np.uint8)
    live, state, pos = np.arange(len(begin)), entry, begin.copy()
    while len(live):
        k = state[live] * N_CLASS + classes[pos[live]]
        state[live] = TO[k]
        here[pos[live]] = OUT[k]
        pos[live] += 1
        live = live[pos[live] < stop[live]]
    cuts = (here & HERE) > 0
    cuts[:-1] |= (here[1:] & BEFORE) > 0
    # a pending contraction at a text's end was a word after all
    tail = np.zeros(N_STATE, bool)
    tail[[QUOTE_RV, QUOTE_L]] = True
    last = np.flatnonzero(np.append(opens[1:], True))
    cuts[stop[last][tail[state[last]]] - 1] = True
    return cuts, begin


class Counter:
    """The counting transducer, compiled lazily and kept for the life of a Python worker."""

    #: States kept (about 1 KB each); beyond that only those in use are, also within a batch.
    MAX_STATES = 100_000
    #: Longer pre-tokens are counted in parts of so many bytes, each entered with the state that so many bytes before it lead to.
    PART, WARM_UP = 2048, 96

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        special = set(v.special.values())
        self.token = {b: i for i, b in enumerate(v.bytes) if b and i not in special}
        self.bytes = v.bytes
        self.open = {b[:n] for b in self.token for n in range(1, len(b))}  # proper prefixes of tokens
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(v.merges)}
        made = {c: (a, b, r) for r, (a, b, c) in reversed(list(enumerate(v.merges)))}
        self.right, self.left = {}, {}
        self.parts = made
        self.fits: dict[tuple[int, int], bool] = {}
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self._clear()

    def _clear(self) -> None:
        self.states = [(b"", ((None, 0),))]
        self.index = {self.states[0]: 0}
        self.width = max(self.columns, 128)
        self.next = np.full(4096 * self.width, -1, np.int32)
        self.delta = np.zeros(4096 * self.width, np.int8)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens along one edge of a token's merge tree, with the rank at which each is merged into its parent."""
        memo = self.left if side == 0 else self.right
        found = memo.get(token)
        if found is None:
            found, up, t = [], float("inf"), token
            while True:
                found.append((t, up))
                if t not in self.parts:
                    break
                up = self.parts[t][2]
                t = self.parts[t][side]
            memo[token] = found
        return found

    def fit(self, a: int, b: int) -> bool:
        """Whether no merge joins parts of two neighbours, so that a, b is how their bytes are encoded."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            known = True
            for x, up_x in self._spine(a, 1):
                for y, up_y in self._spine(b, 0):
                    r = self.rank.get((x, y))
                    if r is not None and r < up_x and r <= up_y:
                        known = False
            if len(self.fits) > 200_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        open_bytes, ends = self.states[state]
        s = open_bytes + bytes([byte])
        for i in range(len(s)):  # the longest token that may end here
            if ends[i] is None:
                continue
            t = self.token.get(s[i:])
            if t is not None and (ends[i][0] is None or self.fit(ends[i][0], t)):
                now = (t, ends[i][1] + 1)
                break
        k = 0
        while k < len(s) and s[k:] not in self.open:
            k += 1
        live, base = s[k:], now[1]
        left = [(e[0], e[1] - base) if e is not None and live[i:] in self.open else None for i, e in enumerate(ends[k:])]
        made = (live, (*left, (t, 0)))
        return self._number(made), base

    def _compile(self, keys: np.ndarray) -> None:
        """Fills in transitions that the input asks for."""
        byte_of = np.argsort(self.column)[-self.columns :]  # columns are dealt in order of appearance
        for k in keys.tolist():
            state, column = divmod(k, self.width)
            to, base = self._step(state, int(byte_of[column]))
            self.next[k], self.delta[k] = to, base

    def _room(self) -> None:
        while len(self.states) * self.width > len(self.next):
            self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
            self.delta = np.concatenate([self.delta, np.zeros(len(self.delta), np.int8)])

    def _number(self, made: tuple) -> int:
        """The number of a state, new or known."""
        found = self.index.get(made)
        if found is None:
            found = self.index[made] = len(self.states)
            self.states.append(made)
            self._room()
        return found

    def _run(self, columns: np.ndarray, cuts: np.ndarray | None, pos: np.ndarray, end: np.ndarray, entry: list[tuple]):
        """(tokens, exit state) of each lane pos..end, entered in a state of its own; ``cuts`` lead back to the root."""
        total, final = np.zeros(len(pos), np.int64), list(entry)
        live = np.flatnonzero(pos < end)
        pos, end = pos[live], end[live]
        state = np.array([self._number(entry[i]) for i in live.tolist()], np.int64)
        while len(live):
            if cuts is not None:
                state[cuts[pos]] = 0
            key = state * self.width + columns[pos]
            to = self.next[key]
            if (to < 0).any():
                self._compile(np.unique(key[to < 0]))
                to = self.next[key]
            total[live] += self.delta[key]
            state = to.astype(np.int64)
            pos = pos + 1
            on = pos < end
            if not on.all():
                for i, k in zip(live[~on].tolist(), state[~on].tolist()):
                    final[i] = self.states[k]
                live, pos, end, state = live[on], pos[on], end[on], state[on]
            if len(self.states) > self.MAX_STATES:
                used, place = np.unique(state, return_inverse=True)
                kept = [self.states[k] for k in used.tolist()]
                self._clear()
                state = np.array([self._number(k) for k in kept], np.int64)[place] if len(kept) else state
        return total, final

    def _long(self, columns: np.ndarray, start: int, end: int) -> int:
        """Tokens of one long pre-token. Its parts run side by side, each from the state that the bytes just before it
        lead to; that gives the part's state map at one entry. Maps compose from the first part on; where a part was not
        entered in its true state, it runs again from that one."""
        at = np.arange(start, end, self.PART)
        stop = np.minimum(at + self.PART, end)
        root = (b"", ((None, 0),))
        warm = np.maximum(at - self.WARM_UP, start)
        _, entry = self._run(columns, None, warm, at, [root] * len(at))
        total, leave = self._run(columns, None, at, stop, entry)
        n, state = 0, root
        for i in range(len(at)):
            if state == entry[i]:
                n, state = n + int(total[i]), leave[i]
            else:
                more, (state,) = self._run(columns, None, at[i : i + 1], stop[i : i + 1], [state])
                n += int(more[0])
        return n

    def count(self, data: np.ndarray, cuts: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Tokens of each lane: from its first pre-token that begins in [begin, stop) to the end of its last."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        self.column[new] = self.columns + np.arange(len(new))
        self.columns += len(new)
        if self.columns > self.width:
            self._clear()
        columns = self.column[data]
        at = np.append(np.flatnonzero(cuts), len(data))
        first, after = np.searchsorted(at, begin), np.searchsorted(at, stop)
        pos, end = at[first], at[after]
        last = at[np.maximum(after - 1, 0)]  # where the lane's last pre-token begins
        long = np.flatnonzero((pos < end) & (end - last > 2 * self.PART))
        tail = end[long]
        end[long] = last[long]
        total, _ = self._run(columns, cuts, pos, end, [self.states[0]] * len(pos))
        for i, s, e in zip(long.tolist(), last[long].tolist(), tail.tolist()):
            total[i] += self._long(columns, s, e)
        return total


class TokenCounter:
    def __init__(self, name: str, classes: np.ndarray):
        self.vocabulary = Vocabulary(name)
        self.classes = classes
        self.counter = Counter(self.vocabulary)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, tokens) of each text."""
        specials = list(self.vocabulary.special)
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if any(s in t for s in specials):
                split = self.vocabulary.marks.split(t)
                extra[i] = sum(p in self.vocabulary.special for p in split)
                sizes[i] = sum(len(p) for p in split if p in self.vocabulary.special)
                mine = [p for p in split if p and p not in self.vocabulary.special]
            else:
                mine = [t] if t else []
            parts += mine
            owner += [i] * len(mine)
        if not parts:
            return sizes, extra
        text = "".join(parts)
        raw = text.encode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        lengths = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(lengths) - lengths
        if len(raw) == len(text):
            points, char_at = data, None
        else:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            char_at = np.flatnonzero((data & 0xC0) != 0x80)
        cuts, begin = boundaries(self.classes[points], starts)
        if char_at is not None:
            wide = np.zeros(len(data), bool)
            wide[char_at[cuts]] = True
            cuts, begin, starts = wide, char_at[begin], char_at[starts]
        stop = np.append(begin[1:], len(data))
        lane = self.counter.count(data, cuts, begin, stop)
        part = np.searchsorted(starts, begin, "right") - 1
        owner = np.array(owner)
        size = np.diff(np.append(starts, len(data)))
        n = np.bincount(owner[part], weights=lane, minlength=len(texts)).astype(np.int64)
        sizes += np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        return sizes, n + extra


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. A map over id and text; the class table (1.1 MB) is shipped once."""
    classes = docs.sparkSession.sparkContext.broadcast(character_classes(tokens.load(tokenizer)))

    def run(batches):
        if tokenizer not in _counters:
            _counters[tokenizer] = TokenCounter(tokenizer, classes.value)
        counter = _counters[tokenizer]
        for b in slices(batches):
            size, n = counter.counts(texts_of(b["text"]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
