"""Fast exact encoding with public tokenizers: texts are cut where no token can span, distinct pieces are encoded once.

A space or newline between two characters that are no white space always starts a new token, in both vocabularies used
here, and no added token holds white space; so a text is the concatenation of its pieces' encodings. Pieces of a batch
are told apart by Arrow's dictionary encoding. Pieces of plain characters are cut into pre-tokens by one scan; each
different pre-token is encoded once and kept, and ids are put in place by gathers. Other pieces (rare letters, longer
white space, added tokens) go to the encoder whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pre-tokens kept per Python worker (about 150 bytes each), in two halves: when the newer one is full, the older one goes.
CACHE_WORDS = 400_000
#: Longer ones are not kept.
LONGEST = 64


def load(name: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def flat(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and their lengths."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(chain.from_iterable(parts), np.uint32, int(n.sum())), n


#: Letters and marks whose case, form and class are the same by every Unicode version: ASCII, Latin-1 letters, quotes, dashes.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = f"[!-;=-~{_LETTERS}‐-‧]+"  # without "<", with which added tokens begin
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
#: Pre-tokens of plain pieces that "\r" parts, with and without their space.
_KEPT = re.compile(f"{_CONTRACTED}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s")
_DROPPED = re.compile(f"{_CONTRACTED}|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+|\r")


def plain_keys(keys: pa.LargeStringArray, keep_space: bool) -> pa.BooleanArray:
    """Which keys stand for plain pieces: by one scan of the array, before any becomes a Python string."""
    return pc.match_substring_regex(keys, f"^(?:\r[ \n]?|\n)?{_PLAIN}$" if keep_space else f"^[ \n]?{_PLAIN}$")


def cut_plain(keys: pa.LargeStringArray, keep_space: bool) -> list[str]:
    """Pre-tokens of plain pieces given by their keys, with "\r" after each piece's last."""
    one = pa.LargeListArray.from_arrays(pa.array([0, len(keys)], pa.int64()), keys)
    between = pa.scalar("\r " if keep_space else "\r", pa.large_string())
    joined = pc.binary_join(one, between)[0].as_py() + "\r"
    if not keep_space:
        return _DROPPED.findall(joined.lower())
    joined = "\r " + joined
    return _KEPT.findall(joined.replace("\r \r", "\r").replace("\r \n", "\r\n")[1:])


def library_encoder(tokenizer: Tokenizer):
    """Pieces to (ids, lengths), by the whole of the library."""
    return lambda pieces: flat([e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])


def model_encoder(tokenizer: Tokenizer):
    """Plain pre-tokens to (ids, lengths), by the library's model at once, which saves most of a call's time. None where
    an added token could stand in a plain piece."""
    if not all(t.content.startswith("<") for t in tokenizer.get_added_tokens_decoder().values()):
        return None
    letter_of = {b: c for c, b in byte_letters().items()}
    letters = {p: "".join(letter_of[b] for b in chr(p).encode()) for p in [*range(256), *range(0x2010, 0x2028)]}
    del letters[ord("\r")]  # parts the words, which are translated at once
    model = tokenizer.model.tokenize

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [], []
        for x in "\r".join(parts).translate(letters).split("\r"):
            mine = [t.id for t in model(x)]
            ids += mine
            n.append(len(mine))
        return np.array(ids, np.uint32), np.array(n, np.int64)

    return encode


#: White space that keeps a text from being cut at every space and newline.
_UNSAFE = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_OTHER_SPACE = re.compile("[\x85\xa0 ᠎ -     　]")
#: Where such a text can still be cut: before a lone space or newline between characters that are no white space.
_CUT = re.compile("(?<=[^\\s᠎])(?=[ \n][^\\s᠎])")


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def taken(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """The ids of all ranges, one behind the other; indices are made for ``step`` ranges at a time."""
    out, done = np.empty(int(lengths.sum()), ids.dtype), 0
    for s in range(0, len(starts), step):
        at = gather(starts[s : s + step], lengths[s : s + step])
        out[done : done + len(at)] = ids[at]
        done += len(at)
    return out


class _Half:
    """Known pieces with their ids in one array; the first is the mark after a piece's last pre-token, which has none."""

    def __init__(self):
        self.index: dict[str, int] = {"\r": 0}
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.index.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.lengths[at]
        return taken(self.ids, self.starts[at], n), n


class WordCache:
    """Texts to ids through ``encode(pieces) -> (ids, lengths)`` and, for pre-tokens of plain characters, ``plain``.

    keep_space: the space before a word is part of its token (byte-level vocabularies); else white space is dropped.
    """

    def __init__(self, encode, keep_space: bool, limit: int = CACHE_WORDS, plain=None):
        self.encode, self.plain, self.keep_space, self.limit = encode, plain, keep_space, limit
        self.new, self.old = _Half(), _Half()

    def _prepared(self, text: str) -> str | list[str]:
        """A text whose keys stand between single spaces, or its keys.

        Keys of byte-level pieces: "\r" + piece at the start, "\n" + word after a newline, the word after a space.
        """
        safe = text and text[0] not in " \n" and text[-1] not in " \n" and not any(w in text for w in _UNSAFE)
        if safe and (text.isascii() or not _OTHER_SPACE.search(text)):
            return ("\r" + text).replace("\n", " \n") if self.keep_space else text.replace("\n", " ")
        if not text:
            return []
        pieces = _CUT.split(text)
        if self.keep_space:
            return ["\r" + pieces[0], *(p[1:] if p[0] == " " else p for p in pieces[1:])]
        return [pieces[0], *(p[1:] for p in pieces[1:])]

    def _pieces(self, keys: list[str]) -> list[str]:
        if not self.keep_space:
            return keys
        return [" " + k if k[:1] not in "\r\n" or not k else k if k[0] == "\n" else k[1:] for k in keys]

    def _coded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pre-tokens; those that begin with "\r" are pieces to be encoded whole."""
        whole = [i for i, p in enumerate(parts) if p[0] == "\r"]
        if self.plain is None or len(whole) == len(parts):
            return self.encode([p[1:] for p in parts])
        if not whole:
            return self.plain(parts)
        left = np.ones(len(parts), bool)
        left[whole] = False
        ids, n = self.plain([p for p in parts if p[0] != "\r"])
        more, m = self.encode([parts[i][1:] for i in whole])
        lengths, starts = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        lengths[left], lengths[whole] = n, m
        starts[left], starts[whole] = np.cumsum(n) - n, len(ids) + np.cumsum(m) - m
        return np.concatenate([ids, more])[gather(starts, lengths)], lengths

    def _parts_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, whether it is a mark) of pre-tokens through what is known; a mark has no ids."""
        if len(self.new.index) > self.limit // 2:
            self.old, self.new = self.new, _Half()
        at = self.new.find(parts)
        missing = np.flatnonzero(at < 0)
        rare = _Half()
        if len(missing):
            sought = [parts[i] for i in missing.tolist()]
            rank = {p: i for i, p in enumerate(dict.fromkeys(sought))}
            wanted = list(rank)
            before = self.old.find(wanted)  # what is still in use moves on to the newer half
            held, size = before >= 0, np.fromiter(map(len, wanted), np.int64, len(wanted))
            kept, short, long = (np.flatnonzero(x) for x in (held, ~held & (size <= LONGEST), ~held & (size > LONGEST)))
            where = np.full(len(wanted), -1)
            for which, coded in ((kept, lambda _: self.old.take(before[kept])), (short, self._coded)):
                if len(which):
                    where[which] = len(self.new.starts) + np.arange(len(which))
                    pieces = [wanted[i] for i in which.tolist()]
                    self.new.add(pieces, *coded(pieces))
            if len(long):
                pieces = [wanted[i] for i in long.tolist()]
                rare.add(pieces, *self._coded(pieces))
            at[missing] = where[np.fromiter(map(rank.__getitem__, sought), np.int64, len(sought))]
        if not rare.lengths.any():
            return *self.new.take(at), at == 0
        missing = np.flatnonzero(at < 0)
        at[missing] = len(self.new.starts) + rare.find([parts[i] for i in missing.tolist()])
        both = _Half()
        both.add([], self.new.ids, self.new.lengths)
        both.add([], rare.ids, rare.lengths)
        return *both.take(at + 1), at == 0

    def _keys_ids(self, keys: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each key's begin, their number)."""
        is_plain = np.zeros(len(keys), bool)
        if self.plain:
            is_plain = plain_keys(keys, self.keep_space).to_numpy(zero_copy_only=False)
        plain, parts = np.flatnonzero(is_plain), []
        if len(plain):
            parts = cut_plain(keys.filter(pa.array(is_plain)), self.keep_space)
        rest = np.flatnonzero(~is_plain)
        pieces = self._pieces(keys.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist())
        ids, n, mark = self._parts_ids(parts + ["\r" + p for p in pieces])
        at, ends = np.concatenate([[0], np.cumsum(n)]), np.flatnonzero(mark[: len(parts)])
        starts, stops = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[plain], stops[plain] = at[np.concatenate([[0], ends])[:-1]], at[ends]
        starts[rest], stops[rest] = at[len(parts) : -1], at[len(parts) + 1 :]
        return ids, starts, stops - starts

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        spaced, listed, n_keys = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            p = self._prepared(t)
            if isinstance(p, str):
                spaced.append(p)
                n_keys[i] = -1
            else:
                listed += p
                n_keys[i] = len(p)
        easy, whole = np.flatnonzero(n_keys < 0), np.flatnonzero(n_keys >= 0)
        split = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        n_keys[easy] = np.diff(split.offsets.to_numpy()) if len(easy) else 0
        keys = pa.concat_arrays([split.flatten(), pa.array(listed, pa.large_string())]).dictionary_encode()
        del spaced, listed, split
        ids, begin, n = self._keys_ids(keys.dictionary)
        at = keys.indices.to_numpy()
        begin, n = begin[at], n[at]
        ids = taken(ids, begin, n)
        order = np.concatenate([easy, whole])
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(np.concatenate([[0], n_keys[order]]))]
        counts = np.zeros(len(texts), np.int64)
        counts[order] = np.diff(ends)
        if len(whole):  # back to the texts' own order
            starts = np.zeros(len(texts), np.int64)
            starts[order] = ends[:-1]
            ids = taken(ids, starts, counts)
        return ids, counts

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, n = self.encode_flat(texts)
        raw, ends = ids.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(n)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


_caches: dict[tuple, WordCache] = {}


def library_cache(name: str, keep_space: bool, limit: int = CACHE_WORDS) -> WordCache:
    """One cache per Python worker; workers are reused between tasks, and one vocabulary is kept at a time."""
    key = (name, keep_space, limit)
    if key not in _caches:
        _caches.clear()
        tokenizer = load(name)
        _caches[key] = WordCache(library_encoder(tokenizer), keep_space, limit, plain=model_encoder(tokenizer))
    return _caches[key]


def forget() -> None:
    """Drops this worker's caches. Workers live on between tasks: what one keeps is memory that the next stage lacks."""
    _caches.clear()
