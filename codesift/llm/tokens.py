"""Texts to token ids with the ``tokenizers`` library, for whole Arrow batches.

The byte-level vocabulary first cuts a text into pieces (words, numbers, marks, blanks) and then merges bytes inside each
piece only.  So a piece has the same ids wherever it stands: the pieces of a batch are found with array operations, the
library encodes each distinct piece once per Python worker, and the ids are gathered back.  Texts outside the plain case
(letters beyond Latin-1, unusual blanks, contractions, the name of a special token) go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from codesift.llm.arrays import flat, slices, span_hashes

VOCABULARY = "byte_bpe_50k.json"
END_OF_TEXT = 50256

# Distinct pieces a worker remembers; beyond it the memory starts anew.
MEMO_PIECES = 400_000

_LETTER, _DIGIT, _BLANK, _MARK, _ODD = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    c = np.full(256, _ODD, np.uint8)
    for b in range(0x21, 0x7F):
        c[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    c[[0x20, 0x0A]] = _BLANK
    c[0xC3] = _LETTER
    c[0x80:0xC0] = _LETTER
    return c


_CLASS = _classes()


@lru_cache(2)
def library(path: str, special: bool):
    """The library's tokenizer; ``special``: names of special tokens in a text become their ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return t


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def plain(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts hold only what the piece finder knows."""
    c = _CLASS[data]
    bad = c == _ODD
    after = np.empty_like(data)
    after[:-1], after[-1:] = data[1:], 0
    high = (data >= 0x80) & (data < 0xC0)
    lead = data == 0xC3
    before = np.zeros(len(data), bool)
    before[1:] = lead[:-1]
    bad |= high & ~before
    bad |= before & ((data == 0x97) | (data == 0xB7))
    quote = data == 0x27
    if quote.any():
        bad |= quote & np.isin(after, np.frombuffer(b"stmdrlv", np.uint8))
    angle = data == 0x3C
    if angle.any():
        bad |= angle & (after == 0x7C)
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[offs[1:]] == total[offs[:-1]]


def pieces(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts; every byte belongs to one piece."""
    n = len(data)
    c = _CLASS[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    blank = c == _BLANK
    prev = np.empty_like(c)
    prev[0], prev[1:] = _ODD, c[:-1]
    space_before = np.zeros(n, bool)
    space_before[1:] = data[:-1] == 0x20
    starts = (c != prev) & ~(space_before & ~blank)
    tail = np.zeros(n, bool)
    tail[:-1] = blank[:-1] & ~blank[1:] & ~first[1:-1]
    starts |= tail | first[:-1]
    return np.flatnonzero(starts)


class Encoder:
    """Encodes text columns; one per Python worker and vocabulary."""

    def __init__(self, path: str, special: bool) -> None:
        self.tokenizer = library(path, special)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.n_ids = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.len = np.zeros(1 << 14, np.int64)
        self.head = np.zeros(1 << 14, np.uint64)

    def _learn(self, keys: list[int], heads: np.ndarray, texts: list[bytes]) -> None:
        """Adds pieces.  Those of a blank and more are encoded side by side in one text, as the cut between them is sure."""
        found: list[list[int] | None] = [None] * len(texts)
        chained = [i for i, t in enumerate(texts) if t[:1] == b" " and len(t) > 1 and t[1:2] not in b" \n"]
        for a in range(0, len(chained), 2000):
            part = chained[a: a + 2000]
            e = self.tokenizer.encode(b"".join(texts[i] for i in part).decode(), add_special_tokens=False)
            words = np.array(e.word_ids, np.int64)
            if len(words) and int(words[-1]) == len(part) - 1:
                cuts = np.flatnonzero(np.diff(words)) + 1
                for i, ids in zip(part, np.split(np.array(e.ids, np.uint32), cuts)):
                    found[i] = ids
        rest = [i for i, f in enumerate(found) if f is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i].decode() for i in rest], add_special_tokens=False)):
            found[i] = np.array(e.ids, np.uint32)
        for k, h, ids in zip(keys, heads.tolist(), found):
            row = len(self.index)
            if row == len(self.at):
                self.at, self.len, self.head = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len, self.head))
            while self.n_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.index[k] = row
            self.at[row], self.len[row], self.head[row] = self.n_ids, len(ids), h
            self.ids[self.n_ids: self.n_ids + len(ids)] = ids
            self.n_ids += len(ids)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32) for t in texts]

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray] | None:
        """Ids of each text, or None if two pieces share a hash (then the library takes the texts whole)."""
        if not len(data):
            return [np.zeros(0, np.uint32)] * (len(offs) - 1)
        starts = pieces(data, offs)
        ends = np.append(starts[1:], len(data))
        keys, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[starts].copy()
        short = np.minimum(ends - starts, 8)
        eight &= np.where(short == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short * 8).astype(np.uint64) % np.uint64(64)) - np.uint64(1))
        if (eight[first][back] != eight).any():
            return None
        if len(self.index) > MEMO_PIECES:
            self._forget()
        listed = keys.tolist()
        row = np.array([self.index.get(k, -1) for k in listed], np.int64)
        if (new := np.flatnonzero(row < 0)).size:
            at = first[new]
            raw = data.tobytes()
            known = len(self.index)
            self._learn([listed[i] for i in new.tolist()], eight[at], [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            row[new] = np.arange(known, known + len(new))
        if (self.head[row] != eight[first]).any():
            return None
        rows = row[back]
        n = self.len[rows]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[rows] - (stop - n), n) + np.arange(int(stop[-1]))]
        bounds = np.concatenate([[0], stop])[np.searchsorted(starts, offs)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of every text of a column; null is empty."""
        data, offs = flat(column)
        out: list[np.ndarray] = []
        for i, j in slices(offs, 2 << 20):
            part, at = data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
            ok = plain(part, at) if len(part) else np.ones(j - i, bool)
            if ok.all():
                got = self._plain(part, at)
            else:
                keep = np.repeat(ok, np.diff(at))
                got = self._plain(part[keep], np.concatenate([[0], np.cumsum(np.diff(at)[ok])]))
            odd = np.arange(j - i) if got is None else np.flatnonzero(~ok)
            rest = self._whole([part[at[k]: at[k + 1]].tobytes() for k in odd.tolist()])
            if got is None:
                out += rest
                continue
            took, spare = iter(got), iter(rest)
            out += [next(took) if k else next(spare) for k in ok.tolist()]
        return out


@lru_cache(2)
def encoder(path: str, special: bool = True) -> Encoder:
    return Encoder(path, special)
