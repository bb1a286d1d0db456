"""Weighted acyclic automata over words: count transducers.

A transducer reads an n-gram word by word and gives how often it was counted. Its
states are those of a tree of prefixes, kept depth first in three columns, so
that a state costs a few bytes: the number of the word that leads to it, how
deep it lies, and how often an n-gram ends in it. Since n-grams come sorted, each
adds the states past the prefix that it shares with the one before it.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

Path = tuple[bytes, ...]

#: Three word numbers fit into one 64-bit key below this.
_SMALL = 1 << 21


def _sorted_rows(rows: np.ndarray, n_words: int) -> np.ndarray:
    """The order of rows by their columns."""
    if n_words + 1 >= _SMALL:
        return np.lexsort(rows.T[::-1])
    columns = rows.astype(np.int64)
    wide = np.zeros((len(rows), -rows.shape[1] % 3), dtype=np.int64)
    columns = np.concatenate([columns, wide], axis=1)
    keys = [(columns[:, i] << 42) | (columns[:, i + 1] << 21) | columns[:, i + 2] for i in range(0, columns.shape[1], 3)]
    return np.lexsort(keys[::-1])


@dataclass
class CountTransducer:
    """`words` are sorted; `word` of a state is its place among them plus one."""
    words: list[bytes]
    word: np.ndarray
    depth: np.ndarray
    ends: np.ndarray
    longest: int

    @classmethod
    def build(cls, words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> CountTransducer:
        """From rows of word numbers, filled up with 0, and their counts; equal rows are added up."""
        longest = rows.shape[1]
        if len(rows):
            order = _sorted_rows(rows, len(words))
            rows, counts = rows[order], counts[order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
            counts = np.add.reduceat(counts, np.flatnonzero(new))
            rows = rows[new]
        shared = np.zeros(len(rows), dtype=np.int64)
        if len(rows) > 1:
            shared[1:] = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1).sum(axis=1)
        lengths = (rows > 0).sum(axis=1)
        place = np.arange(longest)
        added = (place >= shared[:, None]) & (place < lengths[:, None])
        ends = np.zeros(int(added.sum()), dtype=np.int64)
        ends[np.cumsum(added.sum(axis=1)) - 1] = counts
        depth = np.broadcast_to(place + 1, rows.shape)[added]
        return cls(words, rows[added].astype(np.int32), depth.astype(np.int8), ends, longest)

    def above(self, depth: int) -> np.ndarray:
        """For every state the last one of that depth up to it; of use where the state is as deep or deeper."""
        here = np.where(self.depth == depth, np.arange(len(self.depth)), 0)
        return np.maximum.accumulate(here) if len(here) else here

    def paths(self, states: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Rows of word numbers of the paths to the states."""
        depth = self.depth[states]
        out = np.zeros((len(depth), self.longest), dtype=np.int32)
        for d in range(1, self.longest + 1):
            on_path = self.word[self.above(d)[states]] if len(self.word) else self.word
            out[:, d - 1] = np.where(depth >= d, on_path, 0)
        return out

    def weights(self) -> np.ndarray:
        """For every state how often an n-gram goes through it or ends in it."""
        total = np.concatenate([[0], np.cumsum(self.ends)])
        out = np.zeros(len(self.depth), dtype=np.int64)
        for d in range(1, self.longest + 1):
            borders = np.append(np.flatnonzero(self.depth <= d), len(self.depth))
            mine = self.depth[borders[:-1]] == d
            out[borders[:-1][mine]] = total[borders[1:][mine]] - total[borders[:-1][mine]]
        return out

    def named(self, states: np.ndarray) -> list[Path]:
        return [tuple(self.words[w - 1] for w in row if w) for row in self.paths(states).tolist()]

    def _part(self, rows: np.ndarray, counts: np.ndarray) -> CountTransducer:
        used, numbers = np.unique(rows, return_inverse=True)
        first = 0 if len(used) and used[0] == 0 else 1
        return CountTransducer.build([self.words[w - 1] for w in used if w], (numbers.reshape(rows.shape) + first).astype(np.int32), counts)

    def cut(self, splitters: Sequence[Path]) -> list[tuple[int, CountTransducer]]:
        """(number, transducer) of the ranges between sorted splitters that have n-grams; a range begins with its splitter."""
        ends = np.flatnonzero(self.ends)
        rows, counts = self.paths(ends), self.ends[ends]
        borders = [0]
        for path in splitters:
            numbers = [self._between(w) for w in path] + [0] * (self.longest - len(path))
            borders.append(bisect.bisect_left(range(len(rows)), numbers, lo=borders[-1], key=lambda i: rows[i].tolist()))
        borders.append(len(rows))
        return [(k, self._part(rows[i:j], counts[i:j])) for k, (i, j) in enumerate(zip(borders[:-1], borders[1:], strict=True)) if j > i]

    def _between(self, word: bytes) -> float:
        at = bisect.bisect_left(self.words, word)
        return at + 1 if at < len(self.words) and self.words[at] == word else at + 0.5

    @classmethod
    def union(cls, parts: Iterable[CountTransducer], longest: int) -> CountTransducer:
        """One transducer that adds up the counts of all."""
        parts = [p for p in parts if len(p.word)]
        words = sorted(set().union(*(p.words for p in parts)))
        number = {w: i + 1 for i, w in enumerate(words)}
        rows, counts = [np.zeros((0, longest), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for p in parts:
            ends = np.flatnonzero(p.ends)
            there = np.array([0, *(number[w] for w in p.words)], dtype=np.int32)
            rows.append(there[p.paths(ends)])
            counts.append(p.ends[ends])
        return cls.build(words, np.concatenate(rows), np.concatenate(counts))

    def composed(self, asked: CountTransducer) -> np.ndarray:
        """For every state of `asked` the state reached here by the same words, or -1: both are walked together, depth by depth."""
        out = np.full(len(asked.word), -1, dtype=np.int64)
        number = {w: i + 1 for i, w in enumerate(self.words)}
        there = np.array([0, *(number.get(w, 0) for w in asked.words)], dtype=np.int64)
        width = len(self.words) + 1
        for d in range(1, asked.longest + 1):
            mine, theirs = np.flatnonzero(self.depth == d), np.flatnonzero(asked.depth == d)
            if not len(mine) or not len(theirs):
                break
            parent, asked_parent = np.zeros(len(mine), dtype=np.int64), np.zeros(len(theirs), dtype=np.int64)
            if d > 1:
                parent, asked_parent = self.above(d - 1)[mine], out[asked.above(d - 1)[theirs]]
            keys = parent * width + self.word[mine]
            wanted = asked_parent * width + there[asked.word[theirs]]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = (keys[at] == wanted) & (asked_parent >= 0) & (there[asked.word[theirs]] > 0)
            out[theirs[found]] = mine[at[found]]
        return out

    def packed(self) -> bytes:
        sizes = np.array([len(w) for w in self.words], dtype="<i4")
        head = struct.pack("<qqq", len(self.words), len(self.word), self.longest)
        body = b"".join([head, sizes.tobytes(), *self.words, self.word.astype("<i4").tobytes(), self.depth.astype("i1").tobytes(),
                         self.ends.astype("<i8").tobytes()])
        return struct.pack("<q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, data: bytes) -> CountTransducer:
        body = pa.decompress(data[8:], decompressed_size=struct.unpack("<q", data[:8])[0], codec="zstd", asbytes=True)
        n_words, n_states, longest = struct.unpack_from("<qqq", body)
        sizes = np.frombuffer(body, "<i4", n_words, 24)
        at = 24 + 4 * n_words
        borders = [at, *(at + np.cumsum(sizes)).tolist()]
        words = [body[i:j] for i, j in zip(borders[:-1], borders[1:], strict=True)]
        at = borders[-1]
        word = np.frombuffer(body, "<i4", n_states, at)
        depth = np.frombuffer(body, "i1", n_states, at + 4 * n_states)
        return cls(words, word, depth, np.frombuffer(body, "<i8", n_states, at + 5 * n_states), longest)


def acceptor(paths: Sequence[Path], longest: int) -> tuple[CountTransducer, np.ndarray]:
    """(transducer of the paths, the number of each path's last state); a path may occur more than once."""
    words = sorted({w for p in paths for w in p})
    number = {w: i + 1 for i, w in enumerate(words)}
    rows = np.zeros((len(paths), longest), dtype=np.int32)
    for i, path in enumerate(paths):
        rows[i, :len(path)] = [number[w] for w in path]
    built = CountTransducer.build(words, rows, np.ones(len(paths), dtype=np.int64))
    order = _sorted_rows(rows, len(words))
    new = np.concatenate([[True], (rows[order][1:] != rows[order][:-1]).any(axis=1)]) if len(rows) else np.zeros(0, dtype=bool)
    states = np.zeros(len(paths), dtype=np.int64)
    if len(paths):
        states[order] = np.flatnonzero(built.ends)[np.cumsum(new) - 1]
    return built, states
