"""Word and window hashes inside Python tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Distinct words whose hashes a task remembers; beyond that it starts anew.
REMEMBERED = 400_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0x85EBCA77C2B2AE63], dtype=np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` words; none if there are fewer words."""
    count = len(hashes) - width + 1
    if count <= 0:
        return hashes[:0]
    total = np.zeros(count, dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            factor = factor * _ODD[k % len(_ODD)] + np.uint64(2 * k)
            factor |= np.uint64(1)
            total += hashes[k:k + count] * factor
        return mixed(total)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct window hashes; a shorter text counts as one window of its own length."""
    if not len(hashes):
        return hashes
    if len(hashes) < width:
        with np.errstate(over="ignore"):
            return windows(hashes, len(hashes)) * _ODD[0] + np.uint64(len(hashes))
    return np.unique(windows(hashes, width))


def numbered_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each word, words before each text and in all, words by number): those of `bytes.split()`, each once."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    coded = split.values.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64), []
    whole = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
    words = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_buffer().to_pybytes().split(b"\n")
    number, begins = coded.indices.to_numpy(), split.offsets.to_numpy()
    if b"" in words:  # before the first blank and after the last
        real = number != words.index(b"")
        number, begins = number[real], np.append(0, np.cumsum(real))[begins]
    return number, begins, words


def shingle_sets(texts: Sequence[bytes], width: int, known: WordHashes) -> list[np.ndarray]:
    """`shingles` of each text's words; a word is hashed once for all of them."""
    number, begins, words = numbered_words(texts)
    hashes = known.of(words)[number]
    runs = windows(hashes, width)
    spans = zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)
    return [distinct(runs[a:b - width + 1]) if b - a >= width else shingles(hashes[a:b], width) for a, b in spans]


def distinct(values: np.ndarray) -> np.ndarray:
    """The values sorted, each once."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def filled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches in tables of at least so many bytes, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)
