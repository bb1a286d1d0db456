"""Removal of passages that another document holds, by super-k-mers.

A window is `width` consecutive words. The minimiser of a window is the run of
`mini` words in it with the smallest hash (the first of equals), so equal
windows have equal minimisers. Consecutive windows that share one make a
super-k-mer, which is never longer than two windows less the minimiser.

Only super-k-mers whose minimiser occurs in several documents can hold a
window that does, so one count over all minimisers comes first. The words of
those super-k-mers then travel as one packed string to the bucket of their
minimiser, where the windows of all strings are sorted and equal neighbours
give the smallest document of each window, exactly. The windows of a minimiser
too common for one bucket travel alone, as digests of 128 bits, and are counted
by an aggregate that combines before its shuffle.

Nulls and the like: a null text has no words; a null id counts as larger than
every other; rows of one id never take words from each other. Repeated rows are
judged each for itself. Extra columns are carried along; those named like a
result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import identified
from corpusmill.llm.hashing import WordHashes, binary, windows
from corpusmill.session import spool

WIDTH = 50
MINI = 15
#: Documents with one minimiser above which its windows travel alone.
HOT = 512
RESULTS = ("n_words", "n_removed", "kept_text")

_LAST = (1 << 63) - 1
_PACKED = "mini long, digest binary, rid long, sid long, start int, words binary"
_MARKS = "rid long, start int, n int"


def super_kmers(hashes: np.ndarray, width: int, mini: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of the minimiser) of each super-k-mer of a text."""
    if len(hashes) < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none, hashes[:0]
    runs = windows(hashes, mini)
    at = np.arange(len(hashes) - width + 1) + sliding_window_view(runs, width - mini + 1).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.diff(np.append(first, len(at))), runs[at[first]]


def _minimisers(width: int, mini: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [np.unique(super_kmers(known.of((t or b"").split()), width, mini)[2]) for t in binary(batch.column("text"))]
            rids = np.repeat(batch.column("rid").to_numpy(), [len(f) for f in found])
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(rids)], names=["mini", "rid"])
    return run


def _packed(width: int, mini: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for text, rid, sid, cold, hot in zip(binary(batch.column("text")), batch.column("rid").to_pylist(),
                                                 batch.column("sid").to_pylist(), batch.column("cold").to_pylist(),
                                                 batch.column("hot").to_pylist(), strict=True):
                words = (text or b"").split()
                wanted, alone = set(cold), set(hot)
                for first, n, key in zip(*super_kmers(known.of(words), width, mini), strict=True):
                    key = int(key.view(np.int64))
                    if key in wanted:
                        out.append((key, None, rid, sid, int(first), b" ".join(words[first:first + n + width - 1])))
                    elif key in alone:
                        out += [(None, hashlib.blake2b(b" ".join(words[i:i + width]), digest_size=16).digest(), rid, sid, i, None)
                                for i in range(int(first), int(first + n))]
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                      names=["mini", "digest", "rid", "sid", "start", "words"])


def bucket_marks(rows: list[tuple[bytes, int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """(rid, start, n) of windows that start in a smaller document, from the (words, rid, sid, start) of one bucket."""
    owner: dict[bytes, int] = {}
    for words, _, sid, _ in rows:
        owner[words] = min(sid, owner.get(words, sid))
    cuts: dict[bytes, list[int]] = {}
    firsts: dict[bytes, list[int]] = {}
    if len(owner) > 1:
        entries = []
        for k, (words, sid) in enumerate(owner.items()):
            ends = np.flatnonzero(np.frombuffer(words + b" ", dtype=np.uint8) == 32)
            begins = np.append(0, ends[:-1] + 1)
            spans = zip(begins[:len(begins) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
            entries += [(words[b:e], sid, k, j) for j, (b, e) in enumerate(spans)]
            cuts[words] = firsts[words] = [0] * (len(begins) - width + 1)
        entries.sort()
        strings, last, smallest = list(owner), None, 0
        for window, sid, k, j in entries:
            if window != last:
                last, smallest = window, sid
            firsts[strings[k]][j] = smallest
    marks = []
    for words, rid, sid, start in rows:
        if len(owner) == 1:
            if owner[words] < sid:
                marks.append((rid, start, words.count(b" ") + 2 - width))
            continue
        run = 0
        for j, smallest in enumerate(firsts[words]):
            if smallest < sid:
                run += 1
            elif run:
                marks.append((rid, start + j - run, run))
                run = 0
        if run:
            marks.append((rid, start + len(firsts[words]) - run, run))
    return marks


def _marked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple[bytes, int, int, int]] = []
        at, out = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("mini", "words", "rid", "sid", "start"))
            for key, *row in zip(*columns, strict=True):
                if key != at:
                    out += bucket_marks(bucket, width)
                    at, bucket = key, []
                bucket.append(tuple(row))
            yield _marks(out)
            out = []
        yield _marks(bucket_marks(bucket, width))
    return run


def _marks(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    rid, start, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                                      names=["rid", "start", "n"])


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, start, n in zip(binary(batch.column("text")), batch.column("start").to_pylist(),
                                      batch.column("n").to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if not start:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, np.add(start, n) + width - 1, -1)
                stays = np.cumsum(change[:-1]) == 0
                n_removed.append(int(len(words) - stays.sum()))
                kept.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s]))
            added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())]
            names = ["row", *RESULTS]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *added], names=names)
    return run


def marks(rows: DataFrame, width: int = WIDTH, mini: int = MINI, hot: int = HOT) -> DataFrame:
    """(rid, start, n): runs of windows of a row that start in a document with a smaller id.

    `rows`: (rid, sid, text), rid unique, sid the id that orders the documents.
    """
    minis = rows.select("rid", "text").mapInArrow(_minimisers(width, mini), "mini long, rid long")
    shared = spool(minis.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minimisers")
    flags = minis.join(shared, "mini").groupBy("rid").agg(
        F.collect_list(F.when(F.col("n") <= hot, F.col("mini"))).alias("cold"),
        F.collect_list(F.when(F.col("n") > hot, F.col("mini"))).alias("hot"))
    held = rows.join(flags, "rid").select("rid", "sid", "text", "cold", "hot")
    packed = spool(held.mapInArrow(_packed(width, mini), _PACKED), "superkmers")

    buckets = (packed.where(F.col("words").isNotNull()).select("mini", "words", "rid", "sid", "start")
               .repartition("mini").sortWithinPartitions("mini"))
    cold = buckets.mapInArrow(_marked(width), _MARKS)
    alone = packed.where(F.col("digest").isNotNull()).select("digest", "rid", "sid", "start")
    # Written out, so that the join's sides are plain and a hot window of the other one can be split.
    smallest = spool(alone.groupBy("digest").agg(F.min("sid").alias("first")), "firsts")
    warm = alone.join(smallest, "digest").where("first < sid").select("rid", "start", F.lit(1).alias("n"))
    return cold.union(warm)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   mini: int = MINI, hot: int = HOT) -> DataFrame:
    """The rows with `n_words`, `n_removed` and `kept_text`, the kept words joined by one blank."""
    rows = identified(docs, id_col, text_col)[0].withColumn("sid", F.coalesce("id", F.lit(_LAST)))
    cuts = marks(rows.select("rid", "sid", "text"), width, mini, hot).groupBy("rid").agg(
        F.collect_list("start").alias("start"), F.collect_list("n").alias("n"))
    joined = rows.select("rid", "row", "text").join(cuts, "rid", "left").select("row", "text", "start", "n")
    schema = joined.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    out = joined.mapInArrow(_cut(width), schema)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in RESULTS]
    return out.select(*kept, *RESULTS)
