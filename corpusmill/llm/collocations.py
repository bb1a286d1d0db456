"""Phrases whose words stand together more often than their parts do, by language.

All n-grams are counted, over whole texts, by weighted acyclic automata
(`transducers`). A task cuts its texts into pieces and words and builds, for a
bounded number of words at a time, a transducer of the windows that begin at each
word: a window holds the words that follow up to the longest phrase, so its
prefixes are all phrases that begin there. Windows end early at words, and
at pairs of words, that do not occur often enough: two bit maps of fixed size,
made from exact counts of the words and counts of hashed pairs over the whole
corpus, tell them, and at worst let some pass that are rare. The transducers are cut
at common splitters into ranges of prefixes; each range is united in a task of
its own, which adds the weights up. A prefix that reaches over a range's ends is
given by all of its ranges and added up afterwards, so a frequent first word takes
as many tasks as its windows need.

Parts are looked up by composing the automaton of the asked parts of a range
with that of the counts of this range; ranges are cut by part and phrase, so the
many phrases that ask for one frequent word are dealt out, too.

Nulls and the like: a null text is an empty one, a null language is `und`; equal
texts count each time; other columns are not looked at. A table without words
gives no rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import column_or_null
from corpusmill.llm.hashing import _ODD, binary, mixed
from corpusmill.llm.transducers import CountTransducer, Path, acceptor
from corpusmill.session import spool

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words and bytes of text that a task works on at once.
AT_ONCE, BYTES_AT_ONCE = 1_500_000, 12 << 20
#: Bits of each of the two maps: 8 MB, whatever the corpus.
BITS = 1 << 26
#: Windows and look-ups of a range, sampled keys for each range, sampled keys that a transducer gives.
WINDOWS_PER_RANGE, ASKED_PER_RANGE, SAMPLES_PER_RANGE, SAMPLES = 1_000_000, 500_000, 16, 64

#: Marks between pieces become a word of their own, which no word can equal; blanks are space and tab.
_MARK = b"."
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")


@dataclass
class Chunk:
    """Words of some texts: `ids` numbers them, 0 ends a piece; a word of another language has another number."""
    ids: np.ndarray
    words: list[bytes]
    langs: list[bytes]


class _Numbers(dict):
    def __init__(self, lang: bytes, chunk: Chunk):
        super().__init__({_MARK: 0})
        self.lang, self.chunk = lang, chunk

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.chunk.words)
        self.chunk.words.append(word)
        self.chunk.langs.append(self.lang)
        return number


def words_of(text: bytes) -> list[bytes]:
    """The words, and a mark between two pieces."""
    return text.lower().translate(_MARKS).replace(_MARK, b" . ").split(b" ")


def chunks(batches: Iterator[pa.RecordBatch], least: int = AT_ONCE) -> Iterator[Chunk]:
    chunk, of_lang, ids, size = Chunk(np.zeros(0), [_MARK], [b""]), {}, [0], 0

    def whole() -> Chunk:
        chunk.ids = np.array(ids, dtype=np.int32)
        return chunk

    for batch in batches:
        for lang, text in zip(binary(batch.column("lang")), binary(batch.column("text")), strict=True):
            numbers = of_lang.get(lang)
            if numbers is None:
                numbers = of_lang[lang] = _Numbers(lang, chunk)
            ids += [numbers[w] for w in words_of(text) if w]
            ids.append(0)
            size += len(text)
            if len(ids) > least or size > BYTES_AT_ONCE:
                yield whole()
                chunk, of_lang, ids, size = Chunk(np.zeros(0), [_MARK], [b""]), {}, [0], 0
    yield whole()


def word_hashes(chunk: Chunk) -> np.ndarray:
    seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in set(chunk.langs)}
    hashed = (xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in zip(chunk.words, chunk.langs, strict=True))
    return np.fromiter(hashed, dtype=np.uint64, count=len(chunk.words))


class Bits:
    """A set of hashes by one bit each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.astype(np.int64) % BITS  # as pmod of the signed number
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0

    @staticmethod
    def of(hashes: DataFrame) -> np.ndarray:
        """The bits for a column `hash`: parts of 4 KB, as many as `BITS` allows."""
        place = F.pmod("hash", F.lit(BITS)) + 1
        parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)))
        bits = np.zeros(BITS // 8, dtype=np.uint8)
        for at, part in parts.collect():
            begin = (at - 1) * 4096
            bits[begin:begin + len(part)] = np.frombuffer(part, dtype=np.uint8)
        return bits


def _pairs(chunk: Chunk, hashes: np.ndarray, words: Bits) -> tuple[np.ndarray, np.ndarray]:
    """(places of words that form a pair of frequent words with the next one, hashes of these pairs)."""
    frequent = words.has(hashes)
    frequent[0] = False
    there = frequent[chunk.ids]
    at = np.flatnonzero(there[:-1] & there[1:])
    with np.errstate(over="ignore"):
        return at, mixed(hashes[chunk.ids[at]] * _ODD[0] + hashes[chunk.ids[at + 1]] * _ODD[1])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        counts = np.bincount(chunk.ids, minlength=len(chunk.words))[1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.langs[1:], pa.binary()).cast(pa.string()), pa.array(chunk.words[1:], pa.binary()).cast(pa.string()),
             pa.array(word_hashes(chunk)[1:].view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "hash", "n"])


def _pair_counts(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found, counts = np.unique(_pairs(chunk, word_hashes(chunk), Bits(words.value))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "n"])
    return run


def windows(chunk: Chunk, words: Bits, pairs: Bits, longest: int) -> CountTransducer:
    """The transducer of the windows of a chunk; the first word of a path is the language."""
    at, hashed = _pairs(chunk, word_hashes(chunk), words)
    at = at[pairs.has(hashed)]
    goes_on = np.zeros(len(chunk.ids) + 1, dtype=bool)
    goes_on[at] = True
    stop = np.where(goes_on, len(goes_on), np.arange(len(goes_on)))
    stop = np.minimum.accumulate(stop[::-1])[::-1]  # the next place from which no frequent pair goes on
    length = np.minimum(stop[at] - at + 1, longest)
    used = np.unique(chunk.ids[at + np.minimum(np.arange(longest)[:, None], length - 1)]) if len(at) else at
    names = sorted({chunk.words[i] for i in used.tolist()}.union(chunk.langs[i] for i in used.tolist()))
    number = {w: i + 1 for i, w in enumerate(names)}
    of_word, of_lang = np.zeros(len(chunk.words), dtype=np.int32), np.zeros(len(chunk.words), dtype=np.int32)
    for i in used.tolist():
        of_word[i], of_lang[i] = number[chunk.words[i]], number[chunk.langs[i]]
    rows = np.zeros((len(at), longest + 1), dtype=np.int32)
    rows[:, 0] = of_lang[chunk.ids[at]]
    for k in range(longest):
        inside = k < length
        rows[inside, k + 1] = of_word[chunk.ids[at[inside] + k]]
    return CountTransducer.build(names, rows, np.ones(len(at), dtype=np.int64))


def _key(path: Path) -> bytes:
    return b"".join(w + b"\n" for w in path)


def _transducers(words, pairs, longest: int):
    """(transducer, n-grams in it, some of its paths with a hash each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = windows(chunk, Bits(words.value), Bits(pairs.value), longest)
            ends = np.flatnonzero(found.ends)
            lots = mixed(found.paths(ends).astype(np.uint64) @ _ODD[np.arange(longest + 1) % len(_ODD)]) if len(ends) else np.zeros(0)
            some = ends[np.argsort(lots, kind="stable")[:SAMPLES]]
            paths = [list(p) for p in found.named(some)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([found.packed()], pa.binary()), pa.array([len(ends)], pa.int64()), pa.array([paths], pa.list_(pa.list_(pa.binary())))],
                names=["transducer", "n", "some"])
    return run


def _splitters(sample: DataFrame, n_ranges: int) -> list[Path]:
    """Sorted splitters from a column `path`: a bounded part of the sample, quantiles of which begin the ranges."""
    if n_ranges <= 1:
        return []
    total = sample.count()
    share = min(1.0, n_ranges * SAMPLES_PER_RANGE / max(total, 1))
    lot = F.pmod(F.xxhash64("path", "salt"), F.lit(1 << 30)) / (1 << 30)
    found = sorted(tuple(map(bytes, r["path"])) for r in sample.where(lot < share).select("path").collect())
    return sorted({found[len(found) * k // n_ranges] for k in range(1, n_ranges)}) if found else []


def _cut(splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("transducer").to_pylist():
                parts = CountTransducer.unpacked(data).cut(splitters.value)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p.packed() for _, p in parts], pa.binary())],
                                                 names=["range", "transducer"])
    return run


def _united(splitters, longest: int, least: int):
    """Phrases of a range that are frequent in it, or that reach over its ends."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        whole = CountTransducer.union((CountTransducer.unpacked(d) for d in table.column("transducer").to_pylist()), longest + 1)
        weights = whole.weights()
        given = weights >= least
        words = {w: i + 1 for i, w in enumerate(whole.words)}
        rows = whole.paths()
        for path in splitters.value[max(number - 1, 0):number + 1]:
            on = np.ones(len(rows), dtype=bool)
            for d, word in enumerate(path):  # the states on the way to a splitter
                on &= rows[:, d] == words.get(word, -1)
                given |= on & (whole.depth == d + 1)
        states = np.flatnonzero(given & (whole.depth > 2))
        paths = whole.named(states)
        return pa.table([pa.array([p[0] for p in paths], pa.binary()).cast(pa.string()),
                         pa.array([b" ".join(p[1:]) for p in paths], pa.binary()).cast(pa.string()), pa.array(weights[states])],
                        names=["lang", "phrase", "n"])
    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a) of the phrases of 1 to `longest` words counted `least` times or more, (lang, n): words in all)."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(column_or_null(docs, lang_col, "string"), F.lit("und")).alias("lang"),
                        F.coalesce(column_or_null(docs, text_col, "string"), F.lit("")).alias("text"))
    counted = spool(texts.mapInArrow(_word_counts, "lang string, phrase string, hash long, n long")
                    .groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n")), "words")
    langs = spool(counted.groupBy("lang").agg(F.sum("n").alias("n")), "langs")
    frequent = counted.where(F.col("n") >= least)
    words = context.broadcast(Bits.of(frequent))
    hashed = texts.mapInArrow(_pair_counts(words), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    pairs = context.broadcast(Bits.of(hashed.where(F.col("n") >= least)))

    shards = spool(texts.mapInArrow(_transducers(words, pairs, longest), "transducer binary, n long, some array<array<binary>>"), "transducers")
    n_windows = shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sample = shards.select(F.posexplode("some").alias("salt", "path"))
    splitters = context.broadcast(_splitters(sample, math.ceil(n_windows / WINDOWS_PER_RANGE)))
    parts = shards.select("transducer").mapInArrow(_cut(splitters), "range int, transducer binary")
    found = parts.groupBy("range").applyInArrow(_united(splitters, longest, least), "lang string, phrase string, n long")
    phrases = found.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return spool(phrases.unionByName(frequent.select("lang", "phrase", F.col("n").alias("a"))), "phrases"), langs


def _dealt(splitters):
    """Adds the ranges of each row: one for a question, all that may ask for it for a count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders: Sequence[Path] = splitters.value
        for batch in batches:
            rows, ranges = [], []
            columns = (binary(batch.column(c)) for c in ("lang", "part", "phrase"))
            for i, (lang, part, phrase) in enumerate(zip(*columns, strict=True)):
                if phrase is not None:
                    rows.append(i)
                    ranges.append(bisect.bisect_right(borders, (lang, part, phrase)))
                else:
                    first = bisect.bisect_right(borders, (lang, part, b""))
                    last = bisect.bisect_left(borders, (lang, part + b"\0"), lo=first)
                    rows += [i] * (last - first + 1)
                    ranges += range(first, last + 1)
            chosen = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(ranges, pa.int32())], names=[*batch.schema.names, "range"])
    return run


def _composed(longest: int):
    def run(table: pa.Table) -> pa.Table:
        counts = table.filter(table.column("phrase").is_null())
        asked = table.filter(table.column("phrase").is_valid())

        def paths(rows: pa.Table) -> list[Path]:
            both = zip(binary(rows.column("lang")), binary(rows.column("part")), strict=True)
            return [(lang, *part.split(b" ")) for lang, part in both]

        known, at = acceptor(paths(counts), longest + 1)
        values = np.zeros(len(known.word) + 1, dtype=np.int64)
        values[at] = counts.column("a").to_numpy()
        wanted, states = acceptor(paths(asked), longest + 1)
        reached = known.composed(wanted)[states] if len(states) else states
        # What is not reached is -1 and takes the last value, 0.
        return asked.drop_columns(["range"]).append_column("value", pa.array(values[reached]))
    return run


def part_counts(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, m, k, side, part, value): of each phrase of two words or more all cuts and the counts of both parts."""
    context = phrases.sparkSession.sparkContext
    words = F.split("phrase", " ")
    several = phrases.withColumn("w", words).withColumn("m", F.size("w")).where(F.col("m") > 1)
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
                    F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m")), " ").alias("part")))
    asked = cuts.select("lang", "phrase", "a", "m", "k", F.inline(sides)).select("lang", "part", "phrase", "a", "m", "k", "side")
    n_asked = several.agg(F.coalesce(F.sum(2 * (F.col("m") - 1)), F.lit(0))).first()[0]
    sample = asked.select(F.array(*[F.col(c).cast("binary") for c in ("lang", "part", "phrase")]).alias("path"), F.concat("side", "k").alias("salt"))
    splitters = context.broadcast(_splitters(sample, math.ceil(n_asked / ASKED_PER_RANGE)))
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.lit(None).cast("string").alias("phrase"), "a",
                            F.lit(0).alias("m"), F.lit(0).alias("k"), F.lit("").alias("side"))
    schema = "lang string, part string, phrase string, a long, m int, k int, side string"
    dealt = asked.unionByName(counts).mapInArrow(_dealt(splitters), schema + ", range int")
    return dealt.groupBy("range").applyInArrow(_composed(longest), schema + ", value long")


def with_score(cuts: DataFrame) -> DataFrame:
    """floor(1000 a n / (l r)) in whole numbers of 38 digits, so that neither product rounds."""
    return cuts.withColumn("score", F.expr("(1000 * cast(a as decimal(38,0)) * cast(n as decimal(38,0)))"
                                           " div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by their lowest-scoring cut."""
    phrases, langs = phrase_counts(docs, text_col, lang_col, least, longest)
    parts = spool(part_counts(phrases, longest), "parts")
    # A phrase goes where a phrase longer by one word is as frequent: any longer one then has one between them.
    outer = ((F.col("side") == "l") & (F.col("k") == F.col("m") - 1)) | ((F.col("side") == "r") & (F.col("k") == 1))
    inside = parts.where(outer & (F.col("value") == F.col("a"))).select("lang", F.col("part").alias("phrase")).distinct()
    value = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
    cuts = parts.groupBy("lang", "phrase", "a", "k").agg(value("l").alias("l"), value("r").alias("r")).join(langs, "lang")
    best = with_score(cuts).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = best.join(inside, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
SQL = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
          FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.m, c.phrase, c.a, k.k, array_to_string(string_split(c.phrase, ' ')[1:k.k], ' ') AS first,
                array_to_string(string_split(c.phrase, ' ')[k.k + 1:], ' ') AS rest
         FROM counts c, (SELECT unnest([1, 2, 3, 4]) AS k) k WHERE k.k < c.m),
scored AS (SELECT x.lang, x.m, x.phrase, x.a, x.k, f.a AS l, r.a AS r, t.n,
                  CAST(CAST(1000 AS HUGEINT) * x.a * t.n // (CAST(f.a AS HUGEINT) * r.a) AS BIGINT) AS score
           FROM cuts x JOIN counts f ON f.lang = x.lang AND f.phrase = x.first JOIN counts r ON r.lang = x.lang AND r.phrase = x.rest
           JOIN total t ON t.lang = x.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best b
WHERE NOT EXISTS (SELECT 1 FROM counts o WHERE o.lang = b.lang AND o.m > b.m AND 100 * o.a >= 100 * b.a
                  AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
QUALIFY rank <= 2000"""
