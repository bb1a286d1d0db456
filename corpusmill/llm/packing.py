"""Packing of tokenised documents into sequences of a fixed length.

What is packed depends on the lengths of the pieces alone, and there are no
more lengths than tokens in a sequence. So the counts of all lengths, a table of
bounded size, come to the driver, which solves the configuration linear program
over them: how often to use each way of filling a sequence. Multiplicative
weights give every length a price that falls as the length gets covered; a
knapsack by dynamic programming finds the best filling at these prices; the
sum is scaled to what is there and rounded, and the program solved again for
what rounding leaves over, a tenth of the pieces in the end. Every piece then finds its sequence from its
number among the pieces of its length, in parallel and without moving its ids.

Nulls and the like: a null or empty text is the end mark alone; ids may be null
or repeated, every row is packed; equal lengths are told apart by their place
in the input. Only the id column is carried along.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import column_or_null
from corpusmill.llm.hashing import binary, filled, numbered_words
from corpusmill.session import spool

SEQUENCE = 2048
END = b"\0\0\0\0"
#: Rounds of the linear program, the part of a length that a filling covers in one, how softly prices fall with
#: coverage, and how near to the best a filling is used.
ROUNDS = 20
STEP = 0.1
SOFT = 4.0
NEAR = 0.001
#: How often the program is solved at most, and the part of the pieces at which it need not be solved again.
PROGRAMS, LEFT_OVER = 12, 0.1
#: Bytes of the words and ids that a worker remembers, bytes of an entry besides, and the longest word that is remembered.
REMEMBERED_BYTES, ENTRY_BYTES, REMEMBERED_LENGTH = 160 << 20, 190, 64
#: Bytes of texts whose words are looked up together, and words that the tokenizer gets at once.
TEXTS_AT_ONCE, ENCODED_AT_ONCE = 4 << 20, 10_000

#: ASCII marks other than the apostrophe: after letters they are a word of their own to the tokenizer.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: (length, times in it) of each piece of a sequence; and how often each filling is used.
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]


def _letters(word: bytes) -> bool:
    """Whether the tokenizer, which composes marks and lower-cases, sees letters alone."""
    if word.isascii():
        return word.isalpha()
    return unicodedata.normalize("NFC", word.decode("utf-8", "replace")).lower().isalpha()


class WordIds:
    """Ids of texts, word by word: the tokenizer drops blanks and never looks across them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() if self.suffix else 0, dtype=bool)
        if self.suffix:
            self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(self.suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def of(self, texts: Sequence[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a word is looked up once for all of them."""
        if self.size > REMEMBERED_BYTES // 2:  # what is not met again until the next time is forgotten
            self.known, self.older, self.size = {}, self.known, 0
        # Small letters share what is known of words, but the marks that the tokenizer composes are not to be touched.
        marked = [b"<|" in t for t in texts]
        if not any(marked):
            return self._of(texts, True)
        plain = iter(self._of([t for t, m in zip(texts, marked, strict=True) if not m], True))
        other = iter(self._of([t for t, m in zip(texts, marked, strict=True) if m], False))
        return [next(other if m else plain) for m in marked]

    def _of(self, texts: Sequence[bytes], lower: bool) -> list[bytes]:
        number, begins, words = numbered_words(texts)
        if not len(number):
            return [b""] * len(texts)
        if lower:
            words = [w.lower() if w.isascii() else w for w in words]
        ids = list(map(self.known.get, words))
        if None in ids:
            once = self._learn({w for w, found in zip(words, ids, strict=True) if found is None and w})
            once[b""] = b""  # what is no word
            ids = [once[w] if found is None else found for w, found in zip(words, ids, strict=True)]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
        starts = np.cumsum(lengths) - lengths
        taken = lengths[number]
        ends = np.cumsum(taken)
        # The ids of a word follow one another in `flat`.
        out = flat[np.arange(ends[-1]) + np.repeat(starts[number] + taken - ends, taken)].tobytes()
        cuts = (4 * np.append(0, ends)[begins]).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words; those of short words are remembered."""
        stems, simple = {}, set()
        for word in words:
            stem = word.rstrip(MARKS)
            if stem and len(stem) < len(word) and _letters(stem):
                stems[word] = stem
                simple.update((stem, word[len(stem):]))
            else:
                simple.add(word)
        once = {w: ids for w in simple if (ids := self.known.get(w, self.older.get(w))) is not None}
        if len(once) < len(simple):
            self._encode([w for w in simple if w not in once], once)
        for word, stem in stems.items():
            once[word] = once[stem] + once[word[len(stem):]]
        for word, ids in once.items():
            if len(word) <= REMEMBERED_LENGTH and word not in self.known:
                self.known[word] = ids
                self.size += ENTRY_BYTES + len(word) + len(ids)
        return once

    def _encode(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        """Ids of words not known yet; those of letters alone end where a token does that ends a word."""
        letters = list(filter(_letters, words)) if self.suffix else []
        for at in range(0, len(letters), ENCODED_AT_ONCE):
            some = letters[at:at + ENCODED_AT_ONCE]
            text = b" ".join(some).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):  # not cut at blanks alone
                self._encode_by_place(some, into)
                continue
            self._cut(some, ids, [0, *cuts.tolist()], into)
        rest = [w for w in words if w not in into]
        if rest:
            self._encode_by_place(rest, into)

    def _encode_by_place(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(encoded.ids, dtype="<u4")
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts = np.fromiter((o[0] for o in encoded.offsets), dtype=np.int64, count=len(ids))
        self._cut(words, ids, np.searchsorted(starts, begins, "left").tolist(), into)

    @staticmethod
    def _cut(words: list[bytes], ids: np.ndarray, cuts: list[int], into: dict[bytes, bytes]) -> None:
        data = ids.tobytes()
        for word, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            into[word] = data[4 * a:4 * b]


def worker_words(path: str) -> WordIds:
    """The words of this worker process, which Spark keeps for further tasks: a word is learnt once for all of them.

    Functions come to a worker anew with each task, so what outlasts them is kept by the interpreter's own module.
    """
    held = sys.__dict__.setdefault("_corpusmill_words", {})
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def _pieces(path: str | None, sequence: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = worker_words(path or public_tokenizers.path("word_bpe_49k.json"))
        seen = np.zeros(sequence + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for table in filled(batches, TEXTS_AT_ONCE):
            rows, out, ids = [], [], []
            for i, data in enumerate(words.of([t or b"" for t in binary(table.column("text"))])):
                data = memoryview(data + END)
                for k, at in enumerate(range(0, len(data), 4 * sequence)):
                    piece = data[at:at + 4 * sequence]
                    length = len(piece) // 4
                    rows.append(i)
                    out.append((k, at // 4, length, zlib.crc32(piece), seen[length]))
                    ids.append(bytes(piece) if with_ids else None)
                    seen[length] += 1
            piece, start, length, crc, rank = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [table.column("id").take(pa.array(rows, pa.int64())).combine_chunks(),
                 pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"])
    return run


def best_values(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack by room: (highest price that fits, length to take first or 0); lengths may repeat."""
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(prices)
    gains = prices[lengths]
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fit = int(np.searchsorted(lengths, room, "right"))
        if fit:
            total = value[room - lengths[:fit]] + gains[:fit]
            best = fit - 1 - int(total[::-1].argmax())  # the longest of equals
            if total[best] > value[room]:
                value[room], choice[room] = total[best], lengths[best]
    return value, choice


def _filling(first: int, choice: np.ndarray, counts: np.ndarray, capacity: int) -> Filling:
    """The best filling that holds a piece of length `first`, no length more often than it occurs."""
    used = {first: 1}
    room = capacity - first
    while room > 0:
        length = int(choice[room])
        if length and used.get(length, 0) < counts[length]:
            used[length] = used.get(length, 0) + 1
            room -= length
        else:  # used up in this filling: what fits into a little less room
            room -= 1
    return tuple(sorted(used.items()))


def linear_program(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[Filling, float], float]:
    """(filling -> times, lower bound of the sequences): a nearly best fractional use of fillings.

    One knapsack prices a round; of the best fillings for each length, those
    within `NEAR` of the best of all are used. A price starts at the length
    itself, at which every gapless filling is best.
    """
    lengths = np.flatnonzero(counts)
    wanted = counts[lengths].astype(np.float64)
    covered = np.zeros(len(counts))
    used: dict[Filling, float] = {}
    bound = 0.0
    for _ in range(rounds):
        prices = np.zeros(len(counts))
        prices[lengths] = lengths * np.exp(-(covered[lengths] - covered[lengths].min()) / SOFT)
        value, choice = best_values(prices, capacity)
        bound = max(bound, float((prices[lengths] * wanted).sum() / value[capacity]))
        worth = prices[lengths] + value[capacity - lengths]
        for length in lengths[worth >= (1 - NEAR) * value[capacity]]:
            filling = _filling(int(length), choice, counts, capacity)
            times = STEP * min(counts[k] / n for k, n in filling)
            used[filling] = used.get(filling, 0.0) + times
            for k, n in filling:
                covered[k] += times * n / counts[k]
    scale = float(np.mean(covered[lengths])) if len(lengths) else 1.0
    return {k: v / scale for k, v in used.items()}, bound


def fill_rest(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit, largest piece first, as often as the counts allow each filling."""
    left = counts.copy()
    plan = []
    while left.any():
        filling, room = {}, capacity
        there = np.flatnonzero(left)
        while room > 0:
            fit = int(np.searchsorted(there, room, "right")) - 1
            while fit >= 0 and left[there[fit]] <= filling.get(int(there[fit]), 0):
                fit -= 1
            if fit < 0:
                break
            length = int(there[fit])
            filling[length] = filling.get(length, 0) + 1
            room -= length
        times = min(int(left[k]) // n for k, n in filling.items())
        for k, n in filling.items():
            left[k] -= times * n
        plan.append((tuple(sorted(filling.items())), times))
    return plan


def rounded(fractions: dict[Filling, float], left: np.ndarray) -> Plan:
    """Whole times of the fillings, along the running sum of their fractions, so that many small ones give their share
    of whole sequences; never more than `left` holds, from which they are taken."""
    plan: Plan = []
    run = 0.0
    for filling, times in sorted(fractions.items(), key=lambda x: -x[0][-1][0]):
        whole = min(int(run + times) - int(run), *(int(left[k]) // n for k, n in filling))
        run += times
        if whole:
            plan.append((filling, whole))
            for k, n in filling:
                left[k] -= whole * n
    return plan


def programmed(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Iterator[tuple[Plan, np.ndarray, float]]:
    """(plan, what is left, lower bound of the sequences) after each program: it is solved and rounded, then solved again
    with new prices for what rounding left over, until a tenth of the pieces is left at most."""
    left = counts.copy()
    plan: Plan = []
    bound = 0.0
    for solved in range(PROGRAMS):
        if left.sum() <= LEFT_OVER * counts.sum():
            break
        fractions, lower = linear_program(left, capacity, rounds)
        bound = bound if solved else lower
        found = rounded(fractions, left)
        plan = plan + found
        yield plan, left.copy(), bound
        if not found:
            break


def packing_plan(counts: np.ndarray, capacity: int = SEQUENCE, rounds: int = ROUNDS) -> tuple[Plan, float]:
    """((filling, times) using up all counts exactly, lower bound of the number of sequences).

    What a program leaves over can be filled best-fit at any stage; that stage counts which needs the fewest
    sequences, of equals the last.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    full, left[capacity] = int(left[capacity]), 0
    first: Plan = [(((capacity, 1),), full)] if full else []
    best, bound = fill_rest(left, capacity), 0.0
    for plan, rest, bound in programmed(left, capacity, rounds):
        whole = plan + fill_rest(rest, capacity)
        if sum(t for _, t in whole) <= sum(t for _, t in best):
            best = whole
    return first + best, full + bound


def _slots(plan: Plan) -> np.ndarray:
    """Rows (length, first number, of how many, first sequence, first offset), sorted."""
    rows, at, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for length, n in filling:
            rows.append((length, at.get(length, 0), n, sequence, offset))
            at[length] = at.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _placed(slots: np.ndarray):
    keys = (slots[:, 0] << 44) + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = slots[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(length) else slots[:0]
            place = rank - row[:, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(row[:, 3] + place // np.maximum(row[:, 2], 1)),
                 pa.array(row[:, 4] + place % np.maximum(row[:, 2], 1) * length)], names=[*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
         tokenizer: str | None = None, with_ids: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset and, if wished, ids: 32-bit little-endian)."""
    kind = docs.schema[id_col].dataType.simpleString()
    light = docs.select(F.col(f"`{id_col}`").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    pieces = spool(light.mapInArrow(
        _pieces(tokenizer, sequence, with_ids),
        f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"), "pieces")
    of_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = spool(of_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")

    counts = np.zeros(sequence + 1, dtype=np.int64)
    for length, n in of_part.groupBy("length").agg(F.sum("n")).collect():  # a record for each length
        counts[length] = n
    slots = _slots(packing_plan(counts, sequence, rounds)[0])
    carried = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(of_part, ["part", "length"]).select(*carried, (F.col("rank") + F.col("base")).alias("rank"))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    out = ranked.mapInArrow(_placed(slots), schema)
    return out.withColumnRenamed("id", id_col)
