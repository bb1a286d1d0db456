"""Log probabilities of texts under a hidden Markov language model.

A text is its words, ASCII letters lower-cased, and one end mark. Hidden states
follow one another by a transition table, and each state emits tokens. The
most frequent words are emitted as themselves; every other word belongs to a
class by its last bytes, the state emits the class, and the class the word
by its share of the class's training tokens, with half a token added for each
known word and for all unknown ones together. So what the states hold is
bounded by parameters, while the counts of words grow with the corpus and stay
in tables.

Training is Baum-Welch over all training texts: in each round every partition
runs the scaled forward and backward recursions over its texts and adds up the
expected counts of emissions and transitions; their sums over the partitions,
one row for each class, give the next model. Long texts are cut into blocks whose
transfer matrices are multiplied up to the exact distribution at each block's
ends, so the likelihood is that of the whole sequence, many texts advance one
step at a time together, and memory is bounded by blocks.

A text is held out of training where the CRC-32 of its id, as text, leaves 1
modulo 5. For comparison every text also gets `base_score`, that of single
tokens with half a token added to each count.

Nulls and the like: a null text is an empty one, the end mark alone; a null id is
not held out; equal rows are scored alike, each its own. Without any training text
all words are unknown. Input columns but the text are carried along; those named
like a result column are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import column_or_null, fields, unpacked
from corpusmill.llm.hashing import binary
from corpusmill.session import spool

#: Words emitted as themselves (no longer than `LONGEST` bytes), classes of all others, bytes that choose the class.
COMMON, CLASSES, LONGEST, LAST = 60_000, 4_096, 64, 3
STATES, ROUNDS = 8, 4
#: Tokens of the overall distribution mixed into each state's emissions, transitions added to each pair of states.
MIXED, ADDED = 200.0, 1.0
#: Tokens of a block, and of the blocks that are worked on together.
BLOCK, GROUP = 2_048, 1_000_000
#: Bytes of words that a task counts before it passes the counts on.
COUNTED_BYTES = 32 << 20

RESULTS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def class_of(word: bytes) -> int:
    """Class of a word that is not emitted as itself."""
    return zlib.crc32(word[-LAST:]) % CLASSES


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


@dataclass
class Model:
    """start[s], move[s, t] and emit[symbol, s]; symbols: the end mark, common words, classes."""
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


@dataclass
class Expected:
    """Expected counts of a training pass."""
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def none(cls, symbols: int, states: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


class Blocks:
    """Blocks of several texts laid out place by place: the first tokens of all, then the second ones; longest first."""

    def __init__(self, model: Model, parts: list[np.ndarray]):
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # blocks longer than t, for each t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.concatenate([parts[i] for i in self.order])
        self.block = np.concatenate([np.arange(a) for a in self.active])
        self.symbols = flat[begins[self.block] + np.repeat(np.arange(len(self.active)), self.active)]
        self.emit = model.emit.T.take(self.symbols, axis=1)  # a row for each state

    def places(self) -> Iterator[tuple[int, int, int]]:
        """(t, first and last column of the t-th tokens)."""
        return zip(range(len(self.active)), self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)


def transfers(model: Model, parts: list[np.ndarray]) -> np.ndarray:
    """[block, state before, state of the last token]: transfer matrices of blocks of one length, tokens included, scaled."""
    n, k = len(parts), len(model.start)
    emit = model.emit.T.take(np.stack(parts, axis=1), axis=1)  # state, place, block
    m = np.eye(k)[:, :, None] * emit[:, 0, :][:, None, :]  # state, state before, block
    onward = np.ascontiguousarray(model.move.T)
    for t in range(1, emit.shape[1]):
        m = (onward @ m.reshape(k, k * n)).reshape(k, k, n) * emit[:, t, :][:, None, :]
        if t % 8 == 0 or t == emit.shape[1] - 1:
            m /= m.max(axis=(0, 1))
    return m.transpose(2, 1, 0)


def grouped_parts(parts: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """Numbers of consecutive parts of at most so many tokens together, one part at least."""
    held: list[int] = []
    n = 0
    for i, part in enumerate(parts):
        if held and n + len(part) > most:
            yield held
            held, n = [], 0
        held.append(i)
        n += len(part)
    if held:
        yield held


def forward(model: Model, blocks: Blocks, before: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of each block's probability by the scaled forward recursion; `kept` receives all distributions."""
    onward = np.ascontiguousarray(model.move.T)
    norms = np.empty(len(blocks.symbols))
    state = np.ascontiguousarray(before)
    for t, i, j in blocks.places():
        state = (onward @ state[:, :j - i] if t else state) * blocks.emit[:, i:j]
        norm = norms[i:j] = state.sum(axis=0)
        state /= norm
        if kept is not None:
            kept[:, i:j] = state
    return np.bincount(blocks.block, np.log(norms), minlength=before.shape[1])


def count(model: Model, parts: list[np.ndarray], before: np.ndarray, last: np.ndarray, after: np.ndarray, into: Expected) -> np.ndarray:
    """Add the expected counts of blocks; gives how likely each whole block is from each state before it, scaled.

    One column for each block: `before` the distribution of its first state, `last` that of the state of the token before
    (nan at the begin of a text), `after` how likely what follows is from each state of its last token.
    """
    blocks = Blocks(model, parts)
    before, last, after = before[:, blocks.order], last[:, blocks.order], after[:, blocks.order].copy()
    kept = np.empty_like(blocks.emit)
    forward(model, blocks, before, kept)
    first = np.isnan(last[0])
    back = after
    for t, i, j in reversed(list(blocks.places())):
        a = j - i
        shared = kept[:, i:j] * after[:, :a]
        kept[:, i:j] = shared / shared.sum(axis=0)
        here = blocks.emit[:, i:j] * after[:, :a]
        back = model.move @ here
        if t:
            earlier = kept[:, blocks.at[t - 1]:blocks.at[t - 1] + a]
            into.move += (earlier / (earlier * back).sum(axis=0)) @ here.T
            after[:, :a] = back / back.sum(axis=0)
        else:
            into.start += kept[:, i:j][:, first].sum(axis=1)
            earlier = last[:, ~first]
            into.move += (earlier / (earlier * back[:, ~first]).sum(axis=0)) @ here[:, ~first].T
    for s, row in enumerate(kept):
        into.emit[:, s] += np.bincount(blocks.symbols, row, minlength=len(into.emit))
    out = np.empty_like(back)
    out[:, blocks.order] = back / back.sum(axis=0)
    return out


class Chained:
    """Texts as whole blocks and one last block each, with what every block needs of those before it."""

    def __init__(self, model: Model, texts: list[np.ndarray]):
        self.model = model
        self.tails = [t[(len(t) - 1) // BLOCK * BLOCK:] for t in texts]
        self.heads = [[t[i:i + BLOCK] for i in range(0, (len(t) - 1) // BLOCK * BLOCK, BLOCK)] for t in texts]
        flat = [h for heads in self.heads for h in heads]
        self.matrices = np.concatenate([transfers(model, [flat[i] for i in some]) for some in grouped_parts(flat, GROUP)]) \
            if flat else np.zeros((0, 0, 0))
        none = np.full(len(model.start), np.nan)
        columns: list[tuple[np.ndarray, np.ndarray]] = []  # (before, last) of the whole blocks
        tails = []
        for heads in self.heads:
            before, last = model.start, none
            for _ in heads:
                reached = before @ self.matrices[len(columns)]
                columns.append((before, last))
                last = reached / reached.sum()
                before = last @ model.move
            tails.append((before, last))
        self.of_tails = tuple(np.array([x[k] for x in tails]).T for k in (0, 1))
        self.of_heads = tuple(np.array([x[k] for x in columns]).T for k in (0, 1))

    def log_probabilities(self) -> np.ndarray:
        def scored(parts: list[np.ndarray], before: np.ndarray) -> np.ndarray:
            out = np.empty(len(parts))
            for some in grouped_parts(parts, GROUP):
                blocks = Blocks(self.model, [parts[i] for i in some])
                at = np.array(some)[blocks.order]
                out[at] = forward(self.model, blocks, before[:, at])
            return out

        total = scored(self.tails, self.of_tails[0])
        flat = [h for heads in self.heads for h in heads]
        if flat:
            owner = np.repeat(np.arange(len(self.heads)), [len(h) for h in self.heads])
            total += np.bincount(owner, scored(flat, self.of_heads[0]), minlength=len(total))
        return total

    def count(self, into: Expected) -> None:
        def counted(parts: list[np.ndarray], ends: tuple[np.ndarray, np.ndarray], after: np.ndarray) -> np.ndarray:
            return np.concatenate([count(self.model, [parts[i] for i in some], ends[0][:, some], ends[1][:, some], after[:, some], into)
                                   for some in grouped_parts(parts, GROUP)], axis=1)

        begins = counted(self.tails, self.of_tails, np.ones_like(self.of_tails[0]))
        flat = [h for heads in self.heads for h in heads]
        if not flat:
            return
        after = np.empty((len(begins), len(flat)))
        at = 0
        for text, heads in enumerate(self.heads):
            likely = begins[:, text]
            for i in range(at + len(heads) - 1, at - 1, -1):
                after[:, i] = likely
                likely = self.model.move @ (self.matrices[i] @ likely)
                likely /= likely.sum()
            at += len(heads)
        counted(flat, self.of_heads, after)


def count_texts(model: Model, texts: list[np.ndarray], into: Expected) -> None:
    """Add the expected counts of whole texts; those of transitions are still to be multiplied by `move`."""
    if texts:
        Chained(model, texts).count(into)


def log_probabilities(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each whole text."""
    return Chained(model, texts).log_probabilities() if texts else np.zeros(0)


def first_model(tokens: np.ndarray, states: int) -> Model:
    """States that stay, each with the overall emissions disturbed in its own, fixed way."""
    overall = (tokens + 0.5) / (tokens + 0.5).sum()
    lots = np.random.default_rng(1).normal(0.0, 0.5, (len(tokens), states))
    emit = overall[:, None] * np.exp(lots)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def next_model(model: Model, found: Expected, tokens: np.ndarray) -> Model:
    """The model that the expected counts make likeliest, smoothed by the overall distribution."""
    overall = (tokens + 0.5) / (tokens + 0.5).sum()
    emit = found.emit + MIXED * overall[:, None]
    move = found.move * model.move + ADDED
    start = found.start + ADDED
    return Model(start / start.sum(), move / move.sum(axis=1)[:, None], emit / emit.sum(axis=0))


# Passes over the corpus.

def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, class, n) of the training texts, and (null, null, number of texts)."""
    counts: Counter[bytes] = Counter()
    texts = held = 0

    def flushed() -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([*words, None], pa.binary()), pa.array([*map(class_of, words), None], pa.int32()),
             pa.array([*counts.values(), texts], pa.int64())], names=["word", "class", "n"])

    for batch in batches:
        for text in binary(batch.column("text")):
            words = words_of(text)
            texts += 1
            counts.update(words)
            held += len(text or b"")
            if held > COUNTED_BYTES:
                yield flushed()
                counts.clear()
                texts = held = 0
    yield flushed()


def _encoded(shared):
    """Adds n_tokens, the symbols of each text as 16-bit numbers, and (word, n) of its words outside the common ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[bytes, int] = shared.value
        first = len(common) + 1
        for batch in batches:
            lengths, symbols, rest, times, offsets = [], [], [], [], [0]
            for text in binary(batch.column("_text")):
                words = words_of(text)
                found = [common.get(w, 0) for w in words]
                others = Counter(w for w, s in zip(words, found, strict=True) if not s)
                numbers = {w: first + class_of(w) for w in others}
                found = [s or numbers[w] for w, s in zip(words, found, strict=True)] if others else found
                found.append(0)
                lengths.append(len(found))
                symbols.append(np.array(found, dtype="<u2").tobytes())
                rest += others
                times += others.values()
                offsets.append(len(rest))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"])
            names = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(lengths, pa.int64()), pa.array(symbols, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], names=[*names, "n_tokens", "symbols", "rest"])
    return run


def _texts(batches: Iterator[pa.RecordBatch], most: int = GROUP) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches together with the symbols of their rows, so many tokens at least."""
    held, texts, n = [], [], 0
    for batch in batches:
        more = [np.frombuffer(s, dtype="<u2") for s in batch.column("symbols").to_pylist()]
        held.append(batch)
        texts += more
        n += sum(map(len, more))
        if n >= most:
            yield held, texts
            held, texts, n = [], [], 0
    if held:
        yield held, texts


def _expected(shared):
    """Rows (symbol, counts of each state); transitions from state s are row -2 - s, starts row -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        symbols, states = model.emit.shape
        found = Expected.none(symbols, states)
        for _, texts in _texts(batches):
            count_texts(model, texts, found)
        seen = np.flatnonzero(found.emit.any(axis=1))
        rows = np.concatenate([[-1], -2 - np.arange(states), seen]).astype(np.int32)
        values = np.concatenate([found.start[None, :], found.move, found.emit[seen]])
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(np.ascontiguousarray(values[:, s])) for s in range(states))],
                                         names=["symbol", *(f"s{s}" for s in range(states))])
    return run


def train(encoded: DataFrame, tokens: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the encoded training texts; `tokens` has the training tokens of each symbol."""
    context = encoded.sparkSession.sparkContext
    model = first_model(tokens, states)
    names = [f"s{s}" for s in range(states)]
    schema = "symbol int, " + ", ".join(f"{x} double" for x in names)
    for _ in range(rounds):
        shared = context.broadcast((model.start, model.move, model.emit))  # bounded: symbols x states
        sums = encoded.mapInArrow(_expected(shared), schema).groupBy("symbol").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        shared.unpersist()
        rows = sums.column("symbol").to_numpy()
        values = np.column_stack([sums.column(x).to_numpy() for x in names]).reshape(len(rows), states)
        found = Expected.none(len(tokens), states)
        for row, value in zip(rows[rows < 0], values[rows < 0], strict=True):
            if row == -1:
                found.start[:] = value
            else:
                found.move[-2 - row] = value
        found.emit[rows[rows >= 0]] = values[rows >= 0]
        model = next_model(model, found, tokens)
    return model


def _scored(shared):
    """Adds the common words' part of n_known and base_score, and the model's logarithm to base 10 without the words' counts.

    A word that is not common adds its own count's logarithm to both scores later; what its class divides that by is known here.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *tables, base, known, leaves = shared.value
        model = Model(*tables)
        for held, texts in _texts(batches):
            scores = log_probabilities(model, texts) / np.log(10) - np.array([leaves[t].sum() for t in texts])
            bases = [float(base[t].sum()) for t in texts]
            seen = [int(known[t].sum()) for t in texts]
            at = 0
            for batch in held:
                end = at + batch.num_rows
                names = [x for x in batch.schema.names if x != "symbols"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x) for x in names), pa.array(seen[at:end], pa.int64()), pa.array(bases[at:end], pa.float64()),
                     pa.array(scores[at:end])], names=[*names, "known", "base", "hidden"])
                at = end
    return run


def held_out(row_id: Column) -> Column:
    """Whether a text is kept from training, by its id."""
    return F.coalesce(F.pmod(F.crc32(row_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS,
              common: int = COMMON) -> DataFrame:
    """The documents but for their text with `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`."""
    if common > COMMON:
        raise ValueError(f"symbols are 16-bit numbers: at most {COMMON} common words")
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    carried = [c for c in docs.columns if c != text_col and c not in RESULTS]
    row_id = F.col(f"`{id_col}`") if id_col in docs.columns else F.lit(None)
    text = column_or_null(docs, text_col, "string")

    words = spool(docs.where(~held_out(row_id)).select(text.alias("text")).mapInArrow(_word_counts, "word binary, class int, n long")
                  .groupBy("word", "class").agg(F.sum("n").alias("n")), "words")
    n_texts = words.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = words.where("word is not null")
    n_words, n_distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = n_words + n_texts
    least = total + 0.5 * (n_distinct + (n_texts > 0) + 1)
    # Common words are those above a number of times that not more than `common` words reach; the numbers of times are
    # told apart by sixteenths of their binary order, so that what comes here to find the bound is a few hundred rows.
    order = F.floor(F.log2("n") * 16)
    short = known.where(F.length("word") <= LONGEST)
    bound, n_above = None, 0
    for level, n_words_there in short.groupBy(order.alias("order")).agg(F.count(F.lit(1))).orderBy(F.col("order").desc()).collect():
        n_above += n_words_there
        if n_above > common:
            break
        bound = level
    is_common = (F.length("word") <= LONGEST) & (order >= F.lit(bound)) if bound is not None else F.lit(False)
    top = known.where(is_common).select("word", "n").collect()  # no more than `common`
    numbers = {bytes(r["word"]): i + 1 for i, r in enumerate(top)}

    # The rest of the words, by class: a bounded table of sums.
    rest = known.where(~is_common)
    tokens, leaves = np.zeros(1 + len(top) + CLASSES), np.zeros(1 + len(top) + CLASSES)
    tokens[0] = n_texts
    tokens[1:len(top) + 1] = [r["n"] for r in top]
    leaves[len(top) + 1:] = np.log10(0.5)  # of an empty class: half a token for all unknown words
    for number, n, n_words_there in rest.groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():  # a record for each class
        tokens[1 + len(top) + number] = n
        leaves[1 + len(top) + number] = np.log10(n + 0.5 * (n_words_there + 1))

    # Texts as symbols, written once for all rounds.
    shared = context.broadcast(numbers)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried], F.lit(0).alias("_")).alias("row"),
                       held_out(row_id).alias("held_out"), F.monotonically_increasing_id().alias("rid"), text.alias("_text"))
    schema = fields(wide.drop("_text"), "n_tokens long, symbols binary, rest array<struct<word: binary, times: bigint>>")
    encoded = spool(wide.mapInArrow(_encoded(shared), schema), "symbols")
    model = train(encoded.where("not held_out").select("symbols"), tokens, states, rounds)

    # A common word is known, and its base score is that of its symbol; a class symbol adds nothing yet.
    named = np.arange(len(tokens)) <= len(top)
    base = np.where(named, np.log10((tokens + 0.5) / least), 0.0)
    shared = context.broadcast((model.start, model.move, model.emit, base, named & (tokens > 0), leaves))
    scored = encoded.select("row", "held_out", "rid", "n_tokens", "symbols")
    scored = scored.mapInArrow(_scored(shared), fields(scored.drop("symbols"), "known long, base double, hidden double"))

    # The other words of each text meet their counts.
    asked = encoded.select("rid", F.explode("rest").alias("w")).select("rid", "w.word", "w.times")
    counted = asked.join(rest.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = counted.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("logs"), F.sum("times").alias("others"),
                                      F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("others_known"))
    out = scored.join(sums, "rid", "left")
    none = F.lit(0)
    out = out.withColumns({
        "n_known": F.col("known") + F.coalesce("others_known", none), "train_tokens": F.lit(total).cast("bigint"),
        "base_score": F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.coalesce("others", none) * float(np.log10(least)),
        "score": F.col("hidden") + F.coalesce("logs", F.lit(0.0))})
    return unpacked(out, carried, *RESULTS)
