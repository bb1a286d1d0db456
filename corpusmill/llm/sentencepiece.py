"""SentencePiece encoding and decoding with the pieces and scores of a public model.

A text is encoded as the sequence of pieces with the highest sum of scores. An
Aho-Corasick automaton over the pieces reads it once, from left to right; at
each position the output links give every piece that ends there, the longest
first, and each relaxes the best score of the position. A character that is
no piece costs `UNKNOWN` more than the worst piece and is written as byte pieces.

Pieces hold the blank mark at their start only (a model's pieces are checked for
this), so no piece crosses from one word into the next: the best sequence of a
text is that of its words, one after another. The words of a batch are each cut
once, and put together again by their numbers.

Nulls and the like: a null text gives a null array of ids, an empty one an empty
array; any text, blanks and unknown characters included, decodes to itself.
Repeated rows are encoded alike. Extra columns are carried along; those named
like a result column are replaced.
"""

from __future__ import annotations

import gc
import re
import struct
import sys
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import column_or_null, fields
from corpusmill.llm.hashing import filled

BLANK = "▁"
#: Stands for a blank mark that is itself in the text; no valid text holds it.
HELD = "\udc81"
#: Below the worst score, for a character that is no piece.
UNKNOWN = 10.0
MARKS = ".,!%$&#*|?;:"
_LETTER = re.compile(r"[^\W\d_]")
#: Words that a worker remembers, twice: the last ones, and those before them; and the longest word that is remembered.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64
#: Words that are encoded together, of so many characters at most, and bytes of texts whose words are looked up together.
TOGETHER, TOGETHER_LENGTH, TEXTS_AT_ONCE = 20_000, 24, 4 << 20
#: Kinds of pieces in a model file.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
RESULTS = ("ids", "score")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _message(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(field number, value) of a serialised message; fixed 32-bit values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of each id of a model file."""
    with open(path, "rb") as file:
        data = file.read()
    pieces = []
    for number, value in _message(data):
        if number == 1:
            piece = dict(_message(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode("utf-8"), score, piece.get(3, NORMAL)))
    return pieces


class Automaton:
    """Aho-Corasick over the pieces, by characters."""

    def __init__(self, pieces: list[tuple[str, int, float]]):
        self.go: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, int, float] | None] = [None]  # (id, length, score) that ends here
        for text, number, score in pieces:
            state = 0
            for c in text:
                if c not in self.go[state]:
                    self.go[state][c] = len(self.go)
                    self.go.append({})
                    self.piece.append(None)
                state = self.go[state][c]
            self.piece[state] = (number, len(text), score)
        self.fail = [0] * len(self.go)
        out = [0] * len(self.go)  # the nearest shorter ending that is a piece
        queue = deque(self.go[0].values())
        order = []
        while queue:
            state = queue.popleft()
            order.append(state)
            for c, child in self.go[state].items():
                back = self.fail[state]
                while back and c not in self.go[back]:
                    back = self.fail[back]
                self.fail[child] = self.go[back].get(c, 0)
                queue.append(child)
        #: All pieces that end in a state, the longest first: its own, then those along the output links.
        self.ends: list[tuple[tuple[int, int, float], ...]] = [()] * len(self.go)
        for state in order:
            out[state] = self.fail[state] if self.piece[self.fail[state]] else out[self.fail[state]]
            own = (self.piece[state],) if self.piece[state] else ()
            self.ends[state] = own + self.ends[out[state]]
        self._arrays(out)

    def _arrays(self, out: list[int]) -> None:
        """The same automaton for many texts together: steps as sorted numbers, and by state its links and piece."""
        letters = sorted({c for steps in self.go for c in steps})
        self.letter = np.zeros(0x110001, dtype=np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        steps = np.array([(s * self.letters + self.letter[ord(c)], t) for s, go in enumerate(self.go) for c, t in go.items()],
                         dtype=np.int64).reshape(-1, 2)
        self.step, self.to = steps[np.argsort(steps[:, 0])].T.copy()
        self.back, self.link = np.array(self.fail), np.array(out)
        self.number, self.length, self.score = (np.array([p[k] if p else 0 for p in self.piece]) for k in (0, 1, 2))
        self.held = np.array([p is not None for p in self.piece])

    def _next(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after a letter each."""
        state, open_ = state.copy(), np.arange(len(state))
        while len(open_):
            key = state[open_] * self.letters + letter[open_]
            at = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            hit = self.step[at] == key
            state[open_[hit]] = self.to[at[hit]]
            open_ = open_[~hit]
            top = state[open_] == 0
            open_ = open_[~top]
            state[open_] = self.back[state[open_]]
        return state

    def viterbi_all(self, texts: list[str], unknown: float) -> list[tuple[bytes, float] | None]:
        """(little-endian 32-bit ids, score) of each text as `viterbi` has it; None where a character is no piece."""
        if not texts or not len(self.step):
            return [None] * len(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        order = np.argsort(-sizes, kind="stable")  # the longest first, so that those not yet at their end come first
        n, most = len(texts), int(sizes.max())
        letters = np.zeros((n, most), dtype=np.int32)
        letters[np.arange(most) < sizes[order][:, None]] = self.letter[
            np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        best, number = np.zeros((n, most + 1)), np.full((n, most + 1), -1, dtype=np.int32)
        length, state = np.ones((n, most + 1), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for at in range(most):
            live = int(np.count_nonzero(sizes > at))
            state = self._next(state[:live], letters[:live, at])
            top, by, long = best[:live, at] + unknown, np.full(live, -1, dtype=np.int32), np.ones(live, dtype=np.int64)
            end = np.where(self.held[state], state, self.link[state])
            row = np.flatnonzero(end)
            while len(row):  # along the output links, the longest piece first
                piece = end[row]
                total = best[row, at + 1 - self.length[piece]] + self.score[piece]
                better = (total > top[row]) | ((by[row] < 0) & (total == top[row]))
                won = row[better]
                top[won], by[won], long[won] = total[better], self.number[piece[better]], self.length[piece[better]]
                end[row] = self.link[piece]
                row = row[end[row] > 0]
            best[:live, at + 1], number[:live, at + 1], length[:live, at + 1] = top, by, long
        ids, left, at = np.zeros((n, most), dtype="<i4"), np.full(n, most), sizes[order]
        row, unread = np.arange(n), np.zeros(n, dtype=bool)
        while len(row):  # from the end back
            left[row] -= 1
            got = number[row, at[row]]
            unread[row[got < 0]] = True
            ids[row, left[row]] = got
            at[row] -= length[row, at[row]]
            row = row[at[row] > 0]
        data, scores = ids.tobytes(), best[np.arange(n), sizes[order]].tolist()
        found: list[tuple[bytes, float] | None] = [None] * n
        for k, (i, a, none) in enumerate(zip(order.tolist(), left.tolist(), unread.tolist(), strict=True)):
            if not none:
                found[i] = data[4 * (k * most + a):4 * (k + 1) * most], scores[k]
        return found

    def viterbi(self, text: str, unknown: float) -> tuple[float, list[tuple[int, str]]]:
        """(score, [(id or -1, characters)]) of the best sequence; of equals the one whose last pieces are longest."""
        go, fail, ends = self.go, self.fail, self.ends
        best, last, state = [0.0], [(-1, 0)], 0
        for c in text:
            step = go[state].get(c)
            while step is None and state:
                state = fail[state]
                step = go[state].get(c)
            state = step or 0
            top, by = best[-1] + unknown, (-1, 1)
            for piece in ends[state]:
                total = best[-piece[1]] + piece[2]
                if total > top or by[0] < 0 and total == top:
                    top, by = total, piece
            best.append(top)
            last.append(by)
        found, at = [], len(text)
        while at:
            number, length = last[at][:2]
            found.append((number, text[at - length:at]))
            at -= length
        return best[-1], found[::-1]


class Model:
    """A model file's pieces, ready to encode and decode."""

    def __init__(self, path: str):
        self.pieces = read_pieces(path)
        normal = [(p, i, s) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)]
        self.normal = normal
        self.unknown = min((s for _, _, s in normal), default=0.0) - UNKNOWN
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        inside = any(BLANK in p.lstrip(BLANK) for p, _, _ in normal)
        # Where a piece crosses from a word to the next, texts are read whole. A line break in no piece stands alone.
        self.inside = inside
        alone = "" if any("\n" in p for p, _, _ in normal) else "\n"
        # Marks that no piece holds after a letter: a word and the mark after it are separate parts.
        joined = {b for p, _, _ in normal for a, b in zip(p, p[1:]) if _LETTER.match(a)}
        marks = "".join(re.escape(m) for m in MARKS if m not in joined)
        word = f"{BLANK}*+{_LETTER.pattern}++(?=[{marks}])|" if marks else ""
        self.parts = re.compile("(?s).+" if inside else f"{word}{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|\n")
        self.known: dict[str, tuple[bytes, float]] = {}
        self.older: dict[str, tuple[bytes, float]] = {}
        self.strings = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(BLANK, " ").encode() if kind in (NORMAL, USER_DEFINED) else b""
                        for p, _, kind in self.pieces]
        self.bytes_of_ids = pa.array(self.strings, pa.binary())

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton(self.normal)

    def _part(self, part: str) -> tuple[bytes, float]:
        score, found = self.automaton.viterbi(part, self.unknown)
        ids: list[int] = []
        for number, characters in found:
            ids += [number] if number >= 0 else [self.bytes[b] for b in characters.replace(HELD, BLANK).encode("utf-8")]
        return np.array(ids, dtype="<i4").tobytes(), score

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, float]]:
        """Ids and scores of marked words; those of short words are remembered."""
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        once = {w: self.older[w] for w in words if w in self.older}
        cut = {w: self.parts.findall(w) for w in words if w not in once}
        parts: dict[str, tuple[bytes, float] | None] = dict.fromkeys(p for found in cut.values() for p in found)
        short = [p for p in parts if len(p) <= TOGETHER_LENGTH]
        for at in range(0, len(short), TOGETHER):
            some = short[at:at + TOGETHER]
            parts.update(zip(some, self.automaton.viterbi_all(some, self.unknown), strict=True))
        for part, result in parts.items():
            if result is None:
                parts[part] = self._part(part)
        for word, found in cut.items():
            once[word] = (parts[found[0]] if len(found) == 1 else
                          (b"".join([parts[p][0] for p in found]), sum([parts[p][1] for p in found])))
        self.known.update((w, result) for w, result in once.items() if len(w) <= REMEMBERED_LENGTH)
        return once

    def encode(self, text: str) -> tuple[bytes, float]:
        """(little-endian 32-bit ids, sum of scores); a blank is put in front, as the model was made."""
        if not text:
            return b"", 0.0
        marked = BLANK + text.replace(BLANK, HELD).replace(" ", BLANK)
        found = [self._part(p) for p in self.parts.findall(marked)]
        return b"".join([f[0] for f in found]), sum([f[1] for f in found])

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, score) of each text, null for null; a word with the blanks before it is encoded once for all of them."""
        if self.inside:
            row = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            number, found = np.arange(len(row)), [self.encode(t) for t in texts.drop_null().to_pylist()]
        else:
            row, number, words = blank_words(texts)
            found = list(map(self.known.get, words))
            if None in found:
                once = self._learn([w for w, f in zip(words, found, strict=True) if f is None])
                found = [once[w] if f is None else f for w, f in zip(words, found, strict=True)]
        lengths = np.fromiter((len(f[0]) >> 2 for f in found), dtype=np.int64, count=len(found))
        scores = np.fromiter((f[1] for f in found), dtype=np.float64, count=len(found))
        flat = np.frombuffer(b"".join([f[0] for f in found]), dtype="<i4")
        each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat, pa.int32()))
        ends = np.cumsum(np.bincount(row, weights=lengths[number], minlength=len(texts)).astype(np.int64))
        null = texts.is_null()
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), each.take(pa.array(number)).flatten(), mask=null)
        sums = np.bincount(row, weights=scores[number], minlength=len(texts))
        return ids, pc.if_else(null, pa.scalar(None, pa.float64()), pa.array(sums))

    def decode(self, ids: np.ndarray) -> str:
        strings = self.strings
        data = b"".join([strings[i] for i in ids.tolist()])
        text = data.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The text of each row of ids, null for null."""
        strings = self.bytes_of_ids.take(ids.values)
        data = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, strings), b"")
        try:
            texts = data.cast(pa.string())
        except pa.ArrowInvalid:  # some ids are no text: these are replaced
            texts = pa.array([d.decode("utf-8", "replace") for d in data.to_pylist()], pa.string())
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), texts)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles: new words are many small objects and hold none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def blank_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, number) of each word of the texts with a blank in front, and by number the words with all blanks before them, marked.

    Blanks that end a text are a word of their own; a null or empty text has none.
    """
    split = pc.split_pattern(texts, " ")
    coded = split.values.dictionary_encode()
    words, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    begins = split.offsets.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(begins))
    marked = [BLANK + w.replace(BLANK, HELD) for w in words]
    if "" not in words:
        return row, number, marked
    at = np.arange(len(number))
    empty = number == words.index("")
    last = at == begins[row + 1] - 1
    before = np.append(-1, np.maximum.accumulate(np.where(empty, -1, at)))[:-1]  # the word before, in whichever text
    blanks = at - np.maximum(before, begins[row] - 1)
    keep = (~empty | last) & ~(empty & last & (begins[row] == at))
    row, number, blanks = row[keep], number[keep].astype(np.int64), blanks[keep]
    several = np.flatnonzero(blanks > 1)
    pairs, of = np.unique(np.stack([number[several], blanks[several]]), axis=1, return_inverse=True)
    number[several] = len(words) + of.reshape(-1)
    return row, number, marked + [BLANK * (k - 1) + marked[w] for w, k in pairs.T.tolist()]


def worker_model(path: str | None) -> Model:
    """The model of this worker process, which Spark keeps for further tasks, with the words it knows.

    Functions come to a worker anew with each task, so what outlasts them is kept by the interpreter's own module.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    held = sys.__dict__.setdefault("_corpusmill_models", {})
    if path not in held:
        held[path] = Model(path)
    return held[path]


def _encoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(path)
        for table in filled(batches, TEXTS_AT_ONCE):
            table = table.combine_chunks()
            with uncollected():
                ids, scores = model.encode_all(table.column("_text").combine_chunks())
            names = [n for n in table.column_names if n != "_text"]
            yield from pa.Table.from_arrays([*(table.column(n) for n in names), ids, scores], names=[*names, *RESULTS]).to_batches()
    return run


def _decoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(path)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "_ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), model.decode_all(batch.column("_ids"))],
                                             names=[*names, "decoded"])
    return run


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """The rows with `ids` and the `score` of the sequence."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*RESULTS, "_text")])
    rows = kept.withColumn("_text", column_or_null(docs, text_col, "string"))
    return rows.mapInArrow(_encoded(model), fields(kept, "ids array<int>, score double"))


def decode(encoded: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """The rows with the `decoded` text of their ids."""
    kept = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c not in ("decoded", "_ids")])
    rows = kept.withColumn("_ids", F.col(f"`{ids_col}`"))
    return rows.mapInArrow(_decoded(model), fields(kept, "decoded string"))
