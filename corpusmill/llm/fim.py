"""Fill-in-middle rearrangement by a learned rank index.

A text is cut after a number of code points, but it is stored as bytes, and the
place of the k-th code point in the bytes is not k once a character takes more
than one byte. The index of a text holds that place for every boundary, its
ends included: a few straight lines from rank to place, each fitted to as
long a run of boundaries as it stays within `ERROR` bytes of, and one signed
byte per boundary, the residual. A cut is predicted by its line and corrected by
its residual, which makes it exact. A text of one-byte characters is one line
without residuals, and an index never takes more than a byte per character.

Where a text is cut, whether it is rearranged and which form it takes follow
from a hash of its id, so a rerun gives the same rows. Every row is done in its
own task, whole; nothing is shuffled.

Nulls and the like: a null text is an empty one, and an empty one stays plain;
a null id is hashed as an empty string; equal ids and texts get equal rows, each
its own. A text that holds one of the markers stays plain, so every output can
be turned back. Extra columns are carried along; those named like a result
column are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import column_or_null, fields
from corpusmill.llm.hashing import binary

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rearranged, and of a hundred rearranged ones so many with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Bytes by which a line may miss a boundary: what a signed byte holds.
ERROR = 127
#: Bytes of a text whose boundaries are fitted at once.
BLOCK = 1 << 20

RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class RankIndex:
    """rank of a code point boundary -> place in the bytes, by lines and residuals."""

    def __init__(self, text: bytes):
        self.bytes = len(text)
        data = np.frombuffer(text, dtype=np.uint8)
        first_rank: list[int] = []
        first_place: list[int] = []
        slope: list[float] = []
        rest: list[np.ndarray] = []
        rank = 0
        for at in range(0, max(self.bytes, 1), BLOCK):
            places = np.flatnonzero((data[at:at + BLOCK] & 0xC0) != 0x80) + at
            if at + BLOCK >= self.bytes:
                places = np.append(places, self.bytes)  # the end is a boundary too
            begin = 0
            while begin < len(places):
                run, line, residual = _line(places[begin:])
                if first_rank and line == slope[-1] == 1.0 and not residual.any() and not rest[-1].any() \
                        and places[begin] - first_place[-1] == rank - first_rank[-1]:
                    rest.append(residual)  # the last line goes on
                else:
                    first_rank.append(rank)
                    first_place.append(int(places[begin]))
                    slope.append(line)
                    rest.append(residual)
                begin, rank = begin + run, rank + run
        self.first_rank, self.first_place = np.array(first_rank), np.array(first_place)
        self.slope = np.array(slope)
        self.characters = rank - 1
        self.residuals = np.concatenate(rest) if any(r.any() for r in rest) else None

    def predicted(self, rank: int) -> int:
        """The place its line gives, at most `ERROR` bytes off."""
        line = int(np.searchsorted(self.first_rank, rank, "right")) - 1
        return int(self.first_place[line] + np.rint(self.slope[line] * (rank - self.first_rank[line])))

    def place(self, rank: int) -> int:
        """The exact place of the boundary before code point `rank`; `characters` gives the end."""
        return self.predicted(rank) + (int(self.residuals[rank]) if self.residuals is not None else 0)


def _line(places: np.ndarray) -> tuple[int, float, np.ndarray]:
    """(boundaries covered, slope, residuals) of a line from the first boundary that stays near as many as doubling finds."""
    def fitted(run: int) -> tuple[float, np.ndarray]:
        steps = np.arange(run)
        line = float((places[run - 1] - places[0]) / max(run - 1, 1)) if run > 1 else 1.0
        return line, places[:run] - places[0] - np.rint(line * steps).astype(np.int64)

    good, step = 1, len(places) - 1  # the whole block first: most texts are one line
    best = fitted(1)
    growing = False
    while step:
        run = min(good + step, len(places))
        line, residual = fitted(run)
        if np.abs(residual).max() <= ERROR:
            good, best = run, (line, residual)
            if good == len(places):
                break
            step = step * 2 if growing else step // 2
        elif not growing and good == 1 and step > 512:
            growing, step = True, 256
        else:
            growing, step = False, min(step, run - good) // 2
    return good, best[0], best[1].astype(np.int8)


def rearranged(text: bytes, lots: tuple[int, int, int, int], markers: tuple[bytes, bytes, bytes],
               rate: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and middle, output) of one text for its four hash numbers."""
    index = RankIndex(text)
    n = index.characters
    if not text or any(m in text for m in markers) or lots[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((lots[0] % (n + 1), lots[1] % (n + 1)))
    a, b = index.place(first), index.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = markers
    if lots[3] % 100 < suffix_first:
        return n, "spm", first, second - first, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, second - first, b"".join((p, prefix, s, suffix, m, middle))


def _rows(markers: tuple[bytes, bytes, bytes], rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for x in batch.schema.names if x not in ("_text", "_lot")]
            lots = batch.column("_lot").to_pylist()
            done = [rearranged(t or b"", tuple(int(lot[8 * k:8 * k + 8], 16) for k in range(4)), markers, rate, suffix_first)
                    for t, lot in zip(binary(batch.column("_text")), lots, strict=True)]
            n, form, prefix, middle, output = zip(*done, strict=True) if done else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=[*names, *RESULTS])
    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1",
                   markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), rate: int = REARRANGED,
                   suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The documents with `n`, `form` (plain, psm or spm), `prefix_chars`, `middle_chars` and the `output` text."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*RESULTS, "_text", "_lot")])
    key = F.coalesce(column_or_null(docs, id_col, "string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept.columns], column_or_null(docs, text_col, "string").alias("_text"),
                       F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key), 256), 1, 32).alias("_lot"))
    run = _rows(tuple(m.encode() for m in markers), rate, suffix_first)
    return rows.mapInArrow(run, fields(kept, "n long, form string, prefix_chars long, middle_chars long, output string"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The original text of an output."""
    p, s, m = markers

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring(output, len(start) + 1, 2**31 - 1), end, 1)

    middle = F.substring_index(output, m, -1)
    prefix_first = F.concat(between(p, s), middle, F.substring_index(F.substring_index(output, s, -1), m, 1))
    suffix_first = F.concat(F.substring_index(F.substring_index(output, p, -1), m, 1), middle, between(s, p))
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)


#: The same rows in DuckDB.
SQL = """
WITH lots AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 AS plain,
         CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 AS suffix_first FROM lots),
cut AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM numbers),
parts AS (
  SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM cut)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN suffix_first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""
