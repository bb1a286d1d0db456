"""Sharding by sampled splitters: shards of nearly equal bytes from ranges of a sorted key.

The sort key of a row is the hash of its key column, then the hash of its id,
then its place in the input, so that equal keys stand together and any range,
even one of copies only, can still be cut. A size-weighted sample of the keys
gives the splitters, a pass over all rows the true size of every range, ranges
that are overfull by bytes or by rows are cut again by samples of their own,
and sums over the ranges give every row its place in the whole order. Shard i
then holds the rows whose middle byte lies in the i-th of `n_shards` equal
parts. The sample decides how evenly the work is dealt, never which shard a
row gets.

Nulls and the like: a null text has no bytes and size 8; null keys and ids
stand together like any other value; equal rows each get a slot of their own;
an empty table gives an empty table. Input columns named like a result column
are replaced by it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import packed, unpacked
from corpusmill.session import spool

#: Ranges for each shard at least, rows in a range at most (about), sampled keys for each range.
RANGES_PER_SHARD = 8
ROWS_PER_RANGE = 500_000
SAMPLES_PER_RANGE = 16
#: A range is overfull above this many times the mean range.
OVERFULL = 2.0

KEY = ("_k1", "_k2", "_k3")
RESULTS = ("shard", "slot")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def _keyed(docs: DataFrame, key: Column, row_id: Column, size: Column) -> DataFrame:
    rows = packed(docs, _k1=F.xxhash64(key), _k2=F.xxhash64(row_id), _size=size.cast("bigint"))
    return spool(rows.withColumn("_k3", F.monotonically_increasing_id()), "keyed")


def _range_of(splitters: list[tuple[int, ...]]) -> Column:
    """How many of the sorted splitters are not above the row's key, by halving."""
    if not splitters:
        return F.lit(0)
    text = json.dumps([dict(zip(KEY, s, strict=True)) for s in splitters])
    table = F.from_json(F.lit(text), f"array<struct<{', '.join(f'{k}: bigint' for k in KEY)}>>")
    key = F.struct(*KEY)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        middle = ((state.lo + state.hi) / 2).cast("int")
        open_ = state.lo < state.hi
        below = open_ & (F.get(table, middle) <= key)
        return F.struct(F.when(below, middle + 1).otherwise(state.lo).alias("lo"),
                        F.when(open_ & ~below, middle).otherwise(state.hi).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    return F.aggregate(steps, start, halve, lambda s: s.lo)


def _quantiles(sample: DataFrame, every: int) -> list[tuple[int, ...]]:
    """Every so many-th key of the sorted sample; the sample is bounded by its parameters."""
    ordered = F.sort_array(F.collect_list(F.struct(*KEY)))
    picked = F.filter(F.transform(ordered, lambda x, i: F.when((i + 1) % every == 0, x)), lambda x: x.isNotNull())
    return [tuple(x) for x in sample.agg(picked.alias("k")).first()["k"]]


def _sample(rows: DataFrame, wanted: float, n_bytes: int, n_rows: int, salt: str) -> DataFrame:
    """About `wanted` rows, each by its share of the bytes and of the rows."""
    weight = wanted * (F.col("_size") / max(n_bytes, 1) + 1 / max(n_rows, 1)) / 2
    lot = F.pmod(F.xxhash64(F.lit(salt), *KEY), F.lit(1 << 30)) / (1 << 30)
    return rows.where(lot < weight).select(*KEY)


def splitters(rows: DataFrame, n_ranges: int, n_bytes: int, n_rows: int) -> list[tuple[int, ...]]:
    """Sorted splitters of about `n_ranges` ranges, none of them overfull."""
    found = _quantiles(_sample(rows, n_ranges * SAMPLES_PER_RANGE, n_bytes, n_rows, "0"), SAMPLES_PER_RANGE)
    for again in range(1, 20):
        sizes = _sizes(rows, found)
        over = {i: max(b * n_ranges / n_bytes, n * n_ranges / n_rows) for i, n, b in sizes
                if n > 1 and max(b * n_ranges / n_bytes, n * n_ranges / n_rows) > OVERFULL}
        if not over:
            break
        more = rows.where(_range_of(found).isin(*over))
        b, n = (sum(x[k] for x in sizes if x[0] in over) for k in (2, 1))
        cuts = _quantiles(_sample(more, sum(over.values()) * SAMPLES_PER_RANGE, b, n, str(again)), SAMPLES_PER_RANGE)
        new = sorted({*found, *cuts})
        if new == found:
            break
        found = new
    return found


def _sizes(rows: DataFrame, found: list[tuple[int, ...]]) -> list[tuple[int, int, int]]:
    """(range, rows, bytes) of every range that has rows: one record for each range."""
    counted = rows.groupBy(_range_of(found).alias("range")).agg(F.count(F.lit(1)), F.sum("_size"))
    return sorted(tuple(r) for r in counted.collect())


def shard_by_bytes(docs: DataFrame, n_shards: int, key: Column, row_id: Column, size: Column) -> DataFrame:
    """The rows with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in the shard)."""
    rows = _keyed(docs, key, row_id, size)
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    n_ranges = max(RANGES_PER_SHARD * n_shards, n_rows // ROWS_PER_RANGE)
    found = splitters(rows, n_ranges, n_bytes, n_rows) if n_rows else []
    starts, row_at, byte_at = [], 0, 0
    for i, n, b in _sizes(rows, found):
        starts.append({"range": i, "row_at": row_at, "byte_at": byte_at})
        row_at, byte_at = row_at + n, byte_at + b
    # One record for each range, as many as there are splitters and one.
    table = rows.sparkSession.createDataFrame([(s["range"], s["row_at"], s["byte_at"]) for s in starts],
                                              "range int, row_at bigint, byte_at bigint")
    inside = Window.partitionBy("range").orderBy(*KEY)

    def in_shards(some: DataFrame) -> DataFrame:
        placed = some.withColumn("range", _range_of(found)).withColumns({
            "_row": F.row_number().over(inside), "_end": F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
        placed = placed.join(F.broadcast(table), "range").withColumns({
            "_row": F.col("_row") - 1 + F.col("row_at"),
            "_middle": 2 * (F.col("byte_at") + F.col("_end")) - F.col("_size")})  # in half bytes
        part = F.floor(F.col("_middle").cast("decimal(38,0)") * n_shards / F.lit(max(2 * n_bytes, 1)))
        return placed.withColumn("shard", F.least(part.cast("int"), F.lit(n_shards - 1)))

    # Where a shard begins follows from keys and sizes alone; the rows themselves move once.
    first = in_shards(rows.select(*KEY, "_size")).groupBy("shard").agg(F.min("_row").alias("_first"))  # a record for each shard
    out = in_shards(rows).join(F.broadcast(spool(first, "first")), "shard").withColumn("slot", F.col("_row") - F.col("_first"))
    return unpacked(out, docs.columns, *RESULTS)


def write_shards(sharded: DataFrame, path: str) -> str:
    """One folder for each shard; a large shard takes several files, which AQE cuts."""
    sharded.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return path
