"""Splits and shards of exact sizes: the same row lands in the same part on every run.

Rows are ordered by a hash of their key, then by the key. No sort is made: the rows at which parts begin are found by
counting. Three rounds of histograms over the 32 bits of the hash, eleven at a time, give the hash of each of these rows;
the few keys that share it are counted, and only the rows of a key that lies on both sides of a border are numbered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.tables import row_ids

#: Bits of the hash that each round tells apart.
ROUNDS = (11, 11, 10)


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def _hash(salt: str, key: str) -> Column:
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), _key(key))), 1, 8), 16, 10)
    return digest.cast("bigint")


def _hashes_at(hashes: DataFrame, places: Sequence[int]) -> list[tuple[int, int]]:
    """(hash, rows below it) of the rows at these places, counted from 0, in the order of the column `h`."""
    found = [(0, 0)] * len(places)  # (leading bits, rows below them)
    bits = 0
    for more in ROUNDS:
        shift = 32 - bits - more
        known = sorted({lead for lead, _ in found})
        near = hashes.where(F.shiftright("h", 32 - bits).isin(known)) if bits else hashes
        counted: dict[int, dict[int, int]] = {}
        for lead, n in near.groupBy(F.shiftright("h", shift).alias("lead")).agg(F.count(F.lit(1))).collect():
            counted.setdefault(lead >> more, {})[lead] = n
        for i, place in enumerate(places):
            lead, below = found[i]
            for child, n in sorted(counted[lead].items()):
                if below + n > place:
                    found[i] = (child, below)
                    break
                below += n
        bits += more
    return found


def part_by_hash(rows: DataFrame, key: str, salt: str, borders: Sequence[int], name: str = "part") -> DataFrame:
    """Add the number of borders that lie at or before each row in the order of the hash; borders are places from 0."""
    order, ident = _hash(salt, key), _key(key)
    total = rows.count()
    inside = sorted(b for b in borders if 0 < b < total)
    always = sum(b <= 0 for b in borders)
    hashes = rows.select(order.alias("h"), ident.alias("k"))
    at = _hashes_at(hashes.select("h"), inside) if inside else []
    keys: dict[int, list[tuple[str, int]]] = {}
    if at:
        same = hashes.where(F.col("h").isin(sorted({h for h, _ in at}))).groupBy("h", "k").agg(F.count(F.lit(1)).alias("n"))
        for h, k, n in same.collect():  # keys that share one of these hashes
            keys.setdefault(h, []).append((k, n))
    first: list[tuple[int, str, int]] = []  # the first row behind each border: hash, key, number among the rows of the key
    for place, (h, below) in zip(inside, at, strict=True):
        for k, n in sorted(keys[h], key=lambda x: x[0].encode()):
            if below + n > place:
                first.append((h, k, place - below))
                break
            below += n

    def numbered(some: DataFrame, number: Column) -> DataFrame:
        behind = F.lit(always)
        for h, k, n in first:
            after = (order > h) | ((order == h) & ((ident > k) | ((ident == k) & (number >= n))))
            behind = behind + after.cast("int")
        return some.withColumn(name, behind)

    shared = sorted({k for _, k, n in first if n > 0})
    if not shared:
        return numbered(rows, F.lit(0))
    out = numbered(rows.where(~ident.isin(shared)), F.lit(0))
    for k in shared:
        of_key = row_ids(rows.where(ident == k), key, name="_number")
        out = out.unionByName(numbered(of_key, F.col("_number") - 1).select(*rows.columns, name))
    return out


def split_train_val_test(rows: DataFrame, key: str, test_size: float = 0.2, validation_size: float = 0.25) -> DataFrame:
    """Add `split`: a share of the rows is test, a share of the rest validation; both are rounded up."""
    total = rows.count()
    n_test = math.ceil(round(total * test_size, 6))
    parted = part_by_hash(rows, key, "test", [n_test], "_part")
    test = parted.where("_part = 0").drop("_part").withColumn("split", F.lit("test"))
    rest = split_train_test(parted.where("_part = 1").drop("_part"), key, validation_size, "validation")
    return test.unionByName(rest)


def split_train_test(rows: DataFrame, key: str, test_size: float | None = 0.2, name: str = "test") -> DataFrame:
    """Add `split` of train and test, which is rounded up; without a size everything is train."""
    if test_size is None:
        return rows.withColumn("split", F.lit("train"))
    n_test = math.ceil(round(rows.count() * test_size, 6))
    parted = part_by_hash(rows, key, name, [n_test], "_part")
    return parted.withColumn("split", F.when(F.col("_part") == 0, name).otherwise("train")).drop("_part")


def shard(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Add `shard` in 0 .. shards-1; their sizes differ by one at most."""
    total = rows.count()
    return part_by_hash(rows, key, "shard", [-(-total * i // shards) for i in range(1, shards)], "shard")
