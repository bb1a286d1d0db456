"""Exact nearest neighbours over stored vectors that lie in cells around centroids.

The vectors are written once, a folder for each cell, each with its distance to the cell's centroid; a small table
has the centroids with the largest distance in their cell. By the triangle inequality no vector of a cell is nearer
to a query than the centroid is, less that distance. The cells nearest to a query are read first; the k-th
distance found there rules out whole cells, whose files are not read, and within a cell the vectors whose own
distance to the centroid differs too much. Queries are a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import new_path, spool

SCORE_DIGITS = 6
#: Centroids there are at most: a bounded table, which goes to every task.
MOST_CELLS = 1024


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    id_col: str
    id_type: str = "bigint"

    @property
    def vectors(self) -> DataFrame:
        schema = f"id {self.id_type}, vector array<double>, away double, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.schema("cell int, centroid array<double>, radius double, n bigint").parquet(f"{self.path}/cells")

    def _near(self, asked: DataFrame) -> DataFrame:
        """(query_id, id, score) of the vectors in the asked cells (query_id, vector, cell, d); only these are read."""
        numbers = [r["cell"] for r in asked.select("cell").distinct().collect()]  # no more than there are cells
        stored = self.vectors.where(F.col("cell").isin(numbers)).select("cell", "id", F.col("vector").alias("other"), "away")
        pairs = stored.join(asked, "cell")
        if "reach" in asked.columns:
            pairs = pairs.where(F.abs(F.col("d") - F.col("away")) <= F.col("reach"))
        return pairs.select("query_id", "id", F.round(squared(F.col("vector"), F.col("other")), SCORE_DIGITS).alias("score"))

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, id, score, rank): the k nearest vectors to each query (query_id, vector) by squared distance; ties by id."""
        best = Window.partitionBy("query_id").orderBy("score", "id")
        table = [F.struct(F.lit(r["cell"]).alias("cell"), F.lit(list(r["centroid"])).alias("centroid"), F.lit(r["radius"]).alias("radius"),
                          F.lit(r["n"]).cast("bigint").alias("n")) for r in self.cells.collect()]  # bounded by `MOST_CELLS`
        if not table:
            return queries.where("false").select("query_id", F.lit(None).cast(self.id_type).alias(self.id_col),
                                                 F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        cells = queries.select("query_id", "vector", F.inline(F.array(*table)))
        cells = cells.withColumn("d", F.sqrt(squared(F.col("vector"), F.col("centroid")))).drop("centroid")
        order = Window.partitionBy("query_id").orderBy("d", "cell")
        cells = spool(cells.withColumn("sooner", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "asked")
        first = self._near(cells.where(F.col("sooner") < k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        first = spool(first, "first")
        kth = first.where(F.col("rank") == k).select("query_id", F.sqrt(F.col("score") + 2 * 10.0 ** -SCORE_DIGITS).alias("reach"))
        # With fewer than k vectors in all, the first cells were all cells.
        rest = cells.where(F.col("sooner") >= k).join(kth, "query_id").where(F.col("d") - F.col("radius") <= F.col("reach"))
        found = first.drop("rank")
        if not rest.isEmpty():
            found = found.unionByName(self._near(rest))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.withColumnRenamed("id", self.id_col)


def build_vector_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", path: str | None = None,
                       cells: int | None = None) -> VectorIndex:
    """Write the index of (id, vector) below `path`, or a fresh folder; vectors that are null are left out.

    Centroids are vectors chosen by a hash of the id, about as many as the root of their number, and then moved to the mean
    of their cells once.
    """
    spark = vectors.sparkSession
    path = path or new_path(spark, "vector-index")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null")
    wanted = min(cells or max(1, math.isqrt(rows.count())), MOST_CELLS)
    chosen = [list(r["vector"]) for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()]  # bounded

    def assigned(centroids: list[list[float]]) -> DataFrame:
        table = F.from_json(F.lit(str(centroids)), "array<array<double>>")
        away = F.array_min(F.transform(table, lambda c, i: F.struct(squared(F.col("vector"), c).alias("d"), i.alias("cell"))))
        return rows.withColumn("near", away).select("id", "vector", F.sqrt("near.d").alias("away"), F.col("near.cell").alias("cell"))

    if chosen:
        means = assigned(chosen).select("cell", F.posexplode("vector").alias("at", "x")).groupBy("cell", "at").agg(F.avg("x").alias("x"))
        moved = means.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centroid"))
        chosen = [list(r["centroid"]) for r in moved.orderBy("cell").collect()]
    stored = assigned(chosen or [[]]).repartition("cell")
    stored.write.partitionBy("cell").parquet(f"{path}/vectors")
    index = VectorIndex(spark, path, id_col, rows.schema["id"].dataType.simpleString())
    radii = index.vectors.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    centroids = spark.createDataFrame(list(enumerate(chosen)), "cell int, centroid array<double>")
    centroids.join(radii, "cell").write.parquet(f"{path}/cells")
    return index
