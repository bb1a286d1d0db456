"""A stored inverted index of TF-IDF vectors, and search in it.

The corpus is read once. What is written below one folder:

- `vocabulary` (term, df, idf, blocks), with the blocks of documents that hold the term;
- `ids` (id): every document, also those without a term;
- `postings` (term, block, df, top, entries): the entries (id, w) of a term in a block of documents, and their largest
  weight. A frequent term has a row for each block, so none is larger than a block, and files are sorted by term.
  Unpacked they are the unit vectors in long form.

The texts, not their many entries, are shuffled: by block, twice. Words are counted, weighed and gathered to postings
in the tasks of the blocks; between them only the blocks of each term and its weight travel. A task has a few blocks,
so that what it sorts does not grow with the corpus.

A search reads the rows of its terms only: parquet statistics and bloom filters skip the rest. The largest
weights bound the score that a block can reach for a query. The most promising blocks are scored first; the
k-th score found there rules out all blocks that cannot reach it, whose entries are never unpacked. Queries are a
table, so hundreds of them run together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.session import new_path, spool
from corpusmill.tables import literal_table

SCORE_DIGITS = 6
#: Documents of a block, blocks of a query that are scored first, query terms up to which a filter names them.
DOCS_PER_BLOCK, FIRST_BLOCKS, NAMED_TERMS = 1024, 4, 2000
#: Blocks that one task of the build works on where there are more blocks than cores.
BLOCKS_PER_TASK = 4
#: Off: sides of a join that lie by one of its columns are joined as they lie.
PART_OF_KEY = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    id_col: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def vocabulary(self) -> DataFrame:
        return self._table("vocabulary").drop("blocks")

    @property
    def vectors(self) -> DataFrame:
        return self.postings.select("term", F.inline("entries")).select(F.col("id").alias(self.id_col), "term", "w")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def ids(self) -> DataFrame:
        return self._table("ids")

    def weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, q): unit vectors of queries (query_id, text); terms outside the vocabulary drop out."""
        counted = queries.select("query_id", F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(
            F.count(F.lit(1)).alias("n"))
        raw = counted.join(self.vocabulary, "term").withColumn("raw", F.col("n") * F.col("idf"))
        length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("query_id")))
        return raw.select("query_id", "term", (F.col("raw") / length).alias("q"))

    def _near(self, weights: DataFrame) -> DataFrame:
        """The postings of the terms asked for; a few of them are named in the scan's filter."""
        named = weights.select("term").distinct().limit(NAMED_TERMS + 1).collect()
        return self.postings.where(F.col("term").isin([r["term"] for r in named])) if len(named) <= NAMED_TERMS else self.postings

    @staticmethod
    def _bounds(near: DataFrame, weights: DataFrame) -> DataFrame:
        """(query_id, block, bound, place): no document of the block scores higher; best blocks first."""
        reach = near.select("term", "block", "top").join(weights, "term").groupBy("query_id", "block").agg(
            F.sum(F.col("q") * F.col("top")).alias("bound"))
        return reach.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")))

    @staticmethod
    def _scored(near: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
        asked = near.join(weights, "term").join(blocks.select("query_id", "block"), ["query_id", "block"])
        return asked.select("query_id", "q", F.inline("entries")).groupBy("query_id", "id").agg(
            F.round(F.sum(F.col("q") * F.col("w")), SCORE_DIGITS).alias("score"))

    def matches(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, id, score) of the documents that share a term with a query; with `k` the k best of each query at least."""
        weights = spool(self.weights(queries), "weights")
        near = self._near(weights)
        bounds = self._bounds(near, weights)
        if k is None:
            return self._scored(near, weights, bounds)
        bounds = spool(bounds, "bounds")
        first = spool(_best(self._scored(near, weights, bounds.where(F.col("place") <= FIRST_BLOCKS)), k), "first")
        rest = bounds.where(F.col("place") > FIRST_BLOCKS)
        kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        # A bound is compared with a rounded score, so half a unit of the last digit is left to it.
        open_ = rest.join(kth, "query_id", "left").where(F.col("bound") + 10.0 ** -SCORE_DIGITS >= F.coalesce("kth", F.lit(0.0)))
        found = first.drop("rank")
        # Written, the few blocks that are left have a size the planner knows; the entries are not shuffled to meet them.
        open_ = spool(open_.select("query_id", "block"), "open")
        if not open_.isEmpty():
            found = found.unionByName(self._scored(near, weights, open_))
        return found

    def search(self, queries: DataFrame | Sequence[str], k: int = 20) -> DataFrame:
        """(query_id, id, score, rank): the k best documents of each query, ties by id; rows of score zero fill up."""
        if not isinstance(queries, DataFrame):
            queries = literal_table(self.spark, list(enumerate(queries)), ["query_id", "text"])
        best = spool(_best(self.matches(queries, k), k), "hits")
        # Of the 2k smallest ids at least k are not among a query's hits.
        kind = f"array<{self.ids.schema['id'].dataType.simpleString()}>"
        smallest = [F.lit(r["id"]) for r in self.ids.orderBy("id").limit(2 * k).collect()]
        fill = queries.select("query_id", F.explode(F.array(*smallest).cast(kind)).alias("id"))
        fill = fill.join(best.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
        return _best(best.drop("rank").unionByName(fill), k).withColumnRenamed("id", self.id_col)


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                docs_per_block: int = DOCS_PER_BLOCK) -> TextIndex:
    """Write the index of (id, text) below `path`, or a fresh folder of the shared one."""
    spark = docs.sparkSession
    path = path or new_path(spark, "text-index")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts.select("id").distinct().write.parquet(f"{path}/ids")
    total = texts.agg(F.count(F.lit(1))).first()[0]
    n_blocks = max(1, -(-total // docs_per_block))
    tasks = max(min(n_blocks, spark.sparkContext.defaultParallelism), -(-n_blocks // BLOCKS_PER_TASK))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    placed = texts.withColumn("block", block).repartition(tasks, "block")
    counts = placed.select("block", "id", F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("block", "id", "term").agg(
        F.count(F.lit(1)).alias("n"))
    idf = F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0
    counts.groupBy("block", "term").agg(F.count(F.lit(1)).alias("holding")).groupBy("term").agg(
        F.sum("holding").alias("df"), F.collect_list("block").alias("blocks")).select("term", "df", idf.alias("idf"), "blocks").write.parquet(
        f"{path}/vocabulary")
    known = spark.read.parquet(f"{path}/vocabulary").select("term", "df", "idf", F.explode("blocks").alias("block")).repartition(tasks, "block")
    # A broadcast would be judged by the packed blocks; both sides lie by block already.
    raw = counts.join(known.hint("merge"), ["block", "term"]).withColumn("raw", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("block", "id")))
    postings = raw.select("block", "id", "term", "df", (F.col("raw") / length).alias("w")).groupBy("term", "block").agg(
        F.max("df").alias("df"), F.max("w").alias("top"), F.sort_array(F.collect_list(F.struct("id", "w"))).alias("entries"))
    before = spark.conf.get(PART_OF_KEY)
    spark.conf.set(PART_OF_KEY, "false")
    try:
        postings.sortWithinPartitions("term", "block").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    finally:
        spark.conf.set(PART_OF_KEY, before)
    return TextIndex(spark, path, id_col)


def open_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> TextIndex:
    """An index written before."""
    return TextIndex(spark, path, id_col)


def as_index(source: DataFrame | TextIndex, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    return source if isinstance(source, TextIndex) else build_index(source, id_col, text_col)
