"""Text ranking by TF-IDF cosine, vector distance, and the fusing of rankings.

Weights follow the usual definition: raw term frequency times
ln((1 + documents) / (1 + document frequency)) + 1, vectors of length one.
Searches go through a stored index (`text_index`), which is made once for a
corpus and then asked any number of times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.keyphrases import keyphrases
from corpusmill.operators.text_index import TextIndex, as_index
from corpusmill.session import spool
from corpusmill.tables import literal_table

SCORE_DIGITS = 6
#: Documents whose words one task of `widened_terms` pairs.
DOCS_PER_TASK = 8192


def _counted(docs: DataFrame, id_col: str, items: Column, outer: bool = False) -> DataFrame:
    explode = F.inline_outer if outer else F.inline
    return docs.select(id_col, explode(tx.run_lengths(items)))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep_empty: bool = False) -> DataFrame:
    """(id, term, n); documents without a term give a null row if `keep_empty`."""
    return _counted(docs, id_col, tx.terms(F.col(text_col)), keep_empty)


def _frequencies(docs: DataFrame, items: Column) -> DataFrame:
    """(term, df): in how many rows each item occurs, combined before the shuffle."""
    return docs.select(F.explode(F.array_distinct(items)).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))


def _idf(total: Column, df: Column) -> Column:
    return F.log((1.0 + total) / (1.0 + df)) + 1.0


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, idf) over the corpus."""
    total = docs.agg(F.count(F.lit(1))).scalar()
    return _frequencies(docs, tx.terms(F.col(text_col))).withColumn("idf", _idf(total, F.col("df")))


def tfidf_vectors(docs: DataFrame | TextIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, w): unit vectors in long form."""
    return as_index(docs, id_col, text_col).vectors


def cosine_scores(docs: DataFrame | TextIndex, queries: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score) of every document for every query, zeros included: as many rows as both together make.

    To rank, search the index instead: it gives the best documents without the others.
    """
    index = as_index(docs, id_col, text_col)
    asked = literal_table(index.spark, list(enumerate(queries)), ["query_id", "text"])
    every = index.ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(len(queries) - 1))).alias("query_id"))
    found = every.join(index.matches(asked), ["query_id", "id"], "left")
    return found.select("query_id", F.col("id").alias(index.id_col), F.coalesce("score", F.lit(0.0)).alias("score"))


def topk_cosine(scores: DataFrame, top_n: int = 20, id_col: str = "doc_id") -> DataFrame:
    """The `top_n` best rows; ties by id; rows of score zero fill up."""
    return scores.orderBy(F.col("score").desc(), id_col).limit(top_n)


def topk_per_query(scores: DataFrame, top_n: int = 20, id_col: str = "doc_id") -> DataFrame:
    """The `top_n` best rows of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def cosine_search(docs: DataFrame | TextIndex, query: str, top_n: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the documents closest to one query, best first; a table is indexed first."""
    index = as_index(docs, id_col, text_col)
    return topk_cosine(index.search([query], top_n).select(index.id_col, "score"), top_n, index.id_col)


def cosine_search_field(fields: DataFrame, field: str, query: str, top_n: int = 20) -> DataFrame:
    """Search one field of a long (doc_id, field, text, url) table; the url is returned too."""
    chosen = fields.where(F.col("field") == field)
    hits = cosine_search(chosen, query, top_n)
    return with_rows(hits, chosen.select("doc_id", "url"))


def with_rows(hits: DataFrame, rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """Attach columns of a large table to ranked hits.

    Hits are bounded by top_n times the number of queries, so they are
    broadcast and the large table is only scanned.
    """
    return rows.join(F.broadcast(hits), on)


def best_score_per_content(hits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: its best score and the id that reached it."""
    best = F.struct(-F.col("score"), F.col(id_col))
    return hits.groupBy(text_col).agg(F.max("score").alias("score"), F.min_by(id_col, best).alias(id_col))


def distinct_content(rows: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Distinct texts, each with its smallest id; only digests of the texts are grouped."""
    first = rows.groupBy(F.sha2(F.col(text_col), 256).alias("digest")).agg(F.min(id_col).alias(id_col))
    found = rows.join(first.select(id_col), id_col, "left_semi").select(text_col, id_col)
    # An id may stand for several texts; of the equal rows that are left one is kept.
    return found.withColumn("digest", F.sha2(F.col(text_col), 256)).join(first, ["digest", id_col], "left_semi").dropDuplicates(
        ["digest", id_col]).select(text_col, id_col)


def union_query_hits(hits: Sequence[DataFrame]) -> DataFrame:
    """Hits of several searches one after the other, repetitions kept."""
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out


def multi_query_search(docs: DataFrame, queries: Sequence[str] | DataFrame, per_query: int = 20, best: int = 10,
                       id_col: str = "doc_id", text_col: str = "text", index: TextIndex | None = None) -> DataFrame:
    """Several queries together: best hits of each, distinct by text, then the best overall. `index` is that of `docs`."""
    found = index or as_index(docs, id_col, text_col)
    texts = with_rows(found.search(queries, per_query), docs.select(id_col, text_col), id_col)
    return topk_cosine(best_score_per_content(texts, id_col, text_col), best, id_col)


def section_search(sections: DataFrame, query: str | Sequence[str], id_col: str = "doc_id", text_col: str = "text",
                   index: TextIndex | None = None) -> DataFrame:
    """Search section texts: the five best for one query, the ten best for several. `index` is that of `sections`."""
    found = index or as_index(sections, id_col, text_col)
    if isinstance(query, str):
        return with_rows(cosine_search(found, query, 5), sections.select(id_col, text_col), id_col)
    return multi_query_search(sections, list(query), 10, 10, id_col, text_col, found)


def widened_terms(index: TextIndex, queries: DataFrame | Sequence[str], per_term: int = 3, least: int = 3) -> DataFrame:
    """(query_id, term, rank, neighbour, score): words that stand in the same documents as the queries' words.

    A pair of words scores by the logarithm of how much oftener its documents coincide than by chance, with half
    a document added to each count, and less the fewer documents it has; `least` are needed. Only the documents of the
    queries' words are looked at, and counts of a pair combine before they are shuffled. Words in fewer than `least`
    documents are left out where the index is read, as no pair with them reaches it.
    """
    if not isinstance(queries, DataFrame):
        queries = literal_table(index.spark, list(enumerate(queries)), ["query_id", "text"])
    vocabulary = index.vocabulary.select("term", "df")
    vectors = index.postings.where(F.col("df") >= least).select("term", F.explode("entries.id").alias("id"))
    asked = spool(queries.select("query_id", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term")).join(vocabulary, "term"), "asked")
    marked = vectors.join(asked.select("term").distinct(), "term")
    total = index.ids.count()
    # As many tasks as there are groups of documents whose words can be sorted in memory.
    tasks = max(index.spark.sparkContext.defaultParallelism, -(-total // DOCS_PER_TASK))
    held = marked.repartition(tasks, "id").groupBy("id").agg(F.collect_list("term").alias("terms"))
    met = vectors.withColumnRenamed("term", "neighbour").join(held.hint("merge"), "id").select(F.explode("terms").alias("term"), "neighbour")
    pairs = met.where("term <> neighbour").groupBy("term", "neighbour").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    known = pairs.join(vocabulary, "term").join(vocabulary.select(F.col("term").alias("neighbour"), F.col("df").alias("df2")), "neighbour")
    chance = F.log((F.col("n") + 0.5) * F.lit(float(total)) / ((F.col("df") + 0.5) * (F.col("df2") + 0.5)))
    scored = known.withColumn("score", F.round(chance * F.col("n") / (F.col("n") + 5.0), SCORE_DIGITS))
    order = Window.partitionBy("term").orderBy(F.col("score").desc(), "neighbour")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_term)
    return asked.select("query_id", "term").join(best.select("term", "rank", "neighbour", "score"), "term").select(
        "query_id", "term", "rank", "neighbour", "score")


def widened_queries(index: TextIndex, queries: Sequence[str], per_term: int = 3, least: int = 3) -> DataFrame:
    """(query_id, text): each query followed by the neighbours of its words, best first."""
    more = widened_terms(index, queries, per_term, least).groupBy("query_id").agg(F.array_sort(F.collect_set(
        F.struct((-F.col("score")).alias("order"), "neighbour"))).alias("more"))
    asked = literal_table(index.spark, list(enumerate(queries)), ["query_id", "text"])
    words = F.transform(F.coalesce("more", F.array().cast("array<struct<order:double,neighbour:string>>")), lambda x: x["neighbour"])
    return asked.join(more, "query_id", "left").select("query_id", F.array_join(F.concat(F.array("text"), F.array_distinct(words)), " ").alias("text"))


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance to a fixed vector, in double precision."""
    target = F.array(*[F.lit(float(x)) for x in query])
    parts = F.zip_with(vector, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def knn_vectors(vectors: DataFrame, queries: Sequence[Sequence[float]], k: int = 5, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors, lowest distance first.

    The query vectors are parameters inside the scan, so there is no join, and
    each task passes on only its own k best per query.
    """
    distances = F.array(*[squared_distance(F.col(vector_col), q) for q in queries])
    scored = vectors.select(id_col, F.posexplode(distances).alias("query_id", "distance")).select(
        "query_id", id_col, F.round("distance", SCORE_DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prefilter_then_rank(docs: DataFrame | TextIndex, query: str, vectors: DataFrame, query_vector: Sequence[float],
                        prefilter: int = 20, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
                        vector_id: str = "vec_id") -> DataFrame:
    """Vector search among the best TF-IDF hits only."""
    hits = cosine_search(docs, query, prefilter, id_col, text_col)
    hits = hits.select(F.col(hits.columns[0]).alias(vector_id))
    return knn_vectors(vectors.join(F.broadcast(hits), vector_id, "left_semi"), [query_vector], k, vector_id)


def fuse_avg_score(first: DataFrame, second: DataFrame, id_col: str = "doc_id", ascending: bool = True) -> DataFrame:
    """Rows in both rankings with the mean of their scores, best first."""
    both = first.withColumnRenamed("score", "s1").join(
        second.select(id_col, F.col("score").alias("s2")), id_col)
    fused = both.withColumn("score", F.round((F.col("s1") + F.col("s2")) / 2, SCORE_DIGITS)).drop("s1", "s2")
    return fused.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), id_col)


def intersect_hits(first: DataFrame, second: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids found by both searches, compared as numbers."""
    as_number = F.col(id_col).try_cast("bigint").alias(id_col)
    return first.select(as_number).intersect(second.select(as_number))


def context_join(hits: DataFrame, questions: str | Sequence[str], most: int = 20, text_col: str = "text") -> DataFrame:
    """One prompt row per query: its own question, and its `most` best texts in rank order, joined by a blank line.

    One question is that of query 0; a list is numbered as the queries were.
    """
    asked = [questions] if isinstance(questions, str) else list(questions)
    hits = hits.where(F.col("rank") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("rank", text_col)))
    joined = F.array_join(F.transform(ordered, lambda x: x[text_col]), "\n\n")
    table = literal_table(hits.sparkSession, list(enumerate(asked)), ["query_id", "question"])
    return hits.groupBy("query_id").agg(joined.alias("context")).join(table, "query_id")


def chunk_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_size: int = 250) -> DataFrame:
    """(id, pos, chunk): texts cut at newlines into chunks of bounded size."""
    return docs.select(id_col, F.posexplode(tx.chunks(F.col(text_col), chunk_size)).alias("pos", "chunk"))


def keyphrases_topk(docs: DataFrame, top: int = 6, max_n: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, rank, phrase, score): the best 1..max_n word phrases of each text, from that text alone."""
    best = keyphrases(F.col(text_col), top, max_n)
    return docs.select(id_col, F.posexplode(best).alias("at", "p")).select(
        id_col, (F.col("at") + 1).alias("rank"), "p.phrase", "p.score")


def vocab_specific(domain: DataFrame, general: DataFrame, text_col: str = "text", min_len: int = 10) -> DataFrame:
    """Words of the domain corpus, `min_len` letters or longer, that the general corpus lacks."""
    def long_words(docs: DataFrame) -> DataFrame:
        found = F.filter(F.array_distinct(tx.words(F.col(text_col))), lambda w: F.length(w) >= min_len)
        return docs.select(F.explode(found).alias("term")).distinct()

    return long_words(domain).join(long_words(general), "term", "left_anti")
