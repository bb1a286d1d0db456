"""Search queries and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.phrases import keyphrases_sql
from checks.registry import check
from checks.views import duck, table, view
from corpusmill.functions import text as tx
from corpusmill.operators import search
from corpusmill.operators.vector_index import build_vector_index
from corpusmill.operators.text_index import TextIndex, build_index

QUESTION = "the nation of reti and other hableou"
QUESTIONS = [QUESTION, "les eauaux de la mentre avec unknownword", "der enä und erber, das on the shat"]
POINT = [round(math.sin(i + 1) / 8, 4) for i in range(64)]
POINT_2 = [round(math.cos(i + 1) / 8, 4) for i in range(64)]
TERM = r"[\p{L}\p{N}_]{2,}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def asked(questions) -> str:
    rows = ", ".join(f"({i}, {quoted(q)})" for i, q in enumerate(questions))
    return f"(SELECT * FROM (VALUES {rows}) v(query_id, text))"


def tfidf_ctes(source: str, questions=(), idc: str = "doc_id") -> str:
    """tf, idf, w and norms of a source; with questions also `scored` (query_id, id, score)."""
    ctes = f"""
tok AS (SELECT {idc}, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM {source}),
tf AS (SELECT {idc}, term, count(*) AS n FROM tok GROUP BY ALL),
vocab AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + df)) + 1.0 AS idf
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY term)),
raw AS (SELECT {idc}, term, n * idf AS w FROM tf JOIN vocab USING (term)),
norms AS (SELECT {idc}, sqrt(sum(w * w)) AS len FROM raw GROUP BY {idc})"""
    if questions:
        ctes += f""",
qraw AS (SELECT query_id, term, count(*) * any_value(idf) AS w
         FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM {asked(questions)})
         JOIN vocab USING (term) GROUP BY query_id, term),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qlen FROM qraw GROUP BY query_id),
dots AS (SELECT query_id, {idc}, sum(raw.w * qraw.w) AS dot FROM raw JOIN qraw USING (term) GROUP BY ALL),
scored AS (SELECT q.query_id, s.{idc}, round(coalesce(dot / len / qlen, 0.0), 6) AS score
           FROM {source} s CROSS JOIN {asked(questions)} q
           LEFT JOIN dots d ON d.query_id = q.query_id AND d.{idc} = s.{idc}
           LEFT JOIN norms n ON n.{idc} = s.{idc} LEFT JOIN qn ON qn.query_id = q.query_id)"""
    return ctes


def ranked(n: int, idc: str = "doc_id") -> str:
    return (f"SELECT query_id, {idc}, score, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY score DESC, {idc}) AS rank FROM scored QUALIFY rank <= {n}")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", True)


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def index(spark, sf_dir):
    """The stored index of the documents, written once for a session and asked by all queries."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _INDEXES:
        _INDEXES[key] = build_index(table(spark, sf_dir, "documents"))
    return _INDEXES[key]


@check("document_frequency", f"WITH {tfidf_ctes('documents')} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def document_frequency(spark, sf_dir):
    return search.document_frequency(docs(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@check("tfidf_vectors", f"WITH {tfidf_ctes('documents')} "
       "SELECT doc_id, term, round(w / len, 6) AS w FROM raw JOIN norms USING (doc_id)")
def tfidf_vectors(spark, sf_dir):
    return search.tfidf_vectors(index(spark, sf_dir)).withColumn("w", F.round("w", 6))


@check("cosine_search", f"WITH {tfidf_ctes('documents', [QUESTION])} "
       "SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def cosine_search(spark, sf_dir):
    return search.cosine_search(index(spark, sf_dir), QUESTION)


@check("topk_cosine", f"WITH {tfidf_ctes('documents', ['gammapy'])} "
       "SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 10")
def topk_cosine(spark, sf_dir):
    scores = search.cosine_scores(index(spark, sf_dir), ["gammapy"]).select("doc_id", "score")
    return search.topk_cosine(scores, 10)


@check("topk_per_query", f"WITH {tfidf_ctes('documents', QUESTIONS)} {ranked(20)}", ints="rank")
def topk_per_query(spark, sf_dir):
    return index(spark, sf_dir).search(QUESTIONS, 20)


@check("benchmark_search", f"""WITH {tfidf_ctes('documents')},
asked AS (SELECT item_id AS query_id, text FROM benchmark),
qraw AS (SELECT query_id, term, count(*) * any_value(idf) AS w
         FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM asked) JOIN vocab USING (term) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qlen FROM qraw GROUP BY query_id),
dots AS (SELECT query_id, doc_id, sum(raw.w * qraw.w) AS dot FROM raw JOIN qraw USING (term) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(dot / len / qlen, 6) AS score FROM dots JOIN norms USING (doc_id) JOIN qn USING (query_id))
{ranked(10)}""", ints="rank")
def benchmark_search(spark, sf_dir):
    """Every benchmark item is a query; each shares a word with ten documents at least."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index(spark, sf_dir).search(asked, 10)


@check("query_terms_widened", f"""WITH {tfidf_ctes('documents')},
asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM {asked(QUESTIONS)}),
pairs AS (SELECT a.term, b.term AS neighbour, count(*) AS n FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND a.term <> b.term
          WHERE a.term IN (SELECT term FROM asked) GROUP BY a.term, b.term HAVING count(*) >= 3),
scored AS (SELECT p.term, neighbour, round(ln((n + 0.5) * (SELECT count(*) FROM documents) / ((v.df + 0.5) * (u.df + 0.5))) * n / (n + 5.0), 6) AS score
           FROM pairs p JOIN vocab v ON v.term = p.term JOIN vocab u ON u.term = neighbour),
best AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, neighbour) AS rank FROM scored QUALIFY rank <= 3)
SELECT query_id, term, rank, neighbour, score FROM asked JOIN best USING (term)""", ints="query_id rank")
def query_terms_widened(spark, sf_dir):
    return search.widened_terms(index(spark, sf_dir), QUESTIONS)


@check("union_query_hits", f"WITH {tfidf_ctes('documents', QUESTIONS)}, r AS ({ranked(20)}) "
       "SELECT doc_id, score FROM r")
def union_query_hits(spark, sf_dir):
    return search.union_query_hits([search.cosine_search(index(spark, sf_dir), q, 20) for q in QUESTIONS])


BEST = "SELECT text, max(score) AS score, arg_min(doc_id, (-score, doc_id)) AS doc_id FROM hits GROUP BY text"


@check("best_score_per_content", f"WITH {tfidf_ctes('documents', QUESTIONS)}, r AS ({ranked(20)}), "
       f"hits AS (SELECT r.*, text FROM r JOIN documents USING (doc_id)) {BEST}")
def best_score_per_content(spark, sf_dir):
    corpus = docs(spark, sf_dir)
    hits = index(spark, sf_dir).search(QUESTIONS, 20)
    return search.best_score_per_content(search.with_rows(hits, corpus.select("doc_id", "text")))


@check("distinct_content", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_content(spark, sf_dir):
    return search.distinct_content(docs(spark, sf_dir))


@check("multi_query_top10", f"WITH {tfidf_ctes('documents', QUESTIONS)}, r AS ({ranked(20)}), "
       f"hits AS (SELECT r.*, text FROM r JOIN documents USING (doc_id)), b AS ({BEST}) "
       "SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 10")
def multi_query_top10(spark, sf_dir):
    return search.multi_query_search(docs(spark, sf_dir), QUESTIONS, index=index(spark, sf_dir))


FIELDS_SQL = """fields AS (
  SELECT doc_id, 'paper_title' AS field, title AS text, CAST(NULL AS VARCHAR) AS url FROM papers
  UNION ALL SELECT doc_id, 'paper_keywords', source || ' ' || lang, NULL FROM documents
  UNION ALL SELECT p_partkey, 'repo_name', 'repo' || p_partkey, 'https://github.example.org/repo' || p_partkey FROM part
  UNION ALL SELECT p_partkey, 'repo_description', p_name, 'https://github.example.org/repo' || p_partkey FROM part),
chosen AS (SELECT * FROM fields WHERE field = 'FIELD')"""


def fields(spark, sf_dir):
    papers = view(spark, sf_dir, "papers").select(
        "doc_id", F.lit("paper_title").alias("field"), F.col("title").alias("text"),
        F.lit(None).cast("string").alias("url"))
    keywords = docs(spark, sf_dir).select(
        "doc_id", F.lit("paper_keywords").alias("field"), F.concat_ws(" ", "source", "lang").alias("text"),
        F.lit(None).cast("string").alias("url"))
    part = table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://github.example.org/repo"), F.col("p_partkey").cast("string")).alias("url")
    names = part.select(F.col("p_partkey").alias("doc_id"), F.lit("repo_name").alias("field"),
                        F.concat(F.lit("repo"), F.col("p_partkey").cast("string")).alias("text"), url)
    described = part.select(F.col("p_partkey").alias("doc_id"), F.lit("repo_description").alias("field"),
                            F.col("p_name").alias("text"), url)
    return papers.unionByName(keywords).unionByName(names).unionByName(described)


@check("cosine_search_field", duck("papers", f"""WITH {FIELDS_SQL.replace('FIELD', 'repo_description')},
{tfidf_ctes('chosen', ['small red ring'])},
top AS (SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, url, score FROM top JOIN chosen USING (doc_id)"""))
def cosine_search_field(spark, sf_dir):
    return search.cosine_search_field(fields(spark, sf_dir), "repo_description", "small red ring")


@check("intersect_hits", duck("papers", f"""WITH
a AS (WITH {FIELDS_SQL.replace('FIELD', 'paper_title')}, {tfidf_ctes('chosen', [QUESTION])}
      SELECT doc_id FROM scored ORDER BY score DESC, doc_id LIMIT 60),
b AS (WITH {FIELDS_SQL.replace('FIELD', 'paper_keywords')}, {tfidf_ctes('chosen', ['src1 src2 en'])}
      SELECT doc_id FROM scored ORDER BY score DESC, doc_id LIMIT 60)
SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b"""))
def intersect_hits(spark, sf_dir):
    rows = fields(spark, sf_dir)
    titles = search.cosine_search_field(rows, "paper_title", QUESTION, 60)
    keywords = search.cosine_search_field(rows, "paper_keywords", "src1 src2 en", 60)
    return search.intersect_hits(titles, keywords)


SECTIONS = "(SELECT conv_id * 100 + turn AS doc_id, text FROM conversations)"


def sections(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")


@check("section_search", f"WITH sec AS {SECTIONS}, {tfidf_ctes('sec', QUESTIONS)}, r AS ({ranked(10)}), "
       f"hits AS (SELECT r.*, text FROM r JOIN sec USING (doc_id)), b AS ({BEST}) "
       "SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 10")
def section_search(spark, sf_dir):
    return search.section_search(sections(spark, sf_dir), QUESTIONS)


@check("section_search_single", f"WITH sec AS {SECTIONS}, {tfidf_ctes('sec', [QUESTION])}, r AS ({ranked(5)}) "
       "SELECT doc_id, text, score FROM r JOIN sec USING (doc_id)")
def section_search_single(spark, sf_dir):
    return search.section_search(sections(spark, sf_dir), QUESTION)


def knn_sql(source: str, points, k: int) -> str:
    asked_points = " UNION ALL ".join(f"SELECT {i} AS query_id, {list(p)}::DOUBLE[] AS q" for i, p in enumerate(points))
    return f"""SELECT query_id, vec_id, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank
FROM (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(q) + 1),
          lambda i: (embedding[i]::DOUBLE - q[i]) * (embedding[i]::DOUBLE - q[i]))), 6) AS score
      FROM {source} CROSS JOIN ({asked_points})) QUALIFY rank <= {k}"""


@check("knn_vectors", knn_sql("embeddings", [POINT, POINT_2], 5), ints="rank")
def knn_vectors(spark, sf_dir):
    stored = build_vector_index(table(spark, sf_dir, "embeddings"))
    return stored.search(spark.createDataFrame([(0, POINT), (1, POINT_2)], "query_id int, vector array<double>"))


@check("prefilter_then_rank", f"WITH {tfidf_ctes('documents', [QUESTION])}, "
       "pre AS (SELECT doc_id FROM scored ORDER BY score DESC, doc_id LIMIT 20) "
       + knn_sql("(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM pre))", [POINT], 5), ints="rank")
def prefilter_then_rank(spark, sf_dir):
    return search.prefilter_then_rank(index(spark, sf_dir), QUESTION, table(spark, sf_dir, "embeddings"), POINT)


@check("fuse_avg_score", f"""WITH a AS ({knn_sql('embeddings', [POINT], 50)}), b AS ({knn_sql('embeddings', [POINT_2], 50)})
SELECT vec_id, round((a.score + b.score) / 2, 6) AS score FROM a JOIN b USING (vec_id)""")
def fuse_avg_score(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = search.knn_vectors(vectors, [POINT], 50).select("vec_id", "score")
    second = search.knn_vectors(vectors, [POINT_2], 50).select("vec_id", "score")
    return search.fuse_avg_score(first, second, "vec_id")


@check("context_join", f"""WITH {tfidf_ctes('documents', QUESTIONS)}, r AS ({ranked(5)})
SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, CASE query_id {' '.join(f'WHEN {i} THEN {quoted(q)}' for i, q in enumerate(QUESTIONS))} END AS question
FROM r JOIN documents USING (doc_id) GROUP BY query_id""")
def context_join(spark, sf_dir):
    corpus = docs(spark, sf_dir)
    hits = index(spark, sf_dir).search(QUESTIONS, 5)
    return search.context_join(search.with_rows(hits, corpus.select("doc_id", "text")), QUESTIONS)


# One recursion-free spelling of the greedy merge: fold pieces into a list of chunks.
CHUNKS = """SELECT doc_id, pos - 1 AS pos, chunk FROM (
  SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS pos FROM (
    SELECT doc_id, list_filter(list_transform(folded, lambda c: trim(c, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda c: c <> '') AS chunks
    FROM (SELECT doc_id, list_reduce(
              list_transform(list_filter(string_split(text, chr(10)), lambda p: p <> ''), lambda p: [p]),
              lambda acc, p: CASE WHEN length(acc[-1]) + 1 + length(p[1]) <= SIZE
                  THEN list_append(acc[:-2], acc[-1] || chr(10) || p[1]) ELSE list_append(acc, p[1]) END, CAST([] AS VARCHAR[])) AS folded
          FROM documents)))"""
CHUNKS = CHUNKS.replace(", CAST([] AS VARCHAR[])) AS folded", ") AS folded").replace("SIZE", "250")


@check("chunk_text", CHUNKS, ints="pos")
def chunk_text(spark, sf_dir):
    return search.chunk_text(docs(spark, sf_dir))


@check("keyphrases_topk", f"WITH {keyphrases_sql('text', 'documents', 'doc_id')} SELECT doc_id, phrase, score, rank FROM best", ints="rank")
def keyphrases_topk(spark, sf_dir):
    return search.keyphrases_topk(docs(spark, sf_dir))


@check("vocab_specific", """WITH w AS (SELECT lang = 'en' AS dom, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents)
SELECT DISTINCT term FROM w WHERE dom AND length(term) >= 10
EXCEPT SELECT term FROM w WHERE NOT dom""")
def vocab_specific(spark, sf_dir):
    corpus = docs(spark, sf_dir)
    return search.vocab_specific(corpus.where("lang = 'en'"), corpus.where("lang <> 'en'"))


@check("clean_query_list", r"""SELECT item_id, array_to_string(list_transform(
    regexp_split_to_array(text, ',|, |\n|,\n'), lambda p: trim(regexp_replace(p, '[^a-zA-Z\s]', ' ', 'g'),
        ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '|') AS queries FROM benchmark""")
def clean_query_list(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.array_join(tx.clean_query_list(F.col("text")), "|").alias("queries"))
