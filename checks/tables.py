"""Source, sink, split and table queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.comprehension import DOMAIN, finished, texts, vocabulary
from checks.mentions import BODY, CROSS, MENTIONS, PROMPT_SQL, flat_mentions, papers, urls
from checks.minutes import CALLS, minutes, sql as minutes_sql
from checks.registry import check
from checks.views import duck, table, view
from corpusmill.operators import comprehension as rc
from corpusmill.operators import mentions as mt
from corpusmill.operators import minutes as mn
from corpusmill.operators import splits as sp
from corpusmill.operators import tables as tb
from corpusmill.session import new_path
from corpusmill.sources import readers, writers

# Titles and texts with all that a quoted cell may hold: line breaks, tabs, quotes and backslashes.
ROUGH = r"""'a "b" \alpha' || chr(9) || 'c\" ' || """


def cell(value):
    """A quoted TSV cell: quotes are doubled."""
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


# -- sources ---------------------------------------------------------------

@check("src_abstracts_tsv", duck("papers", f"""SELECT identifier, title, {ROUGH} description AS description,
  CASE WHEN doc_id % 10 = 5 THEN NULL ELSE category END AS category, CASE WHEN doc_id % 10 = 5 THEN NULL ELSE link END AS link,
  CASE WHEN doc_id % 10 = 5 THEN NULL ELSE creator END AS creator, CASE WHEN doc_id % 10 = 5 THEN NULL ELSE dates END AS dates
FROM papers WHERE doc_id % 10 <> 9"""))
def src_abstracts_tsv(spark, sf_dir):
    # Every tenth line is short and every tenth has a field too many; the reader drops the latter.
    rough = F.concat(F.lit('a "b" \\alpha\tc\\" '), "description")
    rows = papers(spark, sf_dir).select("doc_id", "identifier", cell(F.col("title")).alias("title"),
                                        cell(rough).alias("description"),
                                        *[F.coalesce(c, F.lit("")).alias(c) for c in ("category", "link", "creator", "dates")])
    start = F.concat_ws("\t", "identifier", "title", "description")
    full = F.concat_ws("\t", start, "category", "link", "creator", "dates")
    line = F.when(F.col("doc_id") % 10 == 5, start).when(
        F.col("doc_id") % 10 == 9, F.concat(full, F.lit("\tone more"))).otherwise(full)
    path = new_path(spark, "abstracts")
    # Text files with a header of their own each, as the reader expects.
    head = "\t".join(readers.ABSTRACT_COLUMNS)
    parts = rows.groupBy((F.col("doc_id") % 7).alias("file")).agg(F.concat(
        F.lit(head + "\n"), F.array_join(F.collect_list(line), "\n")).alias("value"))
    parts.write.partitionBy("file").text(path)
    return readers.abstracts_tsv(spark, path)


URL_ROWS = duck("paper_urls", "SELECT identifier, url FROM paper_urls")


def write_urls(spark, sf_dir, header: bool) -> str:
    path = new_path(spark, "urls")
    urls(spark, sf_dir).select("identifier", "url").write.csv(path, sep="\t", header=header, emptyValue="")
    return path


@check("src_url_list", URL_ROWS)
def src_url_list(spark, sf_dir):
    return readers.url_list(spark, write_urls(spark, sf_dir, False))


@check("src_url_list_header", URL_ROWS)
def src_url_list_header(spark, sf_dir):
    return readers.url_list(spark, write_urls(spark, sf_dir, True), header=True)


RAW = f"SELECT identifier, title || chr(10) || {BODY} AS raw_texts FROM papers"


def written_raw_texts(spark, sf_dir) -> str:
    return writers.write_csv(mt.raw_texts(papers(spark, sf_dir)), new_path(spark, "raw_texts"))


@check("src_csv_dataset", duck("papers", RAW))
def src_csv_dataset(spark, sf_dir):
    return readers.csv_dataset(spark, written_raw_texts(spark, sf_dir), "identifier STRING, raw_texts STRING")


@check("sink_csv_raw_texts", duck("papers", f"SELECT identifier, len(raw_texts) AS length, md5(raw_texts) AS digest FROM ({RAW})"))
def sink_csv_raw_texts(spark, sf_dir):
    rows = readers.csv_dataset(spark, written_raw_texts(spark, sf_dir), "identifier STRING, raw_texts STRING")
    return rows.select("identifier", F.length("raw_texts").cast("bigint").alias("length"), F.md5("raw_texts").alias("digest"))


@check("src_mode_switch", duck("url_lists", """SELECT 'dataframe' AS layout, identifier::VARCHAR AS identifier, urls FROM url_lists
UNION ALL SELECT 'base_file', identifier::VARCHAR, urls FROM url_lists"""))
def src_mode_switch(spark, sf_dir):
    lists = view(spark, sf_dir, "url_lists").select(F.col("identifier").cast("string").alias("identifier"), "urls")
    words = F.array(F.lit("k1"), F.lit('k "2"'))
    first = writers.write_csv(lists.select("identifier", F.lit("t\nu").alias("title"), words.alias("keywords"),
                                           F.lit("c").alias("category"), words.alias("mentioned_software"), "urls"),
                              new_path(spark, "frame"))
    second = new_path(spark, "base")
    lists.select(F.lit("0").alias("index"), "identifier", F.col("urls").alias("url")).write.csv(second, sep="\t", header=True)
    return readers.page_inputs(spark, first).select(F.lit("dataframe").alias("layout"), "identifier", "urls").unionByName(
        readers.page_inputs(spark, second, "base_file").select(F.lit("base_file").alias("layout"), "identifier", "urls"))


@check("src_skip_take", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 300 OFFSET 150")
def src_skip_take(spark, sf_dir):
    return tb.skip_take(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 150, 300)


MONTH = """substr('9807121923', CAST(1 + 2 * (CAST(seq AS BIGINT) % 5) AS INT), 2) || '0' || CAST(1 + (CAST(seq AS BIGINT) % 3) AS VARCHAR)"""


def monthly(spark, sf_dir):
    yy = F.substr(F.lit("9807121923"), (1 + 2 * (F.col("seq") % 5)).cast("int"), F.lit(2))
    month = F.concat(yy, F.lit("0"), (1 + F.col("seq") % 3).cast("string"))
    return urls(spark, sf_dir).withColumn("yymm", month)


def month_folder(spark, sf_dir, kind: str = "clean") -> str:
    """URL lists of all months below one folder, each month's path ending in its name."""
    path = new_path(spark, "months")
    name = F.concat(F.lit(f"deep_{kind}_"), "yymm", F.lit(".txt"))
    monthly(spark, sf_dir).select("identifier", "url", name.alias("file")).write.partitionBy("file").csv(
        path, sep="\t", emptyValue="")
    return path


@check("src_glob_partitioned", duck("paper_urls", f"SELECT * FROM (SELECT identifier, url, {MONTH} AS yymm FROM paper_urls) WHERE yymm LIKE '07%'"))
def src_glob_partitioned(spark, sf_dir):
    return readers.months(spark, month_folder(spark, sf_dir), year="07")


def all_months(spark, sf_dir):
    return readers.months(spark, month_folder(spark, sf_dir))


@check("distinct_years", duck("paper_urls", f"""SELECT DISTINCT yy, CASE WHEN yy::INT < 25 THEN '20' ELSE '19' END || yy AS year
FROM (SELECT substr({MONTH}, 1, 2) AS yy FROM paper_urls)"""))
def distinct_years(spark, sf_dir):
    return tb.distinct_years(all_months(spark, sf_dir))


@check("running_rows", duck("paper_urls", f"""SELECT yymm, count(*) AS rows, sum(count(*)) OVER (ORDER BY
  CASE WHEN substr(yymm, 1, 2)::INT < 25 THEN '20' ELSE '19' END || yymm)::BIGINT AS running
FROM (SELECT {MONTH} AS yymm FROM paper_urls) GROUP BY yymm"""))
def running_rows(spark, sf_dir):
    return tb.running_rows(all_months(spark, sf_dir))


@check("union_months", duck("papers paper_urls", f"""SELECT identifier, url, NULL AS title FROM paper_urls
UNION ALL SELECT identifier, NULL, title FROM papers"""))
def union_months(spark, sf_dir):
    listed = all_months(spark, sf_dir).select("identifier", "url")
    return tb.union_months([listed, papers(spark, sf_dir).select("identifier", "title")])


@check("pair_month_files", duck("paper_urls", f"""WITH m AS (SELECT DISTINCT {MONTH} AS yymm FROM paper_urls)
SELECT yymm, CASE WHEN yymm NOT LIKE '98%' THEN 'deep_clean_' || yymm || '.txt' END AS url_file,
  CASE WHEN yymm NOT LIKE '23%' THEN 'deep_metadata_' || yymm || '.txt' END AS metadata_file,
  yymm NOT LIKE '98%' AND yymm NOT LIKE '23%' AS paired FROM m"""))
def pair_month_files(spark, sf_dir):
    # The year 98 has metadata only, the year 23 URL lists only.
    def listing(kind: str, missing: str):
        files = readers.month_files(spark, month_folder(spark, sf_dir, kind), kind)
        return files.where(~F.col("yymm").startswith(missing))

    def name(column: str):
        return F.regexp_extract(column, r"file=([^/]+)/", 1)

    pairs = tb.pair_month_files(listing("clean", "98"), listing("metadata", "23"))
    return pairs.select("yymm", name("url_path").alias("url_file"), name("metadata_path").alias("metadata_file"), "paired")


@check("sink_tsv_merged", duck("paper_urls", f"SELECT identifier, url, seq, {MONTH} AS yymm FROM paper_urls"))
def sink_tsv_merged(spark, sf_dir):
    path = writers.write_tsv_merged(monthly(spark, sf_dir), new_path(spark, "merged"))
    schema = "identifier STRING, url STRING, seq BIGINT, yymm STRING"
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', nullValue="\u0001")
    return rows


@check("src_whole_text", """SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS letters
FROM documents GROUP BY source""")
def src_whole_text(spark, sf_dir):
    # The corpus as many text files of a few documents each, one line per document.
    path = new_path(spark, "texts")
    line = F.concat(F.col("source"), F.lit("\t"), F.replace("text", F.lit("\n"), F.lit(" ")))
    table(spark, sf_dir, "documents").select(line.alias("value")).write.option("maxRecordsPerFile", 25).text(path)
    files = readers.whole_text(spark, path + "/*.txt")
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    rest = F.substr("line", F.length(F.substring_index("line", "\t", 1)) + 2)
    return lines.groupBy(F.substring_index("line", "\t", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length(rest)).alias("letters"))


@check("src_table_scan", duck("paper_urls repos", """SELECT p_partkey AS paper_identifier, 'u' || p_partkey AS url, 'repo' || p_partkey AS repo_name,
  p_name AS repo_description, p_size AS stars, p_brand AS language FROM part"""))
def src_table_scan(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("paper_identifier"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"),
        F.concat(F.lit("repo"), F.col("p_partkey").cast("string")).alias("repo_name"),
        F.col("p_name").alias("repo_description"), F.col("p_size").alias("stars"), F.col("p_brand").alias("language"))
    name = writers.replace_table(part, "software", new_path(spark, "software"))
    return readers.table_scan(spark, name).drop("id", "status")


# -- sinks -----------------------------------------------------------------

def written_prompts(spark, sf_dir):
    path = writers.write_jsonl(mt.prompt_fanout(papers(spark, sf_dir)), new_path(spark, "prompts"))
    return readers.jsonl(spark, path)


@check("sink_jsonl", duck("papers", PROMPT_SQL))
def sink_jsonl(spark, sf_dir):
    return written_prompts(spark, sf_dir)


@check("src_jsonl", duck("papers", f"SELECT source, count(*) AS n FROM ({PROMPT_SQL}) GROUP BY source"))
def src_jsonl(spark, sf_dir):
    return written_prompts(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@check("sink_csv_mentions", duck("papers", MENTIONS))
def sink_csv_mentions(spark, sf_dir):
    path = writers.write_csv(mt.code_mentions(papers(spark, sf_dir)), new_path(spark, "mentions"))
    schema = "title STRING, keywords STRING, category STRING, mentioned_software STRING, urls STRING"
    rows = readers.csv_dataset(spark, path, schema)
    parsed = rows.withColumns({c: F.from_json(c, "array<string>") for c in ("mentioned_software", "urls")})
    return flat_mentions(parsed.withColumn("keywords", F.coalesce("keywords", F.lit(""))))


@check("sink_csv_cross", duck("papers paper_urls", f"WITH {CROSS} SELECT * FROM cross_checked"))
def sink_csv_cross(spark, sf_dir):
    rows = mt.cross_check_mentions(papers(spark, sf_dir), urls(spark, sf_dir))
    path = writers.write_csv(rows, new_path(spark, "cross"))
    schema = "identifier BIGINT, title STRING, keywords STRING, category STRING, mentioned_software STRING, urls STRING"
    back = readers.csv_dataset(spark, path, schema)
    return back.withColumns({
        "mentioned_software": F.array_join(F.from_json("mentioned_software", "array<string>"), "||"),
        "keywords": F.array_join(F.from_json("keywords", "array<string>"), ","),
        "urls": F.coalesce("urls", F.lit(""))})


@check("sink_named_by_options", duck("papers", f"""SELECT 'dataset_raw_texts_astroph1_hess0_skiprows0_maxrows' || count(*) AS name,
  count(*) AS rows FROM papers WHERE category = 'physics:astro-ph'"""))
def sink_named_by_options(spark, sf_dir):
    rows = mt.raw_texts(mt.filter_category(papers(spark, sf_dir)))
    name = writers.option_name("dataset_raw_texts", True, False, 0, rows.count())
    path = writers.write_csv(rows, f"{new_path(spark, 'named')}/{name}")
    back = readers.csv_dataset(spark, path, "identifier STRING, raw_texts STRING", file="file")
    file = F.regexp_extract("file", r"/(dataset_raw_texts[^/]*)/", 1)
    return back.select(file.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


@check("sink_table_replace", minutes_sql("SELECT * EXCLUDE (path) FROM calls WHERE attendees IS NOT NULL", CALLS))
def sink_table_replace(spark, sf_dir):
    # Written twice below one path, other rows first; a write that is refused in between changes nothing.
    calls = mn.operations_call(minutes(spark, sf_dir))
    path = new_path(spark, "calls")
    writers.replace_table(calls.withColumn("aob", F.lit("first")).limit(5), "operations_call", path)
    writers.replace_table(calls, "operations_call", path)
    try:
        writers.replace_table(calls.withColumn("ops_call_date", F.lit(None)), "operations_call", path)
    except ValueError:
        pass
    return readers.table_scan(spark, "operations_call")


@check("check_not_null", duck("repos", """SELECT count(*) FILTER (WHERE description IS NULL) AS description,
  count(*) FILTER (WHERE language IS NULL) AS language, count(*) FILTER (WHERE stars IS NULL) AS stars FROM repos"""))
def check_not_null(spark, sf_dir):
    return tb.check_not_null(view(spark, sf_dir, "repos"), ("description", "language", "stars"))


@check("check_unique_key", duck("paper_urls", "SELECT identifier, count(*) AS n FROM paper_urls GROUP BY identifier HAVING count(*) > 1"))
def check_unique_key(spark, sf_dir):
    return tb.check_unique_key(urls(spark, sf_dir), "identifier")


RC_COLUMNS = "text AS reading_comprehension_texts, question AS reading_comprehension_texts_q, answer AS reading_comprehension_texts_a"


def training_rows(spark, sf_dir):
    rows = rc.reading_comprehension(texts(spark, sf_dir), DOMAIN, vocabulary(spark, sf_dir))
    return rows.select(F.col("text_id").alias("id"), F.col("text").alias("reading_comprehension_texts"),
                       F.col("question").alias("reading_comprehension_texts_q"),
                       F.col("answer").alias("reading_comprehension_texts_a"))


def with_body(select: str) -> str:
    """A select over the finished rows, which are already a statement with CTEs."""
    return f"SELECT {select} FROM ({finished()}) f"


@check("sink_append_columns", with_body(f"text_id AS id, (SELECT len(text) FROM documents WHERE doc_id = text_id) AS raw_length, {RC_COLUMNS}"))
def sink_append_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("bigint").alias("raw_length"))
    path = writers.append_columns(raw, training_rows(spark, sf_dir), "id", new_path(spark, "training"))
    return spark.read.parquet(path)


@check("column_subset_mode", with_body("text_id AS id, replace(text, chr(10), '[NEWLINE]') AS reading_comprehension_texts"))
def column_subset_mode(spark, sf_dir):
    return tb.column_subset_mode(training_rows(spark, sf_dir))


@check("table_preview_widths", duck("repos", """SELECT greatest(max(len(substr(owner, 1, 16))), 5) AS owner, greatest(max(len(substr(repo, 1, 16))), 4) AS repo,
  greatest(max(len(substr(name, 1, 16))), 4) AS name, greatest(max(len(substr(coalesce(description, 'None'), 1, 16))), 11) AS description,
  greatest(max(len(stars::VARCHAR)), 5) AS stars, greatest(max(len(substr(coalesce(language, 'None'), 1, 16))), 8) AS language FROM repos"""), ints="owner repo name description stars language")
def table_preview_widths(spark, sf_dir):
    return tb.table_preview_widths(view(spark, sf_dir, "repos"))


# -- windows, samples, splits ----------------------------------------------

@check("limit_rows", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def limit_rows(spark, sf_dir):
    return tb.limit_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 100)


@check("shuffled_sample", "SELECT doc_id, source FROM documents ORDER BY md5('sample|' || doc_id), doc_id LIMIT 100")
def shuffled_sample(spark, sf_dir):
    return tb.shuffled_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


@check("row_ids", duck("paper_urls", "SELECT row_number() OVER (ORDER BY identifier, seq) AS id, identifier, seq FROM paper_urls"))
def row_ids(spark, sf_dir):
    return tb.row_ids(urls(spark, sf_dir).select("identifier", "seq"), "identifier", "seq")


def placed(salt: str, source: str) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('{salt}|' || doc_id), 1, 8))::BIGINT, doc_id::VARCHAR) - 1 AS place,
  count(*) OVER () AS total FROM {source}"""


@check("split_train_val_test", f"""WITH given AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)),
tested AS ({placed('test', 'given')}),
rest AS ({placed('validation', "(SELECT doc_id, quality FROM tested WHERE place >= ceil(total * 0.2))")})
SELECT doc_id, quality, 'test' AS split FROM tested WHERE place < ceil(total * 0.2)
UNION ALL SELECT doc_id, quality, CASE WHEN place < ceil(total * 0.25) THEN 'validation' ELSE 'train' END FROM rest""")
def split_train_val_test(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return sp.split_train_val_test(rows, "doc_id")


@check("split_train_test", f"SELECT doc_id, CASE WHEN place < ceil(total * 0.35) THEN 'test' ELSE 'train' END AS split FROM ({placed('test', 'documents')})")
def split_train_test(spark, sf_dir):
    return sp.split_train_test(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.35)


@check("shard_round_robin", f"SELECT doc_id, (place * 8 // total)::INT AS shard FROM ({placed('shard', 'documents')})")
def shard_round_robin(spark, sf_dir):
    path = writers.write_splits(sp.shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8),
                                new_path(spark, "shards"), ("shard",))
    return spark.read.schema("doc_id BIGINT, shard INT").parquet(path)
