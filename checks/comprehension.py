"""Reading-comprehension queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.mentions import sql_text
from checks.registry import check
from checks.views import duck, table, view
from corpusmill.functions import mining as mx
from corpusmill.functions import sentences as sn
from corpusmill.functions import text as tx
from corpusmill.operators import comprehension as rc
from corpusmill.operators.search import vocab_specific
from corpusmill.session import spool
from corpusmill.templates import DEMOS, FRAMES, INTROS, OPTIONS

DOMAIN = "spectroscopy"
WORD = r"[\p{L}\p{N}_]+"
STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def h32(salt: str, key: str = "text_id") -> str:
    return f"('0x' || substr(md5('{salt}|' || {key}), 1, 8))::BIGINT"


def strip(expr: str) -> str:
    return f"trim({expr}, {STRIP})"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SENTENCES = rf"""pcs AS (SELECT text_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
        FROM (SELECT text_id, regexp_extract_all(body, {quoted(sn.PIECE)}) AS p FROM bod)),
around AS (SELECT *, regexp_extract(piece, {quoted(sn.LAST_WORD)}, 1) AS word, lead(piece) OVER (PARTITION BY text_id ORDER BY i) AS following,
           sum(len(regexp_replace(piece, '[^(\[]', '', 'g')) - len(regexp_replace(piece, '[^)\]]', '', 'g'))) OVER (PARTITION BY text_id ORDER BY i) AS depth
           FROM pcs),
ended AS (SELECT *, NOT (NOT regexp_matches(piece, '\s$') OR (NOT regexp_matches(piece, {quoted(sn.BLANK_LINE)}) AND (
            length(word) = 1 OR lower(word) IN ABBREVIATIONS
            OR (regexp_matches(piece, {quoted(sn.TRAILS)}) AND regexp_matches(following, {quoted(sn.GOES_ON)}))
            OR (depth > 0 AND regexp_matches(following, '[)\]]'))))) AS ends FROM around),
cut AS (SELECT text_id, piece, i, coalesce(sum(ends::INT) OVER (PARTITION BY text_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ended),
whole AS (SELECT text_id, g, string_agg(piece, '' ORDER BY i) AS sentence FROM cut GROUP BY text_id, g),
lists AS (SELECT text_id, list(sentence ORDER BY g) AS sents FROM whole GROUP BY text_id),
sent AS (SELECT text_id, title, body, coalesce(sents, []) AS sents FROM bod LEFT JOIN lists USING (text_id))"""

LEARNT = rf"""tok AS (SELECT unnest(regexp_extract_all(lower(body), '{sn.WORD_AND_DOT}')) AS token FROM bod),
wc AS (SELECT rtrim(token, '.') AS word, count(*) AS n, count(*) FILTER (suffix(token, '.')) AS k FROM tok GROUP BY 1),
chance AS (SELECT sum(k) / sum(n) AS c FROM wc),
weighed AS (SELECT word, -2 * ((k * ln(c) + (n - k) * ln(1 - c)) - (k * ln(0.99) + (n - k) * ln(1 - 0.99))) * exp(-length(word))
            * pow(length(word), -(n - k)) AS score FROM wc, chance WHERE k >= {sn.LEAST_SEEN}),
learnt AS (SELECT word FROM weighed WHERE score >= {sn.LEAST_SCORE} AND length(word) BETWEEN 2 AND {sn.LONGEST}
           ORDER BY score DESC, word LIMIT {sn.MOST})"""


def body(max_tokens: int | None = None) -> str:
    if max_tokens is None:
        return f"""base AS (SELECT text_id, side, split_part(text, chr(10), 1) AS title, substr(text, len(split_part(text, chr(10), 1)) + 2) AS full_body FROM connected),
bod AS (SELECT text_id, title, full_body AS body FROM base),
{SENTENCES.replace('ABBREVIATIONS', "('-')")}"""
    return f"""base AS (SELECT text_id, side, split_part(text, chr(10), 1) AS title, substr(text, len(split_part(text, chr(10), 1)) + 2) AS full_body FROM connected),
bod AS (SELECT text_id, title, CASE WHEN len(p) > {max_tokens} THEN regexp_extract(full_body, '^\\s*') || array_to_string(p[1:{max_tokens}], '') ELSE full_body END AS body
        FROM (SELECT *, regexp_extract_all(full_body, '\\S+\\s*') AS p FROM base)),
{SENTENCES.replace('ABBREVIATIONS', "('-')")}"""


def rule_sql(rule: mx.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    group = {name: f"unnest(regexp_extract_all(body, '{pattern}', {i}))" for name, i in
             (("verbalizer", 4), ("s1", 2), ("s2", 6))}
    return (f"SELECT text_id, '{rule.task}' AS task, '{rule.label}' AS label, "
            f"generate_subscripts(regexp_extract_all(body, '{pattern}', 0), 1) - 1 AS pos, "
            + ", ".join(f"{sql} AS {name}" for name, sql in group.items()) + " FROM bod")


MINED = "mined AS (" + "\nUNION ALL ".join(rule_sql(r) for r in mx.RULES) + ")"
CAPPED = """pat AS (SELECT * FROM mined QUALIFY row_number() OVER (PARTITION BY text_id, task, label
  ORDER BY md5('cap|' || text_id || '|' || task || '|' || label || '|' || pos)) <= 2)"""
WORDS = rf"""vw AS (SELECT side, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM connected),
vocab AS (SELECT DISTINCT term FROM vw WHERE side = 'domain' AND length(term) >= 10 EXCEPT SELECT term FROM vw WHERE side = 'general'),
ss AS (SELECT text_id, pos, sentence, list_distinct(regexp_extract_all(lower(sentence), '{WORD}')) AS ws
       FROM (SELECT text_id, unnest(sents) AS sentence, generate_subscripts(sents, 1) - 1 AS pos FROM sent)),
qual AS (SELECT text_id, pos, list_sort(list(term)) AS words FROM (SELECT text_id, pos, unnest(ws) AS term FROM ss WHERE len(ws) <= 100)
         WHERE term IN (SELECT term FROM vocab) GROUP BY text_id, pos HAVING count(*) >= 3),
capq AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY md5('sent|' || text_id || '|' || pos)) AS rank
         FROM qual QUALIFY rank <= 2),
w2t AS (SELECT text_id, 'word2text' AS task, 'word2text' AS label, pos, CAST(NULL AS VARCHAR) AS verbalizer,
               array_to_string(words[1:3], ', ') AS s1, {strip('sentence')} AS s2 FROM capq JOIN ss USING (text_id, pos))"""
EXAMPLES = f"{body()}, {MINED}, {CAPPED}, {WORDS}, ex AS (SELECT * FROM pat UNION ALL SELECT * FROM w2t)"
VARIANT = f"CASE WHEN {h32('variant')} % 10 < 2 THEN 'generate' ELSE 'classify' END"


def template_rows() -> str:
    groups: dict[tuple, list] = {}
    for task, label, variant, q, a in DEMOS:
        groups.setdefault((task, label, variant), []).append((q, a))
    rows = [f"('{t}', '{lab}', '{v}', {i}, {len(g)}, {sql_text(q)}, {sql_text(a)})"
            for (t, lab, v), g in groups.items() for i, (q, a) in enumerate(g)]
    return "tpl AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(ttask, tlabel, variant, idx, n, q, a))"


CHOSEN = f"""{template_rows()},
chosen AS (SELECT ex.*, idx, q, a FROM ex JOIN tpl ON ttask = task AND (tlabel = '*' OR tlabel = label)
  AND (variant = '' OR variant = {VARIANT}) AND idx = {h32('template')} % n)"""


def nli_answer(i: int) -> str:
    return ("CASE label " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in mx.ANSWERS.items()) + " END")


SECOND = "upper(substr(s2, 1, 1)) || substr(s2, 2)"
SLOTS = {
    "nli": {"premise": "s1", "hypothesis": SECOND, "options_": sql_text(OPTIONS), "verbalizer": "verbalizer",
            "answer": nli_answer(0), "connect_answer": nli_answer(1), "relation_answer": nli_answer(2)},
    "common_reason": {"cause": f"CASE WHEN label = 'Cause-effect' THEN s1 ELSE {SECOND} END",
                      "effect": f"CASE WHEN label = 'Cause-effect' THEN {SECOND} ELSE s1 END"},
    "paraphrase": {"sentence1": "s1", "sentence2": SECOND, "verbalizer": "verbalizer"},
    "word2text": {"domain": f"'{DOMAIN}'", "tripleset": "s1", "target": strip("s2"), "word": "s1", "definition": "s2",
                  "sentence": "s1", "topic": "s2"},
}


def replaced(text: str, slots: dict[str, str]) -> str:
    for name, value in slots.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


FILLED = CHOSEN + ", filled AS (" + " UNION ALL ".join(
    f"SELECT text_id, task, label, pos, {replaced('q', s)} AS question, {replaced('a', s)} AS answer "
    f"FROM chosen WHERE task = '{t}'" for t, s in SLOTS.items()) + ")"

TASK_ORDER = "CASE task " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(mx.TASKS)) + " END"
LABELS = [r.label for r in mx.RULES] + ["word2text"]
LABEL_ORDER = "CASE label " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(LABELS)) + " END"
CAP_KEY = ("CASE WHEN label = 'word2text' THEN md5('sent|' || text_id || '|' || pos) "
           "ELSE md5('cap|' || text_id || '|' || task || '|' || label || '|' || pos) END")
ORDER = f"{TASK_ORDER}, {LABEL_ORDER}, {CAP_KEY}"
INTRO = "[" + ", ".join(sql_text(i.replace("{domain}", DOMAIN)) for i in INTROS) + f"][({h32('intro')} % {len(INTROS)}) + 1]"
NL2 = "chr(10) || chr(10)"
DEMO = f"""{FILLED},
per_task AS (SELECT text_id, task, string_agg(question || ' ' || answer, {NL2} ORDER BY {ORDER}) AS d FROM filled GROUP BY text_id, task),
qa AS (SELECT text_id, string_agg(d, {NL2} ORDER BY md5('order|' || text_id || '|' || task)) AS qa_demos FROM per_task GROUP BY text_id),
sep AS (SELECT text_id, string_agg(question, {NL2} ORDER BY {ORDER}) AS q_demos, string_agg(answer, {NL2} ORDER BY {ORDER}) AS a_demos FROM filled GROUP BY text_id),
demos AS (SELECT s.text_id, CASE WHEN qa_demos IS NULL THEN '' ELSE {INTRO.replace('text_id', 's.text_id')} || qa_demos END AS qa_demos,
  CASE WHEN q_demos IS NULL THEN '' ELSE {INTRO.replace('text_id', 's.text_id')} || q_demos END AS q_demos, coalesce(a_demos, '') AS a_demos
  FROM sent s LEFT JOIN qa ON qa.text_id = s.text_id LEFT JOIN sep ON sep.text_id = s.text_id)"""

U = h32("mix") + " % 1000"
MODE = f"""modes AS (SELECT *, len(sents) >= 2 AS can_complete, CASE WHEN len(sents) >= 2 THEN
    CASE WHEN {U} < 400 THEN 'summarize' WHEN {U} < 500 THEN 'text_completion' WHEN {U} < 900 THEN 'both' ELSE 'neither' END
  ELSE CASE WHEN {U} < 500 THEN 'summarize' ELSE 'neither' END END AS mode,
  CASE WHEN len(sents) >= 2 THEN 1 + {h32('cut')} % (len(sents) - 1) END AS cut FROM sent)"""
FIRST = strip("array_to_string(sents[1:coalesce(cut, 1)], '')")
LAST = strip("array_to_string(sents[coalesce(cut, 1) + 1:], '')")
WHOLE = strip("array_to_string(sents, '')")


def frame(form: str, part: int) -> str:
    cases = []
    slots = {"context_wo_title": WHOLE, "title": "title", "domain": f"'{DOMAIN}'",
             "context_1st_half": f"CASE WHEN mode = 'text_completion' THEN title || chr(10) || {FIRST} ELSE {FIRST} END",
             "context_2nd_half": LAST, "context": f"title || chr(10) || {WHOLE}",
             "qa_demos": "qa_demos", "q_demos": "q_demos", "a_demos": "a_demos"}
    for mode in dict.fromkeys(r[0] for r in FRAMES):
        rows = [r[2 + part] for r in FRAMES if r[0] == mode and r[1] == form]
        listed = "[" + ", ".join(sql_text(r) for r in rows) + f"][({h32('template')} % {len(rows)}) + 1]"
        used = {k: v for k, v in slots.items() if any("{" + k + "}" in r for r in rows)}
        cases.append(f"WHEN '{mode}' THEN {replaced(listed, used)}")
    return "regexp_replace(CASE mode " + " ".join(cases) + " END, ' {2,}', ' ', 'g')"


def finished(where: str = "") -> str:
    return sql(f"""SELECT text_id, mode, {frame('single', 0)} AS text, {frame('qa', 0)} AS question, {frame('qa', 1)} AS answer,
  'input, line_' || text_id AS file_name FROM modes JOIN demos USING (text_id) {where}""", f"{EXAMPLES}, {DEMO}, {MODE}")


def sql(select: str, ctes: str | None = None) -> str:
    return duck("connected", f"WITH {ctes or body()} {select}")


def texts(spark, sf_dir):
    return view(spark, sf_dir, "connected")


def vocabulary(spark, sf_dir):
    rows = texts(spark, sf_dir)
    return spool(vocab_specific(rows.where("side = 'domain'"), rows.where("side = 'general'")), "words")


def examples(spark, sf_dir):
    return rc.with_examples(texts(spark, sf_dir), vocabulary(spark, sf_dir))


@check("split_title_body", sql("SELECT text_id, title, full_body AS body FROM base"))
def split_title_body(spark, sf_dir):
    return rc.split_title_body(texts(spark, sf_dir))


@check("truncate_tokens", sql("SELECT text_id, title, body FROM bod", body(120)))
def truncate_tokens(spark, sf_dir):
    return rc.truncate_tokens(texts(spark, sf_dir), 120)


@check("sentences", duck("prose", f"""WITH bod AS (SELECT text_id, split_part(text, chr(10), 1) AS title, substr(text, len(split_part(text, chr(10), 1)) + 2) AS body FROM prose),
{LEARNT}, {SENTENCES.replace("ABBREVIATIONS", "(SELECT word FROM learnt)")}
SELECT text_id, unnest(sents) AS sentence, generate_subscripts(sents, 1) - 1 AS pos FROM sent"""), ints="pos")
def sentences(spark, sf_dir):
    prose = view(spark, sf_dir, "prose")
    return rc.sentences(prose, abbreviations=sn.learn_abbreviations(rc.split_title_body(prose), "body"))


@check("abbreviation_scores", duck("prose", f"""WITH bod AS (SELECT substr(text, len(split_part(text, chr(10), 1)) + 2) AS body FROM prose),
{LEARNT} SELECT word, round(score, 6) AS score FROM weighed"""))
def abbreviation_scores(spark, sf_dir):
    bodies = rc.split_title_body(view(spark, sf_dir, "prose"))
    return sn.abbreviation_scores(bodies, "body").select("word", F.round("score", 6).alias("score"))


def _mine(name: str, task: str) -> None:
    @check(name, sql(f"SELECT * FROM mined WHERE task = '{task}'", f"{body()}, {MINED}"), ints="pos")
    def query(spark, sf_dir):
        return rc.mine(texts(spark, sf_dir), (task,))


for _name, _task in (("mine_nli", "nli"), ("mine_common_reason", "common_reason"), ("mine_paraphrase", "paraphrase"),
                     ("mine_definition_topic", "word2text")):
    _mine(_name, _task)


@check("cap_per_subcategory", sql("SELECT * FROM pat", f"{body()}, {MINED}, {CAPPED}"), ints="pos")
def cap_per_subcategory(spark, sf_dir):
    return rc.cap_per_subcategory(rc.mine(texts(spark, sf_dir)))


@check("mined_counts", sql("SELECT text_id, task, count(*) AS n FROM mined GROUP BY ALL", f"{body()}, {MINED}"))
def mined_counts(spark, sf_dir):
    return rc.mined_counts(rc.mine(texts(spark, sf_dir)))


@check("mine_word2text", sql("SELECT * FROM w2t", f"{body()}, {WORDS}"), ints="pos")
def mine_word2text(spark, sf_dir):
    return rc.mine_word2text(texts(spark, sf_dir), vocabulary(spark, sf_dir))


@check("cap_sentences", sql("SELECT text_id, pos, array_to_string(words, ',') AS words, rank FROM capq", f"{body()}, {WORDS}"), ints="pos rank")
def cap_sentences(spark, sf_dir):
    qualified = rc.qualified_sentences(texts(spark, sf_dir), vocabulary(spark, sf_dir))
    return rc.cap_sentences(qualified).withColumn("words", F.array_join("words", ","))


@check("eligible_summarize", sql("SELECT text_id, title IS NOT NULL AS can_summarize FROM modes", f"{body()}, {MODE}"))
def eligible_summarize(spark, sf_dir):
    return rc.task_mix(texts(spark, sf_dir)).select("text_id", "can_summarize")


@check("eligible_completion", sql("SELECT text_id, can_complete FROM modes", f"{body()}, {MODE}"))
def eligible_completion(spark, sf_dir):
    return rc.task_mix(texts(spark, sf_dir)).select("text_id", "can_complete")


@check("task_mix", sql("SELECT text_id, title IS NOT NULL AS can_summarize, can_complete, mode FROM modes", f"{body()}, {MODE}"))
def task_mix(spark, sf_dir):
    return rc.task_mix(texts(spark, sf_dir))


@check("cut_point", sql(f"SELECT text_id, cut, {FIRST} AS first_half, {LAST} AS second_half FROM modes WHERE cut IS NOT NULL",
                        f"{body()}, {MODE}"), ints="cut")
def cut_point(spark, sf_dir):
    return rc.cut_point(texts(spark, sf_dir))


@check("nli_variant", duck("", f"SELECT doc_id, {VARIANT.replace('text_id', 'doc_id')} AS variant FROM documents"))
def nli_variant(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", mx.nli_variant(F.col("doc_id")).alias("variant"))


@check("choose_template", sql("SELECT text_id, task, label, pos, idx, q AS question, a AS answer FROM chosen", f"{EXAMPLES}, {CHOSEN}"), ints="pos")
def choose_template(spark, sf_dir):
    return rc.choose_template(examples(spark, sf_dir))


@check("answer_map", sql(f"SELECT text_id, label, pos, {nli_answer(0)} AS answer, {nli_answer(1)} AS connect_answer, "
                         f"{nli_answer(2)} AS relation_answer FROM ex WHERE task = 'nli'", EXAMPLES), ints="pos")
def answer_map(spark, sf_dir):
    return rc.answer_map(examples(spark, sf_dir))


@check("cause_effect_slots", sql(f"SELECT text_id, label, pos, {SLOTS['common_reason']['cause']} AS cause, "
                                 f"{SLOTS['common_reason']['effect']} AS effect FROM ex WHERE task = 'common_reason'", EXAMPLES), ints="pos")
def cause_effect_slots(spark, sf_dir):
    return rc.cause_effect_slots(examples(spark, sf_dir))


@check("word2text_slots", sql("SELECT text_id, pos, s1 AS tripleset, s2 AS target FROM w2t", f"{body()}, {WORDS}"), ints="pos")
def word2text_slots(spark, sf_dir):
    return rc.word2text_slots(examples(spark, sf_dir))


@check("fill_template", sql("SELECT text_id, task, label, pos, question || ' ' || answer AS demo FROM filled", f"{EXAMPLES}, {FILLED}"), ints="pos")
def fill_template(spark, sf_dir):
    return rc.fill_template(examples(spark, sf_dir), DOMAIN)


@check("fill_template_qa", sql("SELECT * FROM filled", f"{EXAMPLES}, {FILLED}"), ints="pos")
def fill_template_qa(spark, sf_dir):
    return rc.fill_template_qa(examples(spark, sf_dir), DOMAIN)


@check("assemble_demos", sql("SELECT * FROM demos", f"{EXAMPLES}, {DEMO}"))
def assemble_demos(spark, sf_dir):
    return rc.assemble_demos(examples(spark, sf_dir), DOMAIN)


USAGE = f"""SELECT text_id, task, label, count(*) AS n FROM ex GROUP BY ALL
UNION ALL SELECT text_id, 'summarize', '', (mode IN ('summarize', 'both'))::BIGINT FROM modes
UNION ALL SELECT text_id, 'text_completion', '', (mode IN ('text_completion', 'both'))::BIGINT FROM modes"""


@check("task_usage_counts", sql(USAGE, f"{EXAMPLES}, {MODE}"))
def task_usage_counts(spark, sf_dir):
    return rc.task_usage_counts(examples(spark, sf_dir))


def finished_rows(spark, sf_dir):
    return rc.reading_comprehension(texts(spark, sf_dir), DOMAIN, vocabulary(spark, sf_dir))


@check("reading_comprehension", finished())
def reading_comprehension(spark, sf_dir):
    return finished_rows(spark, sf_dir)


def _format(name: str, mode: str) -> None:
    @check(name, finished(f"WHERE mode = '{mode}'"))
    def query(spark, sf_dir):
        return rc.of_mode(finished_rows(spark, sf_dir), mode)


for _name, _mode in (("format_summarize", "summarize"), ("format_completion", "text_completion"),
                     ("format_both", "both"), ("format_neither", "neither")):
    _format(_name, _mode)
