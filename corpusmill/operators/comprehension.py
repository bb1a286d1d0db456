"""Reading-comprehension rows from raw texts.

A raw text (text_id, text) is cut into title and body, mined for examples,
and put together with templates. Random choices are hashes of the text id, so
a rerun gives the same rows whatever the partitioning. All steps but the
domain-word examples stay inside the row; those need one join on the words
and one on the text id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import mining as mx
from corpusmill.functions import text as tx
from corpusmill.functions.sentences import sentences as cut_sentences
from corpusmill.session import spool
from corpusmill.templates import DEMOS, FRAMES, INTROS, OPTIONS, fill, formats

NONE = "array<struct<task:string,label:string,pos:int,verbalizer:string,s1:string,s2:string>>"


def split_title_body(texts: DataFrame) -> DataFrame:
    """(text_id, title, body): the first line and the rest; null texts are left out."""
    return texts.where(F.col("text").isNotNull()).select("text_id", tx.title_of(F.col("text")).alias("title"), tx.body_of(F.col("text")).alias("body"))


def truncate_tokens(texts: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Titles and bodies; with `max_tokens` bodies are cut after so many tokens, else they are whole."""
    whole = split_title_body(texts)
    return whole if max_tokens is None else whole.withColumn("body", tx.truncate_tokens(F.col("body"), max_tokens))


def sentences(texts: DataFrame, max_tokens: int | None = None, abbreviations: Sequence[str] = ()) -> DataFrame:
    """(text_id, pos, sentence) of the bodies; `abbreviations` as `learn_abbreviations` finds them in a corpus."""
    bodies = truncate_tokens(texts, max_tokens)
    return bodies.select("text_id", F.posexplode(cut_sentences(F.col("body"), abbreviations)).alias("pos", "sentence"))


def mine(texts: DataFrame, tasks: Sequence[str] = mx.TASKS, max_tokens: int | None = None,
         rules: Sequence[mx.Rule] = mx.RULES) -> DataFrame:
    """(text_id, task, label, pos, verbalizer, s1, s2): every pattern match, from one scan."""
    found = F.concat(*[mx.mined(F.col("body"), r) for r in rules if r.task in tasks])
    return truncate_tokens(texts, max_tokens).select("text_id", F.inline(found))


def cap_per_subcategory(examples: DataFrame, most: int = 2) -> DataFrame:
    """At most `most` examples per text, task and label; each task limits before it shuffles."""
    key = F.md5(F.concat_ws("|", F.lit("cap"), F.col("text_id").cast("string"), "task", "label",
                            F.col("pos").cast("string")))
    order = Window.partitionBy("text_id", "task", "label").orderBy(key)
    return examples.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def mined_counts(examples: DataFrame) -> DataFrame:
    """(text_id, task, n)."""
    return examples.groupBy("text_id", "task").agg(F.count(F.lit(1)).alias("n"))


def qualified_sentences(texts: DataFrame, vocabulary: DataFrame, min_words: int = 3, max_words: int = 100,
                        min_len: int = 10, max_tokens: int | None = None, abbreviations: Sequence[str] = ()) -> DataFrame:
    """(text_id, pos, words): sentences with enough words of the domain vocabulary.

    Only words long enough to be in the vocabulary leave the row.
    """
    def candidates(words: Column) -> Column:
        long_words = F.filter(words, lambda w: F.length(w) >= min_len)
        return F.when((F.size(words) <= max_words) & (F.size(long_words) >= min_words), long_words)

    words = F.array_distinct(tx.words(F.col("sentence")))
    tokens = sentences(texts, max_tokens, abbreviations).select("text_id", "pos", F.explode(tx.bind(words, candidates)).alias("term"))
    known = tokens.join(vocabulary.select("term"), "term", "left_semi")
    grouped = known.groupBy("text_id", "pos").agg(F.sort_array(F.collect_set("term")).alias("words"))
    return grouped.where(F.size("words") >= min_words)


def cap_sentences(qualified: DataFrame, most: int = 2) -> DataFrame:
    """At most `most` qualified sentences per text."""
    key = F.md5(F.concat_ws("|", F.lit("sent"), F.col("text_id").cast("string"), F.col("pos").cast("string")))
    order = Window.partitionBy("text_id").orderBy(key)
    return qualified.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _picked_words(qualified: DataFrame, first: int = 3) -> DataFrame:
    """(text_id, picked): at most two sentence positions per text with their first words."""
    picked = F.sort_array(F.collect_list(F.struct(
        "rank", "pos", F.array_join(F.slice("words", 1, first), ", ").alias("words"))))
    return cap_sentences(qualified).groupBy("text_id").agg(picked.alias("picked"))


def _word_examples(sents: Column, picked: Column) -> Column:
    return F.coalesce(F.transform(picked, lambda p: mx.example(
        "word2text", "word2text", p["pos"], F.lit(None).cast("string"), p["words"],
        tx.strip(F.get(sents, p["pos"])))), F.expr("array()").cast(NONE))


def with_examples(texts: DataFrame, vocabulary: DataFrame | None = None, max_tokens: int | None = None,
                  rules: Sequence[mx.Rule] = mx.RULES, abbreviations: Sequence[str] = ()) -> DataFrame:
    """(text_id, title, sents, examples): the capped examples of each text in its row."""
    bodies = truncate_tokens(texts, max_tokens)
    found = F.concat(*[mx.capped(mx.mined(F.col("body"), r), F.col("text_id")) for r in rules])
    rows = bodies.select("text_id", "title", cut_sentences(F.col("body"), abbreviations).alias("sents"), found.alias("examples"))
    if vocabulary is None:
        return rows
    # Written first: by its size the planner decides whether the bodies have to be shuffled.
    picked = spool(_picked_words(qualified_sentences(texts, vocabulary, max_tokens=max_tokens, abbreviations=abbreviations)), "picked")
    joined = rows.join(picked, "text_id", "left")
    words = _word_examples(F.col("sents"), F.col("picked"))
    return joined.select("text_id", "title", "sents", F.concat("examples", words).alias("examples"))


def mine_word2text(texts: DataFrame, vocabulary: DataFrame, max_tokens: int | None = None, abbreviations: Sequence[str] = ()) -> DataFrame:
    """(text_id, task, label, pos, verbalizer, s1, s2): s1 the words, s2 their sentence."""
    picked = _picked_words(qualified_sentences(texts, vocabulary, max_tokens=max_tokens, abbreviations=abbreviations))
    rows = truncate_tokens(texts, max_tokens).select("text_id", cut_sentences(F.col("body"), abbreviations).alias("sents"))
    return rows.join(picked, "text_id").select("text_id", F.inline(_word_examples(F.col("sents"), F.col("picked"))))


# -- filling templates -----------------------------------------------------

def slots(task: str, e: Column, domain: str) -> dict[str, Column]:
    """Slot values of an example of a task."""
    second = tx.capitalize_first(e["s2"])
    verbalizer = F.coalesce(e["verbalizer"], F.lit(""))
    if task == "nli":
        def answer(i: int) -> Column:
            return F.when(e["label"] == "Entail", mx.ANSWERS["Entail"][i]).when(
                e["label"] == "Contradict", mx.ANSWERS["Contradict"][i]).otherwise(mx.ANSWERS["Neutral"][i])
        return {"premise": e["s1"], "hypothesis": second, "options_": F.lit(OPTIONS), "verbalizer": verbalizer,
                "answer": answer(0), "connect_answer": answer(1), "relation_answer": answer(2)}
    if task == "common_reason":
        forward = e["label"] == "Cause-effect"
        return {"cause": F.when(forward, e["s1"]).otherwise(second),
                "effect": F.when(forward, second).otherwise(e["s1"]), "verbalizer": verbalizer}
    if task == "paraphrase":
        return {"sentence1": e["s1"], "sentence2": second, "verbalizer": verbalizer}
    return {"domain": F.lit(domain), "tripleset": e["s1"], "target": tx.strip(e["s2"]), "word": e["s1"],
            "definition": e["s2"], "sentence": e["s1"], "topic": e["s2"], "verbalizer": verbalizer}


def _pick(choices: Column, seed: Column, n: int) -> Column:
    """One of `n` array items by a hash."""
    return F.get(choices, (seed % n).cast("int"))


def _by_template(task: Column, label: Column, text_id: Column, demos,
                 choices: Callable[[str, list], Column]) -> Column:
    """The hashed pick from `choices(task, rows)` for the template rows that fit an example."""
    groups: dict[tuple[str, str, str], list[tuple[str, str]]] = {}
    for t, lab, variant, question, answer in demos:
        groups.setdefault((t, lab, variant), []).append((question, answer))
    seed, nli_variant = tx.h32("template", text_id), mx.nli_variant(text_id)
    out = F.lit(None)
    for (t, lab, variant), rows in reversed(groups.items()):
        fits = task == t
        if lab != "*":
            fits = fits & (label == lab)
        if variant:
            fits = fits & (nli_variant == variant)
        out = F.when(fits, _pick(choices(t, rows), seed, len(rows))).otherwise(out)
    return out


def _filled(e: Column, text_id: Column, domain: str, demos) -> Column:
    """struct<task, label, pos, question, answer> of one example."""
    values = {task: slots(task, e, domain) for task in mx.TASKS}

    def forms(task: str, rows: list) -> Column:
        return F.arrays_zip(*[formats([r[i] for r in rows], list(values[task])).alias(name)
                              for i, name in enumerate(("question", "answer"))])

    def filled(form: Column) -> Column:
        def part(name: str) -> Column:
            out = F.lit(None).cast("string")
            for task in mx.TASKS:
                out = F.when(e["task"] == task, fill(form[name], values[task])).otherwise(out)
            return out.alias(name)

        return F.struct(e["task"].alias("task"), e["label"].alias("label"), e["pos"].alias("pos"),
                        part("question"), part("answer"))

    return tx.bind(_by_template(e["task"], e["label"], text_id, demos, forms), filled)


def fill_template_qa(rows: DataFrame, domain: str, demos=DEMOS) -> DataFrame:
    """(text_id, task, label, pos, question, answer) of every capped example."""
    filled = F.transform("examples", lambda e: _filled(e, F.col("text_id"), domain, demos))
    return rows.select("text_id", F.inline(filled))


def fill_template(rows: DataFrame, domain: str, demos=DEMOS) -> DataFrame:
    """(text_id, task, label, pos, demo): question and answer joined by a space."""
    return fill_template_qa(rows, domain, demos).select(
        "text_id", "task", "label", "pos", F.concat("question", F.lit(" "), "answer").alias("demo"))


def choose_template(rows: DataFrame, demos=DEMOS) -> DataFrame:
    """(text_id, task, label, pos, idx, question, answer): templates before filling."""
    def choices(task: str, found: list) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(q).alias("question"), F.lit(a).alias("answer"))
                         for i, (q, a) in enumerate(found)])

    chosen = _by_template(F.col("task"), F.col("label"), F.col("text_id"), demos, choices)
    e = rows.select("text_id", F.inline("examples"))
    return e.select("text_id", "task", "label", "pos", chosen.alias("t")).select(
        "text_id", "task", "label", "pos", "t.idx", "t.question", "t.answer")


def answer_map(rows: DataFrame) -> DataFrame:
    """(text_id, label, pos, answer, connect_answer, relation_answer) of the inference examples."""
    e = rows.select("text_id", F.inline("examples")).where(F.col("task") == "nli")
    values = slots("nli", {c: F.col(c) for c in ("label", "s1", "s2", "verbalizer")}, "")
    names = ("answer", "connect_answer", "relation_answer")
    return e.select("text_id", "label", "pos", *[values[n].alias(n) for n in names])


def cause_effect_slots(rows: DataFrame) -> DataFrame:
    """(text_id, label, pos, cause, effect)."""
    e = rows.select("text_id", F.inline("examples")).where(F.col("task") == "common_reason")
    values = slots("common_reason", {c: F.col(c) for c in ("label", "s1", "s2", "verbalizer")}, "")
    return e.select("text_id", "label", "pos", *[values[n].alias(n) for n in ("cause", "effect")])


def word2text_slots(rows: DataFrame) -> DataFrame:
    """(text_id, pos, tripleset, target)."""
    e = rows.select("text_id", F.inline("examples")).where(F.col("label") == "word2text")
    return e.select("text_id", "pos", F.col("s1").alias("tripleset"), F.col("s2").alias("target"))


# -- putting the text together ---------------------------------------------

def _demos(rows: DataFrame, domain: str, demos, intros) -> DataFrame:
    """Add qa_demos, q_demos and a_demos to rows with examples."""
    key = F.col("text_id").cast("string")
    filled = rows.withColumn("filled", F.transform("examples", lambda e: _filled(e, F.col("text_id"), domain, demos)))

    def of(task: str) -> Column:
        return F.filter("filled", lambda f: f["task"] == task)

    blocks = F.array(*[F.struct(
        F.md5(F.concat_ws("|", F.lit("order"), key, F.lit(t))).alias("k"),
        F.array_join(F.transform(of(t), lambda f: F.concat(f["question"], F.lit(" "), f["answer"])), "\n\n").alias("d"))
        for t in mx.TASKS])
    shuffled = F.transform(F.sort_array(F.filter(blocks, lambda b: b["d"] != "")), lambda b: b["d"])
    intro = _pick(F.array(*[F.lit(i.replace("{domain}", domain)) for i in intros]),
                  tx.h32("intro", F.col("text_id")), len(intros))
    in_order = F.concat(*[of(t) for t in mx.TASKS])

    def joined(name: str) -> Column:
        return F.array_join(F.transform(in_order, lambda f: f[name]), "\n\n")

    any_demo = F.size("filled") > 0
    return filled.select(
        "text_id", "title", "sents",
        F.when(any_demo, F.concat(intro, F.array_join(shuffled, "\n\n"))).otherwise("").alias("qa_demos"),
        F.when(any_demo, F.concat(intro, joined("question"))).otherwise("").alias("q_demos"),
        F.when(any_demo, joined("answer")).otherwise("").alias("a_demos"))


def assemble_demos(rows: DataFrame, domain: str, demos=DEMOS, intros=INTROS) -> DataFrame:
    """(text_id, qa_demos, q_demos, a_demos): the example block of each text; '' without examples."""
    return _demos(rows, domain, demos, intros).drop("title", "sents")


def _modes(rows: DataFrame) -> DataFrame:
    n = F.size("sents")
    return rows.withColumns({
        "mode": mx.task_mix(F.col("text_id"), F.col("title").isNotNull(), n >= 2),
        "cut": mx.cut_point(F.col("text_id"), n)})


def task_mix(texts: DataFrame, max_tokens: int | None = None, abbreviations: Sequence[str] = ()) -> DataFrame:
    """(text_id, can_summarize, can_complete, mode)."""
    rows = truncate_tokens(texts, max_tokens).withColumn("sents", cut_sentences(F.col("body"), abbreviations))
    return _modes(rows).select("text_id", F.col("title").isNotNull().alias("can_summarize"),
                               (F.size("sents") >= 2).alias("can_complete"), "mode")


def cut_point(texts: DataFrame, max_tokens: int | None = None, abbreviations: Sequence[str] = ()) -> DataFrame:
    """(text_id, cut, first_half, second_half) of texts with two sentences or more."""
    rows = truncate_tokens(texts, max_tokens).withColumn("sents", cut_sentences(F.col("body"), abbreviations))
    first, second = mx.halves(F.col("sents"), F.col("cut"))
    return _modes(rows).where("cut is not null").select(
        "text_id", "cut", tx.strip(first).alias("first_half"), tx.strip(second).alias("second_half"))


def _with_contexts(rows: DataFrame) -> DataFrame:
    """Add the text pieces the frames use; the cut is at the first sentence where there is no other."""
    first, second = mx.halves(F.col("sents"), F.coalesce("cut", F.lit(1)))
    head = F.concat("title", F.lit("\n"))
    body = tx.strip(F.array_join("sents", ""))
    first_half = F.when(F.col("mode") == "text_completion", F.concat(head, tx.strip(first))).otherwise(tx.strip(first))
    return rows.select("text_id", "mode", "title", "qa_demos", "q_demos", "a_demos", body.alias("context_wo_title"),
                       first_half.alias("context_1st_half"), tx.strip(second).alias("context_2nd_half"),
                       F.concat(head, body).alias("context"))


FRAME_SLOTS = ("context_wo_title", "title", "context_1st_half", "context_2nd_half", "context", "qa_demos", "q_demos",
               "a_demos")


def _frame(domain: str, form: str, part: int, frames) -> Column:
    """The chosen frame of a row's mode with its slots filled; `part` 0 is the question, 1 the answer."""
    values = {"domain": F.lit(domain), **{name: F.col(name) for name in FRAME_SLOTS}}
    seed = tx.h32("template", F.col("text_id"))
    chosen = F.lit(None).cast("string")
    for mode in dict.fromkeys(row[0] for row in frames):
        rows = [row[2 + part] for row in frames if row[0] == mode and row[1] == form]
        picked = _pick(formats(rows, list(values)), seed, len(rows))
        chosen = F.when(F.col("mode") == mode, picked).otherwise(chosen)
    return tx.squeeze_spaces(fill(chosen, values))


def reading_comprehension(texts: DataFrame, domain: str, vocabulary: DataFrame | None = None,
                          input_name: str = "input", max_tokens: int | None = None, demos=DEMOS, intros=INTROS,
                          frames=FRAMES, abbreviations: Sequence[str] = ()) -> DataFrame:
    """(text_id, mode, text, question, answer, file_name): the finished rows."""
    rows = _with_contexts(_modes(_demos(with_examples(texts, vocabulary, max_tokens, abbreviations=abbreviations), domain, demos, intros)))
    return rows.select(
        "text_id", "mode", _frame(domain, "single", 0, frames).alias("text"),
        _frame(domain, "qa", 0, frames).alias("question"), _frame(domain, "qa", 1, frames).alias("answer"),
        F.concat(F.lit(input_name + ", line_"), F.col("text_id").cast("string")).alias("file_name"))


def of_mode(rows: DataFrame, mode: str) -> DataFrame:
    """Finished rows of one kind: summarize, text_completion, both or neither."""
    return rows.where(F.col("mode") == mode)


def task_usage_counts(rows: DataFrame) -> DataFrame:
    """(text_id, task, label, n): examples used, with the summarize and completion flags."""
    modes = _modes(rows)

    def flag(task: str, *in_modes: str) -> Column:
        return F.struct(F.lit(task).alias("task"), F.lit("").alias("label"),
                        F.col("mode").isin(*in_modes).cast("bigint").alias("n"))

    pairs = F.transform("examples", lambda e: F.struct(e["task"].alias("task"), e["label"].alias("label")))
    used = F.transform(F.array_distinct(pairs), lambda p: F.struct(
        p["task"].alias("task"), p["label"].alias("label"),
        F.size(F.filter("examples", lambda e: (e["task"] == p["task"]) & (e["label"] == p["label"])))
        .cast("bigint").alias("n")))
    flags = F.array(flag("summarize", "summarize", "both"), flag("text_completion", "text_completion", "both"))
    return modes.select("text_id", F.inline(F.concat(used, flags)))
