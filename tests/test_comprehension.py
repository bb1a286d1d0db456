from __future__ import annotations

import re

from pyspark.sql import functions as F

from conftest import rows
from corpusmill.functions import mining as mx
from corpusmill.operators import comprehension as rc

A = "the first long sentence goes on for quite more than fifty letters"
B = "the second long sentence also goes on for more than fifty letters"
TEXTS = [
    (1, f"Title\nIntro. {A}. Therefore, {B}. end"),
    (2, f"Title\nIntro. {A}. hence , {B}. THUS, {A}. x"),
    (3, f"Title\nIntro. {A}, with a comma. However, {B}. x"),
    (4, f"Title\nIntro. {A}. due to {B}. x"),
    (5, "Title\nIntro. A spectroscope is defined as an instrument for the study of light. x"),
    (6, "Title\nIntro! This very long opening sentence is about the study of distant light. x"),
    (7, f"Title\nIntro. {A}. In other words, {B}, with a comma. x"),
    (8, "Only a title"), (9, "Title\nno end mark"), (10, ""),
    (11, "T\n" + f"Go. {A}. Thus, {B}. " * 5),
]


def texts(spark):
    return spark.createDataFrame(TEXTS, "text_id long, text string")


def test_miners_equal_the_patterns(spark):
    got = rows(rc.mine(texts(spark)).select("text_id", "task", "label", "pos", "s1", "s2"))
    expected = []
    for i, text in TEXTS:
        body = "\n".join(text.split("\n")[1:])
        for rule in mx.RULES:
            for pos, m in enumerate(re.findall(rule.pattern.replace("(?i:", "(?:"), body, re.IGNORECASE)):
                expected.append((i, rule.task, rule.label, pos, m[1], m[-2]))
    assert got == sorted(expected, key=repr)
    assert {(i, label) for i, _, label, *_ in got} >= {
        (1, "Entail"), (2, "Entail"), (4, "Effect-cause"), (5, "definition"), (6, "topic"), (7, "Similar")}
    assert (3, "Contradict") not in {(i, label) for i, _, label, *_ in got}


def test_both_caps_agree_and_keep_two(spark):
    mined = rc.mine(texts(spark))
    windowed = rows(rc.cap_per_subcategory(mined).select("text_id", "task", "label", "pos"))
    in_row = rows(rc.with_examples(texts(spark)).select("text_id", F.inline("examples")).select(
        "text_id", "task", "label", "pos"))
    assert windowed == in_row
    assert rc.mine(texts(spark)).where("text_id = 11 and label = 'Entail'").count() > 2
    assert len([r for r in in_row if r[0] == 11 and r[2] == "Entail"]) == 2


def test_one_sentence_has_no_cut_and_takes_two_modes(spark):
    many = spark.createDataFrame([(i, "T\none sentence only") for i in range(400)], "text_id long, text string")
    assert rc.cut_point(many).count() == 0
    modes = {r["mode"]: r["count"] for r in rc.task_mix(many).groupBy("mode").count().collect()}
    assert set(modes) == {"summarize", "neither"} and 140 < modes["summarize"] < 260


def test_mode_shares(spark):
    many = spark.createDataFrame([(i, "T\nOne. Two. Three.") for i in range(2000)], "text_id long, text string")
    modes = {r["mode"]: r["count"] / 2000 for r in rc.task_mix(many).groupBy("mode").count().collect()}
    for mode, share in {"summarize": 0.4, "text_completion": 0.1, "both": 0.4, "neither": 0.1}.items():
        assert abs(modes[mode] - share) < 0.05
    cuts = {r["cut"] for r in rc.cut_point(many).collect()}
    assert cuts == {1, 2}


def test_halves_join_to_the_body(spark):
    doc = spark.createDataFrame([(1, "T\nOne. Two. Three.")], "text_id long, text string")
    r = rc.cut_point(doc).first()
    assert f"{r['first_half']} {r['second_half']}" == "One. Two. Three."


def test_filled_text_is_not_read_for_slots_again(spark):
    odd = spark.createDataFrame([(1, f"T\nGo. {A} {{answer}} 100%. Thus, {B} %1$s. x")], "text_id long, text string")
    filled = rc.fill_template_qa(rc.with_examples(odd), "d").collect()
    assert filled and all("{premise}" not in r["question"] for r in filled)
    joined = " ".join(r["question"] + r["answer"] for r in filled)
    assert "{answer} 100%" in joined and "%1$s" in joined


def test_texts_without_examples_have_no_demo_block(spark):
    got = rc.assemble_demos(rc.with_examples(texts(spark)), "d").where("text_id in (8, 9, 10)")
    assert {tuple(r)[1:] for r in got.collect()} == {("", "", "")}


def test_every_text_gives_one_finished_row(spark):
    found = rc.reading_comprehension(texts(spark), "light").collect()
    assert len(found) == len(TEXTS)
    assert all(r["text"] is not None and r["question"] is not None and r["answer"] is not None for r in found)
    assert all("  " not in r["text"] for r in found)


def test_word_examples_need_three_words_of_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "T\nspectroscopy interferometer photometric here. spectroscopy interferometer only. x"),
                                  (2, "T\nnothing special. x")], "text_id long, text string")
    vocabulary = spark.createDataFrame([("spectroscopy",), ("interferometer",), ("photometric",)], "term string")
    assert rows(rc.mine_word2text(docs, vocabulary).select("text_id", "pos", "s1", "s2")) == [
        (1, 0, "interferometer, photometric, spectroscopy", "spectroscopy interferometer photometric here.")]


def test_usage_counts_carry_flags(spark):
    got = rows(rc.task_usage_counts(rc.with_examples(texts(spark))).where("text_id = 11"))
    counts = {(task, label): n for _, task, label, n in got}
    assert counts[("nli", "Entail")] == 2 and counts[("common_reason", "Cause-effect")] == 2
    assert {("summarize", ""), ("text_completion", "")} <= set(counts)


def test_null_texts_give_no_training_row(spark):
    from corpusmill.operators import comprehension as rc
    texts = spark.createDataFrame([(1, None), (2, "Title\nOne sentence. Two.")], "text_id long, text string")
    assert [r["text_id"] for r in rc.reading_comprehension(texts, "dom").collect()] == [2]
    assert [r["text_id"] for r in rc.sentences(texts).collect()] == [2, 2]
