"""Sentence pairs and definitions found by pattern, as array columns.

One rule is one literal pattern; all rules run over the text in the same scan,
and every step of an example's way stays inside the document's row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import bind, h32


@dataclass(frozen=True)
class Rule:
    """A pattern whose groups 2, 4 and 6 are first part, connective and second part.

    Only the connective has letters, so only it ignores case.
    """
    task: str
    label: str
    pattern: str
    guard: str  # found wherever the pattern is, and searched for first, being much quicker


def sentence_pair(task: str, label: str, connectives: str, barred: str = ",", comma: bool = True) -> Rule:
    """Two sentences of 50 characters or more, the second opened by a connective."""
    sentence = rf"([^.!?\n{barred}]{{50,}}[.!?]+)"
    joint = r"([\s]*,[\s]+)" if comma else r"([\s]+)"
    return Rule(task, label, rf"([.!?]+[\s]+){sentence}([\s]+)((?i:{connectives})){joint}{sentence}([\s]+)",
                rf"[.!?][\s]+(?i:{connectives})")


# The connectives of each task and label, and the two free patterns.
RULES = (
    sentence_pair("nli", "Entail", "Yes|Therefore|Thus|Accordingly|Hence|For this reason"),
    sentence_pair("nli", "Contradict", "No|However|But|On the contrary|In contrast|Whereas"),
    sentence_pair("nli", "Neutral", "Maybe|Also|Furthermore|Secondly|Additionally|Moreover|In addition"),
    sentence_pair("common_reason", "Cause-effect", "Thus|Therefore|Accordingly|Hence|For this reason"),
    sentence_pair("common_reason", "Effect-cause", "due to|on account of|owing to", ";,", comma=False),
    sentence_pair("paraphrase", "Similar",
                  "In other words|In other word|Namely|That is to say|i.e.|Scilicet|Similarly|Equally", ""),
    sentence_pair("paraphrase", "Different", "No|However|But|On the contrary|In contrast|Whereas", ""),
    Rule("word2text", "definition", r"""([\s]+)([^.!?,;\s"]{10,})([\s]+)((?i:is defined as|'s definition is))"""
         r"""([\s]+)([^.!?\n]{20,}[.!?]+)([\s]+)""", "(?i:is defined as|'s definition is)"),
    Rule("word2text", "topic", r"""([.!?]+[\s]+)([^.!?,;\n]{20,})([\s]+)((?i:was about|talks about|is about|'s topic is))"""
         r"""([\s]+)([^.!?\n]{20,}[.!?]+)([\s]+)""", "(?i:was about|talks about|is about|'s topic is)"),
)
TASKS = ("nli", "common_reason", "paraphrase", "word2text")
ANSWERS = {"Entail": ("Yes", "Therefore", "Entailment"), "Contradict": ("No", "However", "Contradictory"),
           "Neutral": ("Maybe", "Moreover", "Neutral")}


def example(task: str, label: str, pos: Column, verbalizer: Column, s1: Column, s2: Column) -> Column:
    return F.struct(F.lit(task).alias("task"), F.lit(label).alias("label"), pos.cast("int").alias("pos"),
                    verbalizer.alias("verbalizer"), s1.alias("s1"), s2.alias("s2"))


def mined(text: Column, rule: Rule) -> Column:
    """array<struct<task, label, pos, verbalizer, s1, s2>> of all matches in order.

    The text is searched once, and only if it holds the rule's words at all; the parts are then taken from each
    short match.
    """
    pattern = "(?U)" + rule.pattern
    matches = F.when(F.regexp_like(text, F.lit("(?U)" + rule.guard)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>"))
    return F.transform(matches, lambda m, i: example(
        rule.task, rule.label, i, F.regexp_extract(m, pattern, 4), F.regexp_extract(m, pattern, 2),
        F.regexp_extract(m, pattern, 6)))


def capped(examples: Column, text_id: Column, most: int = 2) -> Column:
    """At most `most` examples, in an order fixed by document and position."""
    key = text_id.cast("string")
    ordered = F.sort_array(F.transform(examples, lambda e: F.struct(
        F.md5(F.concat_ws("|", F.lit("cap"), key, e["task"], e["label"], e["pos"].cast("string"))).alias("k"),
        e.alias("e"))))
    return F.transform(F.slice(ordered, 1, most), lambda x: x["e"])


def nli_variant(text_id: Column) -> Column:
    """classify for four documents in five, generate for the rest."""
    return F.when(h32("variant", text_id) % 10 < 2, "generate").otherwise("classify")


def task_mix(text_id: Column, can_summarize: Column, can_complete: Column) -> Column:
    """summarize, text_completion, both or neither: 4:1:4:1, or 1:1 where only one is possible."""
    u = h32("mix", text_id) % 1000
    both = F.when(u < 400, "summarize").when(u < 500, "text_completion").when(u < 900, "both").otherwise("neither")
    return F.when(can_summarize & can_complete, both) \
        .when(can_summarize, F.when(u < 500, "summarize").otherwise("neither")) \
        .when(can_complete, F.when(u < 500, "text_completion").otherwise("neither")).otherwise("neither")


def cut_point(text_id: Column, n: Column) -> Column:
    """A cut in 1 .. n-1; null below two sentences."""
    return F.when(n >= 2, (1 + h32("cut", text_id) % (n - 1)).cast("int"))


def halves(sentences: Column, cut: Column) -> tuple[Column, Column]:
    """Sentences before and after the cut, joined."""
    first = F.array_join(F.slice(sentences, F.lit(1), cut), "")
    second = bind(sentences, lambda s: F.array_join(F.slice(s, cut + 1, F.size(s)), ""))
    return first, second
