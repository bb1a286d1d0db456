"""Question and answer templates of the reading-comprehension job, as plain rows.

`DEMOS` rows are (task, label, variant, question, answer); `FRAMES` rows are
(mode, form, question, answer) where the `single` form is one text and the `qa`
form a question and an answer. Slots stand in braces. Pass other rows to the
operators to change wording or add tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS = "- Yes\n- No\n- Maybe"

DEMOS = (
    ("nli", "*", "classify", "{premise}\nGiven this, would you say that \"{hypothesis}\"?\n{options_}", "{answer}"),
    ("nli", "*", "classify", "First statement: {premise}\nSecond statement: {hypothesis}\nDoes the second follow from the first?\n{options_}", "{answer}"),
    ("nli", "*", "classify", "Suppose that \"{premise}\" holds. Must \"{hypothesis}\" hold as well?", "{answer}"),
    ("nli", "*", "classify", "A: {premise}\nB: {hypothesis}\nWhich of Therefore, However and Moreover links A to B?", "{connect_answer}"),
    ("nli", "*", "classify", "A: {premise}\nB: {hypothesis}\nName the relation of B to A: Entailment, Neutral or Contradictory.", "{relation_answer}"),
    ("nli", "*", "classify", "Someone claims: {hypothesis}\nAll that is known: {premise}\nIs the claim borne out?\n{options_}", "{answer}"),
    ("nli", "Entail", "generate", "{premise}\nState something that follows from this.", "{hypothesis}"),
    ("nli", "Entail", "generate", "{premise} {verbalizer},", "{hypothesis}"),
    ("nli", "Contradict", "generate", "{premise}\nState something that speaks against this.", "{hypothesis}"),
    ("nli", "Contradict", "generate", "{premise} {verbalizer},", "{hypothesis}"),
    ("nli", "Neutral", "generate", "{premise}\nAdd a further remark on the matter.", "{hypothesis}"),
    ("nli", "Neutral", "generate", "{premise} {verbalizer},", "{hypothesis}"),
    ("common_reason", "Cause-effect", "", "{cause}\nWhat comes of this?", "{effect}"),
    ("common_reason", "Cause-effect", "", "Name a result of the following: {cause}", "{effect}"),
    ("common_reason", "Cause-effect", "", "{effect}\nWhat led to it?", "{cause}"),
    ("common_reason", "Cause-effect", "", "Finish the chain of events. First: {cause} Then:", "{effect}"),
    ("common_reason", "Effect-cause", "", "{effect}\nWhy is that so?", "{cause}"),
    ("common_reason", "Effect-cause", "", "Give the reason for the following: {effect}", "{cause}"),
    ("common_reason", "Effect-cause", "", "{cause}\nWhat may this bring about?", "{effect}"),
    ("paraphrase", "Similar", "", "{sentence1}\nSay this in different words.", "{sentence2}"),
    ("paraphrase", "Similar", "", "Rewrite and keep the meaning: {sentence1}", "{sentence2}"),
    ("paraphrase", "Similar", "", "{sentence1} {verbalizer},", "{sentence2}"),
    ("paraphrase", "Similar", "", "A pupil did not understand this: {sentence1}\nHelp with another wording.", "{sentence2}"),
    ("paraphrase", "Different", "", "{sentence1}\nWrite a sentence that disagrees.", "{sentence2}"),
    ("paraphrase", "Different", "", "Take the opposite view of: {sentence1}", "{sentence2}"),
    ("paraphrase", "Different", "", "{sentence1} {verbalizer},", "{sentence2}"),
    ("word2text", "word2text", "", "Write a sentence on {domain} with the words {tripleset}.", "{target}"),
    ("word2text", "word2text", "", "Which sentence about {domain} can hold all of: {tripleset}?", "{target}"),
    ("word2text", "word2text", "", "{target}\nName the {domain} terms in this sentence.", "{tripleset}"),
    ("word2text", "word2text", "", "Here are some {domain} words: {tripleset}. Put them to use.", "{target}"),
    ("word2text", "definition", "", "What does {word} mean?", "{definition}"),
    ("word2text", "definition", "", "Define {word}.", "{definition}"),
    ("word2text", "definition", "", "Which term is described here? {definition}", "{word}"),
    ("word2text", "topic", "", "{sentence}\nWhat is it about?", "{topic}"),
    ("word2text", "topic", "", "Name the subject of the following: {sentence}", "{topic}"),
    ("word2text", "topic", "", "Open a text on this subject: {topic}", "{sentence}"),
    ("word2text", "topic", "", "Under which heading would you file this? {sentence}", "{topic}"),
)

INTROS = (
    "\n\n",
    "\nSome questions on this {domain} text:\n\n",
    "\n\nAnswer what follows from the text above.\n\n",
    "\nTest how well you read the {domain} text:\n\n",
    "\n\nQuestions and answers:\n",
    "\n\nNow to what you have just read.\n\n",
    "\n\nA few tasks follow.\n",
    "\nHere is what one could ask about it:\n\n",
    "\n\nWork through these points on the {domain} text:\n\n",
    "\n\nLet us look closer at the passage.\n",
    "\nSee how much of the {domain} text stayed with you.\n\n",
    "\n\nThink about each of these in turn:\n\n",
    "\n\nExercises:\n",
    "\nThe text settles the following.\n\n",
    "\n\nWith the {domain} text at hand, reply to each item:\n\n",
    "\n\nWhat a careful reader should know:\n",
    "\nUse nothing but the text above.\n\n",
    "\n\nSome points for discussion:\n\n",
)

FRAMES = (
    ("summarize", "single", "{context_wo_title}\n\nWhich title fits this {domain} text? {title}{qa_demos}", ""),
    ("summarize", "single", "Text: {context_wo_title}\n\nIts title: {title}{qa_demos}", ""),
    ("summarize", "single", "Write a {domain} text with the title \"{title}\".\n{context_wo_title}{qa_demos}", ""),
    ("summarize", "single", "Find a heading for this.\n\n{context_wo_title}\n\nHeading: {title}{qa_demos}", ""),
    ("summarize", "qa", "Find a heading for this.\n\n{context_wo_title}{q_demos}", "{title}\n\n{a_demos}"),
    ("summarize", "qa", "{context_wo_title}\n\nWhich title fits this {domain} text?{q_demos}", "{title}\n\n{a_demos}"),
    ("summarize", "qa", "Write a {domain} text with the title \"{title}\".{q_demos}", "{context_wo_title}\n\n{a_demos}"),
    ("text_completion", "single", "How would this {domain} text go on?\n{context_1st_half}\n\n{context_2nd_half}{qa_demos}", ""),
    ("text_completion", "single", "{context_1st_half}\n\nContinue: {context_2nd_half}{qa_demos}", ""),
    ("text_completion", "single", "An unfinished {domain} text:\n{context_1st_half}\n\nIts missing part:\n{context_2nd_half}{qa_demos}", ""),
    ("text_completion", "qa", "An unfinished {domain} text:\n{context_1st_half}\n\nWrite the missing part.{q_demos}", "{context_2nd_half}\n\n{a_demos}"),
    ("text_completion", "qa", "How would this {domain} text go on?\n{context_1st_half}{q_demos}", "{context_2nd_half}\n\n{a_demos}"),
    ("text_completion", "qa", "{context_1st_half}\n\nContinue:{q_demos}", "{context_2nd_half}\n\n{a_demos}"),
    ("both", "single", "{context_1st_half}\n\nContinue: {context_2nd_half}\n\nGive the whole a title: {title}{qa_demos}", ""),
    ("both", "single", "Start of a {domain} text: {context_1st_half}\nRest: {context_2nd_half}\nTitle: {title}{qa_demos}", ""),
    ("both", "single", "{context_1st_half}\n\nHere the page was torn. It went on:\n{context_2nd_half}\n\nThe cover said: {title}{qa_demos}", ""),
    ("both", "qa", "{context_1st_half}\n\nHere the page is torn. How did it go on, and what did the cover say?{q_demos}", "{context_2nd_half}\n\nThe cover: {title}\n\n{a_demos}"),
    ("both", "qa", "{context_1st_half}\n\nContinue and give the whole a title.{q_demos}", "{context_2nd_half}\nTitle: {title}\n\n{a_demos}"),
    ("both", "qa", "Start of a {domain} text: {context_1st_half}{q_demos}", "{context_2nd_half}\nTitle: {title}\n\n{a_demos}"),
    ("neither", "single", "{context}{qa_demos}", ""),
    ("neither", "single", "Read this {domain} text.\n{context}{qa_demos}", ""),
    ("neither", "single", "From a work on {domain}:\n\n{context}{qa_demos}", ""),
    ("neither", "qa", "From a work on {domain}:\n\n{context}{q_demos}", "{a_demos}"),
    ("neither", "qa", "{context}{q_demos}", "{a_demos}"),
    ("neither", "qa", "Read this {domain} text.\n{context}{q_demos}", "{a_demos}"),
)


def formats(templates: Sequence[str], slots: Sequence[str]) -> Column:
    """The templates as an array of format strings whose places are the slots in order."""
    place = {name: i + 1 for i, name in enumerate(slots)}
    found = [re.sub(r"\{(\w+)\}", lambda m: f"%{place[m.group(1)]}$s", t.replace("%", "%%")) for t in templates]
    return F.array(*[F.lit(f) for f in found])


def fill(form: Column, slots: dict[str, Column]) -> Column:
    """A format string with its slots filled; filled-in text is not read again for slots."""
    return F.call_function("format_string", form, *slots.values())
