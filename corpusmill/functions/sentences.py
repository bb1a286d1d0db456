"""Sentence boundaries: candidate pieces by their end marks, and a state machine that joins what no sentence ends.

A piece ends with its marks, closing quotes and brackets and white space. It goes on
into the next piece where

- no white space follows its marks (decimals, names of sites);
- one dot follows a single letter (initials) or an abbreviation, which are learnt from a corpus;
- a dot follows a number, dots trail off, or a quote or bracket closes after the marks, and the next piece begins with a
  small letter or a digit;
- a bracket is open and the next piece closes one.

A blank line always ends a sentence. The sentences of a text joined together are the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import WHITE, bind

# The patterns decide the results. Both engines that check them read these the same way.
CLOSERS = "[\"'”’»)\\]]"
PIECE = rf"[^.!?]+[.!?]*{CLOSERS}*\s*|[.!?]+{CLOSERS}*\s*"
LAST_WORD = r"(\p{L}+)\.\s+$"
TRAILS = rf"(?:[0-9]\.|\.\.+|[.!?]{CLOSERS}+)\s+$"
GOES_ON = r"^[\p{Ll}0-9]"
BLANK_LINE = r"\n\s*\n\s*$|\n\n$"
#: The closers one by one; a single letter and dot at the end of a piece without its white space, of which three characters suffice.
CLOSING = "\"'”’»)]"
ONE_LETTER = r"(?:^|[^\p{L}])\p{L}\.$"
WORD_AND_DOT = r"\p{L}+\.?"

#: An abbreviation is seen with its dot so often at least, scores so much, and is no longer than this.
LEAST_SEEN, LEAST_SCORE, LONGEST = 5, 0.3, 12
#: The strongest abbreviations that a model holds.
MOST = 2000


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _ends_with(text: Column, ends: Sequence[str]) -> Column:
    """Whether a text ends with one of some strings: looks at its last bytes only, whatever its length."""
    return reduce(Column.__or__, (F.endswith(text, F.lit(e)) for e in ends))


def _goes_on(piece: Column, following: Column, depth: Column, abbreviations: Sequence[str]) -> Column:
    """Whether the sentence goes on after the piece; `depth` counts the brackets that are open there.

    A piece that another one follows ends with marks, closers and white space in this order, so its last characters
    tell most of it. What is cheap comes first; a pattern runs over a whole piece only where the sentence may go on.
    """
    bare = F.rtrim(piece, F.lit(WHITE))
    one_letter = F.regexp_like(F.substring(bare, -3, 3), F.lit(ONE_LETTER))
    if abbreviations:
        word = F.regexp_extract(piece, LAST_WORD, 1)
        one_letter = one_letter | F.lower(word).isin(list(abbreviations))
    short = F.endswith(bare, F.lit(".")) & one_letter
    number = F.endswith(bare, F.lit(".")) & F.substring(bare, -2, 1).isin(list("0123456789"))
    trails = (_ends_with(bare, ["..", *CLOSING]) | number) & F.regexp_like(F.substring(following, 1, 1), F.lit(GOES_ON))
    bracket = (depth > 0) & (F.contains(following, F.lit(")")) | F.contains(following, F.lit("]")))
    return ~_ends_with(piece, list(WHITE)) | ((bracket | short | trails) & ~F.regexp_like(piece, F.lit(BLANK_LINE)))


def _opened(piece: Column) -> Column:
    """Opening less closing brackets."""
    opening = F.length(F.regexp_replace(piece, r"[^(\[]", ""))
    return opening - F.length(F.regexp_replace(piece, r"[^)\]]", ""))


def sentences(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Ordered sentences; joined together they give the text back."""
    none = F.array().cast("array<int>")

    def depths(p: Column) -> Column:
        """Open brackets after each piece, counted from the begin of the text; all 0 where it has none."""
        start = F.struct(none.alias("all"), F.lit(0).alias("now"))

        def step(state: Column, piece: Column) -> Column:
            now = state["now"] + _opened(piece)
            return F.struct(F.concat(state["all"], F.array(now)).alias("all"), now.alias("now"))

        counted = F.aggregate(p, start, step, lambda s: s["all"])
        return F.when(F.contains(text, F.lit("(")) | F.contains(text, F.lit("[")), counted).otherwise(F.transform(p, lambda x: F.lit(0)))

    def joined(p: Column, d: Column) -> Column:
        places = F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p))).otherwise(none)
        starts = F.filter(places, lambda i: (i == 1) | ~_goes_on(F.get(p, i - 2), F.get(p, i - 1), F.get(d, i - 2), abbreviations))
        return bind(starts, lambda s: F.transform(s, lambda i, j: F.when(F.get(s, j + 1) == i + 1, F.get(p, i - 1)).otherwise(
            F.array_join(F.slice(p, i, F.coalesce(F.get(s, j + 1), F.size(p) + 1) - i), ""))))

    return bind(pieces(text), lambda p: bind(depths(p), lambda d: joined(p, d)))


def abbreviation_scores(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, n_dot, score): how far a dot belongs to a word, by the log-likelihood ratio of the two.

    The ratio compares a dot that comes as often as after any word with one that nearly always comes. It counts
    less the longer the word is and the more often it stands without a dot.
    """
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_AND_DOT), F.lit(0))).alias("token"))
    dotted = F.substring("token", -1, 1) == "."
    words = found.select(F.rtrim("token", F.lit(".")).alias("word"), dotted.cast("bigint").alias("dot")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dot").alias("n_dot"))
    total = words.agg(F.sum("n"), F.sum("n_dot")).first()
    chance = min(max((total[1] or 0) / max(total[0] or 1, 1), 1e-9), 0.98)
    n, k = F.col("n"), F.col("n_dot")

    def likelihood(p: float) -> Column:
        return k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))

    ratio = -2 * (likelihood(chance) - likelihood(0.99))
    length = F.length("word")
    return words.where(k >= LEAST_SEEN).withColumn("score", ratio * F.exp(-length) * F.pow(length.cast("double"), -(n - k)))


def learn_abbreviations(texts: DataFrame, text_col: str = "text") -> list[str]:
    """The abbreviations of a corpus, single letters aside: `MOST` of them at most, strongest first."""
    scores = abbreviation_scores(texts, text_col)
    found = scores.where((F.col("score") >= LEAST_SCORE) & F.length("word").between(2, LONGEST))
    return [r["word"] for r in found.orderBy(F.col("score").desc(), "word").limit(MOST).collect()]
