"""Key phrases of a text from the text alone, by a graph of its words.

Words that stand together between marks and stop words form a run; the words of a run are neighbours. A word counts
by how many neighbours it has where it stands, how often it stands and over how many sentences it is spread; a
phrase by its words. Phrases lie within one run, so none crosses a mark, a sentence's end or a stop word. Of phrases of
which one holds the other only the better one stays.

All of it happens inside the row: words are sorted to be counted and sorted back to their places, and strings are made
for phrases only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import bind

# Words that end a run.
STOP_WORDS = tuple("""
a about above after again against all also am an and any are as at be because been before being below between both but by can
could did do does doing down during each et few for from further had has have having he her here hers him his how i if in into is
it its itself just may me might more most must my no nor not now of off on once only or other our ours out over own per same she
should since so some such than that the their theirs them then there these they this those through thus to too under until up
upon us very via was we were what when where whether which while who whom why will with within without would you your yours
""".split())
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n"
#: Best phrases that `cross_check_mentions` chooses among, as its SQL does.
POOL = 40


def _runs(text: Column, stop_words: Sequence[str]) -> Column:
    """array<struct<w, s, r, j, len>>: each word with its sentence, run, place in the run and the run's length."""
    def plain(token: Column) -> Column:
        ends = token.isin(".", "!", "?", "\n")
        cuts = (F.length(token) < 2) | token.isin(list(stop_words)) | F.regexp_like(token, F.lit("^[0-9_]+$"))
        return F.when(ends, ".").when(cuts, "|").otherwise(token)

    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    joined = F.array_join(F.transform(tokens, plain), " ")

    def words(run: Column, s: Column, r: Column) -> Column:
        found = F.filter(F.split(run, " "), lambda w: w != "")
        return bind(found, lambda f: F.transform(f, lambda w, j: F.struct(
            w.alias("w"), s.alias("s"), r.alias("r"), j.alias("j"), F.size(f).alias("len"))))

    return F.flatten(F.transform(F.split(joined, r"\."), lambda sentence, s: F.flatten(F.transform(
        F.split(sentence, r"\|"), lambda run, r: words(run, s, r)))))


def _weighed(records: Column, max_n: int) -> Column:
    """array<struct<s, r, j, x, w>> in the text's order: each word with its weight."""
    def of_word(g: Column) -> Column:
        n = F.size(g)
        together = F.aggregate(g, F.lit(0), lambda total, x: total + F.least(x["len"], F.lit(max_n)))
        spread = F.size(F.filter(g, lambda x, i: (i == 0) | (x["s"] != F.get(g, i - 1)["s"])))
        weight = together / n * F.log(n + F.lit(1.0)) * F.sqrt(spread.cast("double"))
        return bind(weight, lambda v: F.transform(g, lambda x: F.struct(
            x["s"].alias("s"), x["r"].alias("r"), x["j"].alias("j"), v.alias("x"), x["w"].alias("w"))))

    def grouped(a: Column) -> Column:
        places = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 1) | (F.get(a, i - 1)["w"] != F.get(a, i - 2)["w"]))
        return bind(starts, lambda st: F.flatten(F.transform(st, lambda i, k: bind(
            F.slice(a, i, F.coalesce(F.get(st, k + 1), F.size(a) + 1) - i), of_word))))

    return F.sort_array(bind(F.sort_array(records), grouped))


def _phrases(q: Column, max_n: int) -> Column:
    """array<struct<order, phrase>>: all phrases of 1 to max_n words, best first, each once."""
    def of_length(n: int) -> Column:
        def phrase(x: Column, i: Column) -> Column:
            others = [F.get(q, i + k) for k in range(1, n)]
            inside = (others[-1]["s"] == x["s"]) & (others[-1]["r"] == x["r"]) if others else F.lit(True)
            total = x["x"]
            for o in others:
                total = total + o["x"]
            name = F.concat_ws(" ", x["w"], *[o["w"] for o in others]) if others else x["w"]
            return F.when(inside, F.struct(F.round(-total / F.sqrt(F.lit(float(n))), 6).alias("order"), name.alias("phrase")))
        return F.filter(F.transform(q, phrase), lambda p: p.isNotNull())

    found = F.sort_array(F.concat(*[of_length(n) for n in range(1, max_n + 1)]))
    return bind(found, lambda f: F.filter(f, lambda p, i: (i == 0) | (p["phrase"] != F.get(f, i - 1)["phrase"])))


def keyphrases(text: Column, top: int = 6, max_n: int = 3, stop_words: Sequence[str] = STOP_WORDS,
               pool: int | None = None) -> Column:
    """array<struct<phrase, score>>: the best 1..max_n word phrases of a text, chosen among all or, with `pool`, its best."""
    def within(a: Column, b: Column) -> Column:
        return F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))

    def keep(kept: Column, p: Column) -> Column:
        clash = F.exists(kept, lambda k: within(k["phrase"], p["phrase"]) | within(p["phrase"], k["phrase"]))
        return F.when((F.size(kept) >= top) | clash, kept).otherwise(F.concat(kept, F.array(p)))

    found = bind(_weighed(_runs(text, stop_words), max_n), lambda q: _phrases(q, max_n))
    found = found if pool is None else F.slice(found, 1, pool)
    chosen = F.aggregate(found, F.array().cast("array<struct<order:double,phrase:string>>"), keep)
    return F.transform(chosen, lambda p: F.struct(p["phrase"].alias("phrase"), (-p["order"]).alias("score")))
