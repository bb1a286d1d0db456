"""Quality rules: base counts and the divergence of a document's histograms from its language.

Every count is an expression over one row. The references are the summed
histograms of each language, a handful of rows, joined back by broadcast. The
fewer words a text has, the farther it may be: that is the guard for short ones.

Nulls and the like: a null text counts as empty; a text of fewer than 50 words
fails the base rules; a null or unknown language is held against all documents
together. Repeated rows are judged alike, each for itself. Input columns that
bear the name of a result column are replaced by it. Where ids are null or not
unique, the counts are written beside the whole rows, else beside the ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import BLANK, column_or_null, numbered_id, packed, repeated_ids, unpacked
from corpusmill.session import spool

MIN_WORDS = 50
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a clean document: a fixed part and one over the root of its words.
MAX_CHAR_DISTANCE = (0.13, 1.2)
MAX_WORD_DISTANCE = (0.10, 1.8)
#: The same from the words of all languages together, from which a clean text of one language is far.
MAX_WORD_DISTANCE_OTHER = (0.33, 0.8)

# Common words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "del"),
}
#: A null or unknown language: held against all documents, by the common words of all languages.
OTHER = "other"
LISTED = tuple(sorted({w for common in COMMON_WORDS.values() for w in common}))

SYMBOLS = "[#*$%&|<>]"
#: What most texts mostly consist of; the characters of all classes below are outside.
PLAIN = r"[a-z\x20\x09-\x0D]+"
#: Character classes of words, disjoint: letters, marks, numbers, kinds of punctuation, symbols, controls and the like. The last
#: one of the histogram is every other character of a word, that is small Latin letters.
CLASSES = (
    r"[\p{Lu}&&\p{IsLatin}]", r"[\p{L}&&[^\p{Lu}\p{Ll}]]|[\p{Lu}\p{Ll}&&[^\p{IsLatin}]]", r"\p{M}", r"\p{N}",
    "!", r"\.", ",", r"\?", ";", ":", r"""['"\p{Pi}\p{Pf}]""", r"\p{Pd}", r"[\p{Ps}\p{Pe}]", r"\p{Pc}",
    r"""[\p{Po}&&[^!.,?;:'"]]""", r"\p{Sc}", r"\p{Sm}", r"\p{Sk}", r"\p{So}", r"[\p{Z}\p{C}&&[^\x20\x09-\x0D]]",
)
N_CLASSES = len(CLASSES) + 1
N_COMMON = len(LISTED) + 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "base_failed", "char_distance", "word_distance", "kept")


def _language(lang: Column) -> Column:
    return F.when(F.lower(lang).isin(*COMMON_WORDS), F.lower(lang)).otherwise(F.lit(OTHER))


def repeated_words(word: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Hashes of the windows tell texts without any repeat apart; the others sort
    their windows, with their places, and read off the equal neighbours.
    """
    n = F.size(word) - 2
    shifted = [F.slice(word, F.lit(k), F.greatest(n, F.lit(0))) for k in (1, 2, 3)]
    hashes = F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(x))
    placed = F.sort_array(F.arrays_zip(*[c.alias(f"w{k}") for k, c in enumerate(shifted)],
                                       F.sequence(F.lit(1), F.greatest(n, F.lit(1))).alias("at")))

    def covered(rows: Column) -> Column:
        after = F.slice(rows, F.lit(2), F.greatest(n - 1, F.lit(0)))
        before = F.slice(rows, F.lit(1), F.greatest(n - 1, F.lit(0)))

        def same(a: Column, b: Column) -> Column:
            return (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])

        twice = F.zip_with(before, after, lambda a, b: F.when(same(a, b), F.array(a["at"], b["at"])))
        at = F.array_distinct(F.flatten(F.array_compact(twice)))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    # The one-element array binds the sorted windows to a name, so that they are sorted once.
    counted = F.element_at(F.transform(F.array(placed), covered), 1)
    none = F.size(F.array_distinct(hashes)) == n
    return F.when(n < 2, 0).when(none, 0).otherwise(counted).cast("bigint")


def _without(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def _counted(docs: DataFrame, text: str, lang: str, id_col: str) -> DataFrame:
    """(row, rid, language, base counts, chars, common): counts and both histograms of every document."""
    base = packed(docs, rid=numbered_id(docs, id_col), text=F.coalesce(column_or_null(docs, text, "string"), F.lit("")),
                  language=_language(column_or_null(docs, lang, "string")))
    base = base.withColumns({
        "word": F.array_remove(F.split("text", f"[{BLANK}]+", -1), ""),
        "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANK}]")),
        "special": F.regexp_replace("text", PLAIN, ""),
    })
    base = base.withColumns({
        "n_words": F.size("word").cast("bigint"),
        "word_chars": F.length(F.array_join("word", "")).cast("bigint"),
        "n_symbols": _without(F.col("special"), SYMBOLS),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col("word")),
        "marks": F.array(*[_without(F.col("special"), c) for c in CLASSES]),
        "found": F.filter("word", lambda x: x.isin(*LISTED)),
    })
    plain = F.greatest(F.col("word_chars") - F.aggregate("marks", F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    each = [(F.size("found") - F.size(F.array_remove("found", w))).cast("bigint") for w in LISTED]
    return base.select("row", "rid", "language", *COUNTS, F.array(*each, F.col("n_words") - F.size("found")).alias("common"),
                       F.concat("marks", F.array(plain)).alias("chars"))


def _own(language: Column, common: Column) -> Column:
    """The histogram of the language's common words and all the rest; the whole one for a null or unknown language."""
    out = common
    for name, words in COMMON_WORDS.items():
        at = [k for k, w in enumerate(LISTED) if w in words]
        others = [F.get(common, F.lit(k)) for k in range(N_COMMON) if k not in at]
        out = F.when(language == name, F.array(*[F.get(common, F.lit(k)) for k in at], sum(others[1:], others[0]))).otherwise(out)
    return out


def _references(counted: DataFrame) -> DataFrame:
    """(language, ref_chars, ref_common): summed histograms over all documents long enough, at most five rows.

    That of a null or unknown language is the sum over all languages.
    """
    names = [f"{name}{i}" for name, n in (("chars", N_CLASSES), ("common", N_COMMON)) for i in range(n)]
    sums = [F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}")
            for name, n in (("chars", N_CLASSES), ("common", N_COMMON)) for i in range(n)]
    each = counted.where(F.col("n_words") >= MIN_WORDS).groupBy("language").agg(*sums)
    both = each.withColumn("language", F.explode(F.array_distinct(F.array("language", F.lit(OTHER)))))
    return both.groupBy("language").agg(*[F.sum(n).alias(n) for n in names]).select(
        "language", F.array(*[f"chars{i}" for i in range(N_CLASSES)]).alias("ref_chars"),
        F.array(*[f"common{i}" for i in range(N_COMMON)]).alias("ref_common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null where one of them is null or sums to nothing."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def log(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))

    def both(pair: Column) -> Column:
        a, b = pair.a, pair.b
        return (log(a) + log(b)) / 2 - log((a + b) / 2)

    def shares(a: Column) -> Column:
        sum_ = total(a)
        return F.when(sum_ > 0, F.transform(a, lambda x: x / sum_))

    pairs = F.zip_with(shares(p), shares(q), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.sqrt(F.greatest(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + both(x)), F.lit(0.0)))


def _most(base: float, more: float) -> Column:
    """Largest distance of a clean document: the fewer words, the more its histogram strays by chance."""
    return F.lit(base) + F.lit(more) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The documents with their counts, distances and verdict (`kept`).

    Counted once into a table in the shared folder, which gives the references
    and then the verdicts. The table stays as long as the result may be read, so
    it holds ids and counts; the verdicts then meet the documents by their ids.
    """
    alone = repeated_ids(docs.select(numbered_id(docs, id_col).alias("id"))).isEmpty()
    found = _counted(docs, text, lang, id_col)
    counted = spool(found.drop("row" if alone else "rid"), "quality")
    rows = counted.join(F.broadcast(_references(counted)), "language", "left").withColumns({
        "char_distance": distance(F.col("chars"), F.col("ref_chars")),
        "word_distance": distance(_own(F.col("language"), F.col("common")), _own(F.col("language"), F.col("ref_common"))),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = ((F.coalesce("char_distance", F.lit(0.0)) > _most(*MAX_CHAR_DISTANCE))
           | (F.coalesce("word_distance", F.lit(0.0)) > F.when(F.col("language") == OTHER, _most(*MAX_WORD_DISTANCE_OTHER))
              .otherwise(_most(*MAX_WORD_DISTANCE))))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
    if alone:
        rows = packed(docs, rid=numbered_id(docs, id_col)).join(rows.select("rid", *RESULTS), "rid")
    return unpacked(rows, docs.columns, *RESULTS)
