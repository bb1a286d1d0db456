"""Column functions on text. All stay in the JVM: no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped at the ends of a text (the usual white space).
WHITE = " \t\n\r\x0b\x0c"

# Patterns whose matches define the results.
COMMENT_MARK = ";Comment"
WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"
URL = r"https?://[$-_a-z!]+"
KEYWORDS_HEADER = r"(?:Keywords|KeyWords|keywords):\s*(.+?)(?:[.;]|$)"
DIGITS = r"^[0-9]+$"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    Needed where a lambda would otherwise evaluate the outer expression again
    for each array element.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def h32(salt: str, key: Column) -> Column:
    """Stable 32-bit hash of a key under a salt, as BIGINT."""
    digest = F.md5(F.concat(F.lit(salt + "|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def strip_comment(text: Column) -> Column:
    """Text before the first comment mark."""
    return F.substring_index(text, COMMENT_MARK, 1)


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def newline_marker(text: Column, marker: str = "[NEWLINE]") -> Column:
    return F.replace(text, F.lit("\n"), F.lit(marker))


def capitalize_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def title_of(text: Column) -> Column:
    """First line."""
    return F.substring_index(text, "\n", 1)


def body_of(text: Column) -> Column:
    """Everything after the first line ('' when there is one line only)."""
    return F.substr(text, F.length(title_of(text)) + 2)


def words(text: Column) -> Column:
    """Lower-cased words of one or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased words of two or more word characters (search terms)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def truncate_tokens(text: Column, max_tokens: int) -> Column:
    """Keep the first `max_tokens` white-space tokens, spacing included."""
    pieces = F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0))
    lead = F.regexp_extract(text, r"^\s*", 0)
    cut = bind(pieces, lambda p: F.when(
        F.size(p) > max_tokens, F.concat(lead, F.array_join(F.slice(p, 1, max_tokens), ""))))
    return F.coalesce(cut, text)


def run_lengths(items: Column) -> Column:
    """array<T> -> array<struct<term T, n INT>>: distinct items with their counts.

    Sorting the array inside the row and reading off the run ends needs no
    shuffle and no per-item comparison with all the others.
    """
    def ends(a: Column) -> Column:
        last = F.size(a)
        positions = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.expr("array()").cast("array<int>"))
        return F.filter(positions, lambda i: (i == last) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))

    def runs(a: Column) -> Column:
        return bind(ends(a), lambda e: F.transform(
            e, lambda p, j: F.struct(F.get(a, p - 1).alias("term"),
                                     (p - F.coalesce(F.get(e, j - 1), F.lit(0))).alias("n"))))

    return bind(F.sort_array(items), runs)


def chunks(text: Column, chunk_size: int = 250, separator: str = "\n") -> Column:
    """Pieces between separators merged greedily up to `chunk_size` characters.

    Empty pieces are dropped, a longer piece stays whole, chunks are stripped
    and blank ones dropped; no overlap.
    """
    pieces = F.filter(F.split(text, separator), lambda p: p != "")
    start = F.struct(F.expr("array()").cast("array<string>").alias("done"),
                     F.lit(None).cast("string").alias("cur"))

    def merge(acc: Column, piece: Column) -> Column:
        fits = F.length(acc["cur"]) + len(separator) + F.length(piece) <= chunk_size
        return F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), piece.alias("cur"))) \
            .when(fits, F.struct(acc["done"].alias("done"),
                                 F.concat(acc["cur"], F.lit(separator), piece).alias("cur"))) \
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), piece.alias("cur")))

    def finish(acc: Column) -> Column:
        all_chunks = F.when(acc["cur"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["cur"])))
        return F.filter(F.transform(all_chunks, strip), lambda c: c != "")

    return F.aggregate(pieces, start, merge, finish)


def clean_query_list(text: Column) -> Column:
    """Comma or newline separated queries; non-letters become spaces; empties kept."""
    parts = F.split(text, ",|, |\n|,\n")
    return F.transform(parts, lambda p: strip(F.regexp_replace(p, r"[^a-zA-Z\s]", " ")))


def list_literal(text: Column) -> Column:
    """Items of a list printed as "['a', 'b']"."""
    inner = F.substring_index(F.substr(text, F.lit(3)), "']", 1)
    return F.when(F.length(text) <= 2, F.expr("array()").cast("array<string>")).otherwise(
        F.split(inner, "', '"))


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def code_sentences(text: Column, words_sought: tuple[str, ...] = ("code", "software")) -> Column:
    """Sentences that hold one of the words, in any case.

    Cutting at the end marks first and testing each piece keeps the work linear
    in the text; one pattern for both steps back sentence after sentence. A
    piece without an end mark (the last) is no sentence.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[^.?!]*+[.?!]|[^.?!]++"), F.lit(0))
    sought = r"(?iU)\b(?:" + "|".join(words_sought) + r")\b"
    return F.filter(pieces, lambda s: F.substring(s, -1, 1).isin(".", "?", "!") & s.rlike(sought))


def keywords_header(text: Column) -> Column:
    """The first `Keywords:` list, trimmed; null when there is none."""
    pattern = "(?dU)" + KEYWORDS_HEADER
    return F.when(F.regexp_like(text, F.lit(pattern)), strip(F.regexp_extract(text, pattern, 1)))


def url_list(urls: Column) -> Column:
    """Items of a space-joined URL list; no item for null."""
    return F.when(urls.isNotNull(), F.split(urls, " "))


def repo_parts(url: Column) -> Column:
    """struct<owner, repo> from the path of a URL; null when the path is shorter."""
    path = F.try_parse_url(url, F.lit("PATH"))
    parts = F.split(F.trim(path, F.lit("/")), "/")
    return bind(parts, lambda p: F.when(
        F.size(p) >= 2, F.struct(F.get(p, F.lit(0)).alias("owner"), F.get(p, F.lit(1)).alias("repo"))))


def century(yy: Column) -> Column:
    """Two-digit year to a full one: below 25 is 20xx, else 19xx."""
    return F.concat(F.when(yy.cast("int") < 25, F.lit("20")).otherwise(F.lit("19")), yy)
