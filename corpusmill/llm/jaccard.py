"""Near-duplicate texts by a size-aware join of their shingle sets.

Two sets of sizes a and b with a Jaccard similarity of t or more have so many
common elements that, whatever fixed order the elements are in, the first
`a - ceil(t*a) + c` of the one and the first `b - ceil(t*b) + c` of the other
share c elements. *Light* sets are joined on fixed-size subsets: all pairs
(c = 2) of their first elements. *Heavy* sets scan inverted lists: single first
elements (c = 1), in which the light sets that are large enough to match a
heavy one are entered, too. The boundary between the two is where the counted
costs, over the sizes of all documents, are least. The order puts common
shingles last: by the counts of 2**20 classes of shingles over the whole
corpus, a table of fixed size.

Lists do not give all their pairs. Texts with equal sets are one class, with
its smallest id as representative; members of a list are first compared with
one of them, and linked ones merged. While the lists still hold far more pairs
across components than entries, each meets another member drawn by lot; what is
left of such pairs is then compared one by one. So a group of copies costs its
size, not its square, and no link between components is missed. Every candidate
is verified on the whole sets.

Nulls and the like: a null text is empty; an empty text is linked with nothing,
not even with another; repeated rows are in one class. Ids that are null or not
unique make the operator number the rows itself; a component then still bears
the smallest id of its rows. Extra columns are carried along; those named like
a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import identified
from corpusmill.llm.graph import components
from corpusmill.llm.hashing import WordHashes, binary, grouped, mixed, shingle_sets
from corpusmill.session import discard, spool

WIDTH = 5
#: Similarity as a fraction, so that the comparison is one of whole numbers.
THRESHOLD = (4, 5)
#: Size of the subsets of light sets.
SUBSET = 2
#: Classes of shingles whose occurrences are counted, and how many of them travel in a row.
CLASSES = 1 << 20
CHUNK = 1 << 12
#: Pairs across components that may be compared at once, for each entry of the lists that hold them.
LINEAR = 4
#: Another draw is worth while if the last one left no more than this part of them.
WORTH = 0.9
#: What reading an entry of an inverted list costs, in rows of the join, besides those found in it.
LIST_COST = 2.0
#: Rows of postings that are compared with their neighbours together.
MET_AT_ONCE = 1 << 16
RESULTS = ("n_shingles", "component_id")

_POSTING = "key long, rid long, at int"
_PROFILE = "rid long, n_shingles long, digest binary, chunk int, counts binary"


def least_common(n: np.ndarray | int, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray | int:
    """Common elements that a set of n needs at least."""
    up, down = threshold
    return -(-n * up // down)


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known, counts = WordHashes(), np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            sets = shingle_sets([(text or b"").lower() for text in binary(batch.column("text"))], width, known)
            if sets:
                counts += np.bincount((np.concatenate(sets) % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
            sizes = [len(found) for found in sets]
            digests = [hashlib.blake2b(found.tobytes(), digest_size=16).digest() for found in sets]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["rid", "n_shingles", "digest", "chunk", "counts"])
        rows = [(k, counts[k * CHUNK:(k + 1) * CHUNK]) for k in range(CLASSES // CHUNK)]
        rows = [(k, part) for k, part in rows if part.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()),
             pa.array([k for k, _ in rows], pa.int32()), pa.array([p.tobytes() for _, p in rows], pa.binary())],
            names=["rid", "n_shingles", "digest", "chunk", "counts"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            got = np.frombuffer(part, dtype=np.int64)
            sums[chunk] = sums[chunk] + got if chunk in sums else got
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                      pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                     names=["chunk", "counts"])


def class_levels(profile: DataFrame) -> tuple[np.ndarray, float]:
    """(level of each class of shingles: the commoner the higher; mean length of a list of its rarer fifth).

    At most 2**20 counts come to the driver, in 256 rows, and go out again as one byte each.
    """
    summed = (profile.where(F.col("chunk").isNotNull()).select("chunk", "counts")
              .repartition("chunk").mapInArrow(_added, "chunk int, counts binary"))
    counts = np.zeros(CLASSES, dtype=np.int64)
    for chunk, part in spool(summed, "counts").toLocalIterator():
        counts[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(part, dtype=np.int64)
    total, mean = counts.sum(), counts.mean()
    ordered = np.sort(counts)
    rare = ordered[np.cumsum(ordered) <= total / 5]
    excess = float(np.maximum(rare - mean, 0).mean()) if len(rare) else 0.0
    return np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8), 1 + excess


def boundary(sizes: dict[int, int], list_length: float, threshold: tuple[int, int] = THRESHOLD) -> int:
    """The smallest size of a heavy set: where subsets of the light and lists of the heavy cost least together."""
    if not sizes:
        return 0
    n = np.array(sorted(sizes), dtype=np.int64)
    times = np.array([sizes[k] for k in n], dtype=np.float64)
    first = n - least_common(n, threshold)
    subsets = times * (first + SUBSET) * (first + SUBSET - 1) / 2
    lists = times * (first + 1) * (LIST_COST + list_length - 1)
    light = np.concatenate([[0], np.cumsum(subsets)])
    heavy = np.concatenate([[0], np.cumsum(lists)])
    candidates = np.append(n, n[-1] + 1)
    entered = np.searchsorted(n, least_common(candidates, threshold))  # light sets in the lists as well
    cost = light + heavy[-1] - np.minimum(heavy[entered], heavy)
    return int(candidates[int(np.argmin(cost))])


def join_keys(found: np.ndarray, levels: np.ndarray, heavy_from: int,
              threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a sorted set of hashes is joined, and the place of each in the order, 0 for a subset."""
    n = len(found)
    need = int(least_common(n, threshold))
    take = min(n, n - need + SUBSET)
    order = levels[(found % np.uint64(CLASSES)).astype(np.int64)]
    first = found[np.argsort(order, kind="stable")[:take]]
    keys, places = [found[:0]], [np.zeros(0, dtype=np.int32)]
    if n < heavy_from and len(first) >= SUBSET:
        i, j = np.triu_indices(len(first), 1)
        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        with np.errstate(over="ignore"):
            keys.append(mixed(a * np.uint64(3) + mixed(b)))
        places.append(np.zeros(len(i), dtype=np.int32))
    if n >= least_common(heavy_from, threshold):
        keys.append(first[:n - need + 1])
        places.append(np.arange(1, len(keys[-1]) + 1, dtype=np.int32))
    return np.concatenate(keys), np.concatenate(places)


def _postings(levels, heavy_from: int, width: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = [(text or b"").lower() for text in binary(batch.column("text"))]
            keys = [join_keys(found, levels.value, heavy_from, threshold) for found in shingle_sets(texts, width, known)]
            rids = np.repeat(batch.column("rid").to_numpy(), [len(k) for k, _ in keys])
            flat = np.concatenate([k for k, _ in keys]) if keys else np.zeros(0, dtype=np.uint64)
            places = np.concatenate([p for _, p in keys]) if keys else np.zeros(0, dtype=np.int32)
            for at in range(0, len(flat), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(flat[at:at + (1 << 18)].view(np.int64)),
                                                  pa.array(rids[at:at + (1 << 18)]), pa.array(places[at:at + (1 << 18)])],
                                                 names=["key", "rid", "at"])
    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that stand in several rows, from rows sorted by key."""
    before, last = None, None  # the last row waits for the key that comes after it
    for table in grouped(batches, MET_AT_ONCE):
        table = table if last is None else pa.concat_tables([last, table])
        keys = table.column("key").to_numpy()
        same = keys[1:] == keys[:-1]
        keep = same | np.append(len(same) > 0 and before == keys[0], same[:-1])[:len(same)]
        yield from table.slice(0, len(same)).filter(pa.array(keep, pa.bool_())).to_batches()
        before, last = keys[-2] if len(same) else before, table.slice(len(same))
    if last is not None and len(last) and before == last.column("key")[0].as_py():
        yield from last.to_batches()


def _similar(width: int, threshold: tuple[int, int]):
    up, down = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            pairs = list(zip(binary(batch.column("text_a")), binary(batch.column("text_b")), strict=True))
            texts = list({text for pair in pairs for text in pair})  # a text is compared with many
            sets = dict(zip(texts, shingle_sets([text.lower() for text in texts], width, known), strict=True))
            keep = []
            for x, y in pairs:
                a, b = sets[x], sets[y]
                both = np.sort(np.concatenate([a, b]), kind="stable")  # merges the two
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(down * common >= up * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _may_match(x: str, y: str, threshold: tuple[int, int]) -> Column:
    """Whether the sizes allow a link, and this key can be the first common one of a linked pair.

    Before its first common element a set has only elements that the other one
    lacks, of which there are at most its size less the common elements needed.
    """
    up, down = threshold
    a, b = F.col(f"{x}n"), F.col(f"{y}n")
    common = F.ceil((a + b) * F.lit(up) / F.lit(up + down))

    def first(n: Column, at: Column) -> Column:
        return at <= n - common + 1

    return ((F.least(a, b) * down >= F.greatest(a, b) * up)
            & first(a, F.col(f"{x}at")) & first(b, F.col(f"{y}at")))


def _open_lists(lists: DataFrame, merged: DataFrame) -> tuple[DataFrame, int, int]:
    """(entries of lists with several components, pairs across components in them, entries in them)."""
    placed = lists.join(merged.withColumnRenamed("id", "cid"), "cid", "left").select(
        "key", "cid", "n", "at", F.coalesce("component", "cid").alias("component"))
    per_list = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
        F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count(F.lit(1)).alias("parts"))
    wanted = spool(per_list.where("parts > 1").select("key", "all", "squares"), "openkeys")
    cross, entries = wanted.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("squares")) / 2), F.lit(0.0)),
                                F.coalesce(F.sum("all"), F.lit(0))).first()
    return spool(placed.join(wanted.select("key"), "key"), "open"), int(cross), entries


def _star_pairs(open_: DataFrame, turn: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): the members of each list with one drawn for this list and turn, where not yet in its component."""
    drawn = F.min(F.struct(F.xxhash64("cid", "key", F.lit(turn)).alias("lot"), "cid", "n", "at", "component")).alias("head")
    heads = spool(open_.groupBy("key").agg(drawn), "heads")
    met = open_.join(heads, "key").where(F.col("component") != F.col("head.component")).where(
        _may_match("", "head.", threshold))
    return met.select(F.least("cid", "head.cid").alias("a"), F.greatest("cid", "head.cid").alias("b")).distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, bool, DataFrame]:
    """The rows (rid, id, text, row), whether rids are our own numbers, and (rid, n_shingles, component = smallest rid)."""
    spark = docs.sparkSession
    rows, numbered = identified(docs, id_col, text_col)
    texts = rows.select("rid", "text")
    profile = spool(texts.mapInArrow(_profile(width), _PROFILE), "profile")
    levels, list_length = class_levels(profile)
    sets = profile.where(F.col("n_shingles") > 0).select("rid", "n_shingles", "digest")
    # One record for each size that occurs, no more than there are words in the longest text.
    sizes = {r[0]: r[1] for r in sets.groupBy("n_shingles").count().collect()}
    heavy_from = boundary(sizes, list_length, threshold)

    # Written out, so that the join's sides are plain and a large class of copies can be split.
    classes = spool(sets.groupBy("digest").agg(F.min("rid").alias("cid")), "sets")
    members = spool(sets.join(classes, "digest").select("rid", "cid", F.col("n_shingles").alias("n")), "members")

    shared_levels = spark.sparkContext.broadcast(levels)  # 1 MB
    postings = texts.mapInArrow(_postings(shared_levels, heavy_from, width, threshold), _POSTING)
    # A key has at most a row for each document and is read row by row, so all of its rows may be in one task.
    met = spool(postings.repartition("key").sortWithinPartitions("key").mapInArrow(_met, _POSTING), "met")
    # Copies have the keys of their representative.
    firsts = members.where("rid = cid").select("cid", "n")
    found = spool(met.join(firsts, F.col("rid") == F.col("cid")).select("key", "cid", "n", "at"), "lists")
    discard(met)
    heads = found.groupBy("key").agg(F.min(F.struct("cid", "n", "at")).alias("head"), F.max("cid").alias("last"))
    heads = spool(heads.where("head.cid != last").select("key", "head"), "heads")
    lists = spool(found.join(heads, "key").select("key", "cid", "n", "at", "head"), "lists")
    discard(found, heads)

    needed = lists.select(F.col("cid").alias("rid")).distinct()
    read = spool(texts.join(needed, "rid").select(F.col("rid").alias("cid"), "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        a = read.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
        b = read.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return spool(both.mapInArrow(_similar(width, threshold), "a long, b long"), "links")

    tried = spool(lists.where(F.col("cid") != F.col("head.cid"))
                  .where(_may_match("", "head.", threshold))
                  .select(F.col("head.cid").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    links = verified(tried)
    merged = components(links)
    before, turn = float("inf"), 0
    while True:
        turn += 1
        open_, cross, entries = _open_lists(lists, merged)
        if cross <= LINEAR * entries or cross > WORTH * before:
            break
        before = cross
        pairs = _star_pairs(open_, turn, threshold).join(tried, ["a", "b"], "left_anti")
        pairs = spool(pairs, "stars")
        more = verified(pairs)
        tried, links = tried.union(pairs), links.union(more)
        merged = components(links)
    x, y = open_.alias("x"), open_.alias("y")
    rest = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
                   & _may_match("x.", "y.", threshold))
            .select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct())
    more = verified(rest.join(tried, ["a", "b"], "left_anti"))
    merged = components(links.union(more))

    ids = members.join(merged.withColumnRenamed("id", "cid"), "cid", "left").select(
        "rid", F.coalesce("component", "cid").alias("component"))
    every = profile.where(F.col("chunk").isNull()).select("rid", "n_shingles").join(ids, "rid", "left")
    every = spool(every.withColumn("component", F.coalesce("component", "rid")), "classes")
    discard(lists, read, open_, members, profile)
    return rows, numbered, every


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows with `n_shingles` and `component_id`, the smallest id that links reach (null where all are null)."""
    rows, numbered, classes = jaccard_classes(docs, id_col, text_col, width, threshold)
    if not numbered:
        light = classes.withColumnRenamed("component", "component_id")
    else:
        smallest = classes.join(rows.select("rid", "id"), "rid").groupBy("component").agg(F.min("id").alias("component_id"))
        light = classes.join(smallest, "component").select("rid", *RESULTS)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in RESULTS]
    return rows.join(light, "rid").select(*kept, *RESULTS)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates of one with a smaller id; empty texts all stay."""
    rows, numbered, classes = jaccard_classes(docs, id_col, text_col, width, threshold)
    first = classes.where(F.col("rid") == F.col("component")).select("rid")
    return rows.join(first, "rid", "left_semi").select("row.*")
