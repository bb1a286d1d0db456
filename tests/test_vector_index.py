from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import vector_index as vi
from corpusmill.operators.vector_index import VectorIndex, build_vector_index


def clustered(n=400, dim=6, seed=2):
    lots = np.random.default_rng(seed)
    centers = lots.normal(size=(12, dim)) * 20
    return np.round(centers[lots.integers(0, 12, n)] + lots.normal(size=(n, dim)), 3)


def brute(points, query, k):
    scores = np.round(((points - query) ** 2).sum(axis=1), 6)
    order = sorted(range(len(points)), key=lambda i: (scores[i], i))[:k]
    return [(i, scores[i]) for i in order]


def test_search_is_exact_and_reads_few_cells(spark, monkeypatch):
    points = clustered()
    points[10] = points[11] = points[12]  # ties
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(999, None)], "vec_id long, embedding array<double>")
    index = build_vector_index(vectors)
    asked = np.vstack([points[:20], clustered(5, seed=9), np.zeros((1, 6))])
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id int, vector array<double>")
    read = []
    plain = VectorIndex._near

    def counted(self, cells):
        read.append(cells.count())
        return plain(self, cells)

    monkeypatch.setattr(VectorIndex, "_near", counted)
    found = {}
    for r in index.search(queries, 7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, q in enumerate(asked):
        got = [(v, round(s, 6)) for _, v, s in sorted(found[i])]
        assert [v for v, _ in got] == [v for v, _ in brute(points, q, 7)]
        assert np.allclose([s for _, s in got], [s for _, s in brute(points, q, 7)], atol=2e-6)
    assert sum(read) < len(asked) * index.cells.count() / 2


def test_cells_outside_the_filter_are_not_scanned(spark):
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(clustered())], "vec_id long, embedding array<double>")
    index = build_vector_index(vectors, cells=9)
    some = index.vectors.where(F.col("cell").isin(1, 2))
    assert len(some.inputFiles()) >= len({f for f in some.select(F.col("_metadata.file_path")).distinct().toPandas().iloc[:, 0]}) > 0
    assert index.cells.agg(F.sum("n")).first()[0] == 400


def test_few_or_no_vectors(spark):
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [tuple(r) for r in build_vector_index(one).search(queries, 3).select("query_id", "vec_id", "score", "rank").collect()] == [(0, 5, 4.0, 1)]
    assert build_vector_index(one.limit(0)).search(queries, 3).collect() == []
    assert vi.MOST_CELLS >= 1
