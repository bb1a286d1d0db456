"""The queries hand their operators whole rows and take the digests from what comes back."""

from __future__ import annotations

from corpusmill.llm import queries

SF = "/root/testdata/sf0.001"


def test_texts_are_sharded(spark, monkeypatch):
    given = []
    monkeypatch.setattr(queries, "shard_by_bytes", lambda docs, *a, f=queries.shard_by_bytes: given.append(docs.columns) or f(docs, *a))
    rows = queries.QUERIES["op4_sharding"](spark, SF)
    assert "text" in given[0] and rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_ids_are_carried_to_their_places(spark, monkeypatch):
    given = []
    monkeypatch.setattr(queries, "pack", lambda *a, f=queries.pack, **k: given.append(f(*a, **k)) or given[-1])
    out = queries.QUERIES["op3_best_fit_packing"](spark, SF)
    assert "ids" in given[0].columns and given[0].where("ids is null or crc32(ids) != ids_crc32").isEmpty()
    assert out.columns == [c for c in given[0].columns if c != "ids"]
