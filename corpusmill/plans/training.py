"""The reading-comprehension job: raw texts in, training rows in splits out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import comprehension as rc
from corpusmill.operators import splits as sp
from corpusmill.operators.search import vocab_specific
from corpusmill.session import spool
from corpusmill.sources import writers

NAMES = {"text": "reading_comprehension_texts", "question": "reading_comprehension_texts_q",
         "answer": "reading_comprehension_texts_a"}


def training_rows(raw: DataFrame, domain: str, general: DataFrame | None = None, input_name: str = "input") -> DataFrame:
    """(id, raw_texts, …) for raw rows (id, raw_texts); words that the general texts lack mark the domain."""
    texts = raw.select(F.col("id").alias("text_id"), F.col("raw_texts").alias("text"))
    vocabulary = None
    if general is not None:
        vocabulary = spool(vocab_specific(texts, general), "words")
    rows = rc.reading_comprehension(texts, domain, vocabulary, input_name)
    named = rows.select(F.col("text_id").alias("id"), *[F.col(c).alias(n) for c, n in NAMES.items()])
    return raw.join(named, "id")


def write_training_splits(rows: DataFrame, path: str, test_size: float = 0.2) -> str:
    """Train, validation and test rows in one folder each."""
    return writers.write_splits(sp.split_train_val_test(rows, "id", test_size), path)
