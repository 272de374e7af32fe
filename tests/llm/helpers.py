from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    """documents of these texts, with extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    own = spark.createDataFrame(rows, DOCS)
    return own.selectExpr("*", "1 AS n", "'x' AS fp", "2.5 AS score", "'z' AS bucket", "'q' AS `a.b`", "'r' AS row", "7 AS rank")


def words(rng: random.Random, n: int, vocabulary: int = 500) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
