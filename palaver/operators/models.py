"""Hooks for models: a callable on batches of texts, and native stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters
from .search import words


def embed_batch(df: DataFrame, text: str, fn: Callable[[list[str]], list[list[float]]] | None = None, *, model: str, dim: int = 64) -> DataFrame:
    """Adds ``embedding`` and ``model_version``: by a callable on batches of texts, else by hashed words."""
    if fn is None:
        slots = F.transform(words(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
        vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("float"))
    else:

        @F.pandas_udf("array<float>")
        def vector_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(fn(texts.tolist()))

        vector = vector_of(F.coalesce(text, F.lit("")))
    return df.withColumns({"embedding": vector, "model_version": F.lit(model)})


def classify_batch(df: DataFrame, key: str, text: str, keywords: DataFrame, *, model: str) -> DataFrame:
    """Tags of each text by a keyword dictionary (``word``, ``tag``): ``key``, ``tag``, ``model_version``."""
    each = df.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    return each.join(keywords, "word").select(key, "tag", F.lit(model).alias("model_version")).distinct()


def reenrich(
    entities: DataFrame, texts: DataFrame, text: str, keywords: DataFrame, *, embed_model: str, classify_model: str, cutoff: str,
    fn: Callable[[list[str]], list[list[float]]] | None = None,
) -> DataFrame:
    """Selective re-run after a model's upgrade; the other entities are untouched.

    ``entities`` has ``message_id``, ``state``, ``indexed_at``, ``embedding``, ``embed_version``, ``tags``, ``classify_version``.
    Enriched ones of another embedding model that were indexed before the cutoff are embedded and classified anew, those of
    another classifier only classified.  Entities without a text stay as they are.
    """
    key, columns = "message_id", ["message_id", "state", "indexed_at", "embedding", "embed_version", "tags", "classify_version"]
    own = texts.select(key, text)
    old_vector = filters.invalidated(entities, "embed_version", embed_model, cutoff).select(key).join(own, key)
    old_tags = filters.invalidated(entities, "classify_version", classify_model, cutoff).select(key)
    again = old_vector.select(key).unionAll(old_tags.join(own.select(key), key, "left_semi")).distinct().join(own, key)
    tagged = classify_batch(again, key, text, keywords, model=classify_model).groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("new_tags"))
    vectors = embed_batch(old_vector, text, fn, model=embed_model).select(key, F.col("embedding").alias("new_vector"), F.col("model_version").alias("new_model"))
    marked = entities.join(again.select(key, F.lit(True).alias("again")), key, "left").join(vectors, key, "left").join(tagged, key, "left")
    told = marked.withColumns(
        {
            "embedding": F.coalesce("new_vector", "embedding"),
            "embed_version": F.coalesce("new_model", "embed_version"),
            "tags": F.when(F.col("again"), F.coalesce("new_tags", F.array().cast("array<string>"))).otherwise(F.col("tags")),
            "classify_version": F.when(F.col("again"), F.lit(classify_model)).otherwise(F.col("classify_version")),
        }
    )
    return told.select(*columns)
