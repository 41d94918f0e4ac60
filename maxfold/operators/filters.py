"""Metadata filters on documents, per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed(meta: DataFrame, wants: DataFrame, *, mode: str = "category_year") -> DataFrame:
    """(qid, doc_id) that each query's filter lets through; ``wants``: qid, category, year_floor. mode: none, category, category_year."""
    if mode == "none":
        return meta.select("doc_id").crossJoin(wants.select("qid")).select("qid", "doc_id")
    d = meta.join(wants, "category")
    return (d.where(F.col("year") >= F.col("year_floor")) if mode == "category_year" else d).select("qid", "doc_id")


def keep_allowed(results: DataFrame, permitted: DataFrame) -> DataFrame:
    """Results that the filter permits, by document and query."""
    return results.join(permitted, ["qid", "doc_id"], "left_semi")


def union(permitted: DataFrame) -> DataFrame:
    """Documents that the filter of some query lets through."""
    return permitted.select("doc_id").distinct()
