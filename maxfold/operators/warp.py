"""Threshold gathering: documents whose best token similarity passes a threshold, up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import checked_broadcast, maxsim, rerank, batched_maxima, top_k

THRESHOLD, BOUND = 0.3, 100


def scores(maxima: DataFrame) -> DataFrame:
    """(qid, doc_id, score): the best similarity of any token pair."""
    return maxima.groupBy("qid", "doc_id").agg(F.max("m").alias("score"))


def gather(maxima: DataFrame, threshold: float = THRESHOLD, bound: int = BOUND) -> DataFrame:
    """(qid, doc_id, score, rank) strictly above the threshold, the best ``bound`` of a query."""
    return top_k(scores(maxima).where(F.col("score") > threshold), bound)


def gather_stats(maxima: DataFrame, queries: DataFrame, n_docs: int, threshold: float = THRESHOLD, bound: int = BOUND) -> DataFrame:
    """(qid, gathered, fraction): 0 of nothing is 0."""
    n = gather(maxima, threshold, bound).groupBy("qid").agg(F.count("*").alias("gathered"))
    n = queries.select("qid").distinct().join(n, "qid", "left").select("qid", F.coalesce("gathered", F.lit(0)).alias("gathered"))
    return n.withColumn("fraction", F.coalesce(F.col("gathered") / F.nullif(F.lit(float(n_docs)), F.lit(0.0)), F.lit(0.0)))


def with_fallback(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates, and all documents for a query without any."""
    empty = queries.select("qid").distinct().join(candidates, "qid", "left_anti")
    every = docs.select("doc_id").distinct().crossJoin(checked_broadcast(empty)).select("qid", "doc_id")
    return candidates.select("qid", "doc_id").unionByName(every)


def search(tok: DataFrame, q: DataFrame, *, k: int = 10, threshold: float = THRESHOLD, bound: int = BOUND) -> DataFrame:
    """Gathering and refining share one pass of row maxima; only queries that gathered nothing are scored against all."""
    m = batched_maxima(tok, q)
    found = gather(m, threshold, bound).select("qid", "doc_id")
    return top_k(maxsim(m.join(with_fallback(found, q, tok), ["qid", "doc_id"])), k)


__all__ = ["BOUND", "THRESHOLD", "gather", "gather_stats", "rerank", "scores", "search", "with_fallback"]
