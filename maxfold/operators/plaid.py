"""Centroid pruning: query tokens probe centroids, whose inverted lists give the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .score import DIGITS, checked_broadcast, rerank

CENTROIDS = 8


def default_probes(centroids: int = CENTROIDS) -> int:
    return max(2, centroids * 3 // 4)


def probe(q: DataFrame, centroids: DataFrame, n_probe: int) -> DataFrame:
    """(qid, qpos, cid, sim, rank): the n_probe most similar centroids of each query token, ties to the smaller cid."""
    s = q.crossJoin(checked_broadcast(centroids)).select("qid", "qpos", "cid", F.round(dot(F.col("qe"), F.col("ce")), DIGITS).alias("sim"))
    w = Window.partitionBy("qid", "qpos").orderBy(F.desc("sim"), "cid")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_probe)


def candidates(q: DataFrame, centroids: DataFrame, postings: DataFrame, n_probe: int) -> DataFrame:
    """Distinct (qid, doc_id) of the documents in the lists of the probed centroids."""
    probed = probe(q, centroids, n_probe).select("qid", "cid").distinct()
    return probed.join(postings, "cid").select("qid", "doc_id").distinct()


def search(tok: DataFrame, q: DataFrame, centroids: DataFrame, postings: DataFrame, *, k: int = 10, n_probe: int = default_probes()) -> DataFrame:
    """Exact MaxSim of the candidates; a query without candidates has no result."""
    return rerank(tok, q, candidates(q, centroids, postings, n_probe), k)


def pruned_counts(q: DataFrame, centroids: DataFrame, postings: DataFrame, n_docs: int, n_probe: int) -> DataFrame:
    """(qid, candidates, pruned)."""
    n = candidates(q, centroids, postings, n_probe).groupBy("qid").agg(F.count("*").alias("candidates"))
    n = q.select("qid").distinct().join(n, "qid", "left").select("qid", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    return n.withColumn("pruned", F.greatest(F.lit(n_docs) - F.col("candidates"), F.lit(0)).cast("long"))
