"""Token-aware clustering: every token type has its own centroids, as many as a shared budget allows it."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tail_class
from ..functions.vectors import dot
from .score import DIGITS, rerank
from .warp import with_fallback

BUDGET, LEAST, MOST = 200, 4, 39


def type_stats(tok: DataFrame) -> DataFrame:
    """(token_id, n, s, w, class): count, summed population variance of the components, damped weight sqrt(n) * s, class of size."""
    v = tok.select("token_id", array_to_vector("e").alias("_v")).groupBy("token_id").agg(F.count("*").alias("n"), Summarizer.variance(F.col("_v")).alias("_var"))
    total = F.aggregate(vector_to_array("_var"), F.lit(0.0), lambda x, y: x + y) * (F.col("n") - 1) / F.col("n")
    d = v.select("token_id", "n", F.when(total < 1e-12, 0.0).otherwise(total).alias("s"))
    return d.select("token_id", "n", "s", (F.sqrt("n") * F.col("s")).alias("w"), tail_class(F.col("n")).alias("class"))


def allocate(weights: DataFrame, budget: int = BUDGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(token_id, w, raw, k, floored, ceiled): each type's share of the budget, rounded and clamped; all least if no type weighs."""
    total = F.sum("w").over(Window.partitionBy())
    raw = F.when(total > 0, budget * F.col("w") / total).otherwise(F.lit(float(least)))
    d = weights.select("token_id", "w", raw.alias("raw"))
    return d.withColumn("k", F.least(F.greatest(F.round("raw"), F.lit(least)), F.lit(most)).cast("int")).withColumn("floored", F.round("raw") < least).withColumn("ceiled", F.round("raw") > most)


def reconcile(allocated: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """(token_id, w, k, kappa): what is left of the budget tops up types to ``most``, the heaviest first, ties to the smaller id."""
    before = Window.orderBy(F.desc("w"), "token_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(budget) - F.sum("k").over(Window.partitionBy()), F.lit(0))
    room = F.lit(most) - F.col("k")
    d = allocated.select("token_id", "w", "k", left.alias("_left"), F.coalesce(F.sum(room).over(before), F.lit(0)).alias("_used"))
    add = F.greatest(F.lit(0), F.least(room, F.col("_left") - F.col("_used")))
    return d.select("token_id", "w", "k", (F.col("k") + add).cast("int").alias("kappa"))


def budgets(tok: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(token_id, w, k, kappa) of a token table."""
    return reconcile(allocate(type_stats(tok), budget), budget)


def probe(q: DataFrame, type_centroids: DataFrame) -> DataFrame:
    """(qid, qpos, token_id, cid): the better half (one at least) of the centroids of each query token's own type."""
    c = type_centroids.withColumn("_n", F.count("*").over(Window.partitionBy("token_id")))
    s = q.join(c, "token_id").select("qid", "qpos", "token_id", "cid", "_n", F.round(dot(F.col("qe"), F.col("ce")), DIGITS).alias("sim"))
    w = Window.partitionBy("qid", "qpos").orderBy(F.desc("sim"), "cid")
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(1))).select("qid", "qpos", "token_id", "cid")


def candidates(q: DataFrame, type_centroids: DataFrame, type_postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct (qid, doc_id): listed under probed centroids; all documents for a query with a token of unknown type."""
    listed = probe(q, type_centroids).select("qid", "token_id", "cid").distinct().join(type_postings, ["token_id", "cid"]).select("qid", "doc_id")
    unlisted = q.join(type_centroids.select("token_id").distinct(), "token_id", "left_semi").join(type_postings.select("token_id").distinct(), "token_id", "left_anti")
    types = unlisted.select("qid", "token_id").join(docs.select("token_id", "doc_id").distinct(), "token_id").select("qid", "doc_id") if "token_id" in docs.columns else listed.limit(0)
    unknown = q.join(type_centroids.select("token_id").distinct(), "token_id", "left_anti").select("qid").distinct()
    every = docs.select("doc_id").distinct().crossJoin(unknown).select("qid", "doc_id")
    return listed.unionByName(types).unionByName(every).distinct()


def search(tok: DataFrame, q: DataFrame, type_centroids: DataFrame, type_postings: DataFrame, *, k: int = 10) -> DataFrame:
    found = candidates(q, type_centroids, type_postings, tok)
    return rerank(tok, q, with_fallback(found, q, tok), k)


def pq_levels(spark) -> DataFrame:
    """The three levels of the quantisation report: (level, subspaces, dims, code_bits)."""
    return spark.createDataFrame([(1, 128, 8, 1), (2, 64, 4, 1), (3, 32, 2, 1)], "level int, subspaces int, dims int, code_bits int")
