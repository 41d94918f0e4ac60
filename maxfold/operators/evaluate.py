"""Recall, precision, percentiles and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hash_uniform


def hits(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, hits, n_truth): truths among the first k results; truth: (qid, doc_id), all queries of the truth kept."""
    n = truth.groupBy("qid").agg(F.count("*").alias("n_truth"))
    h = results.where(F.col("rank") <= k).join(truth, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return n.join(h, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), "n_truth")


def recall_min(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hits / min(k, truths), 0 without truths."""
    h = hits(results, truth, k)
    return h.select("qid", F.coalesce(F.col("hits") / F.nullif(F.least(F.col("n_truth"), F.lit(k)), F.lit(0)), F.lit(0.0)).alias("recall"))


def recall_fixed(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hits / k."""
    return hits(results, truth, k).select("qid", (F.col("hits") / F.lit(float(k))).alias("recall"))


def hit_rates(results: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 10)) -> DataFrame:
    """One row: the share of queries whose expected document (qid, doc_id) is within the first k, as hit_<k>."""
    r = expected.join(results.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    return r.agg(*[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks])


def precision(results: DataFrame, truth: DataFrame) -> DataFrame:
    """hits / returned per query."""
    t = truth.select("qid", "doc_id", F.lit(1.0).alias("_t"))
    return results.join(t, ["qid", "doc_id"], "left").groupBy("qid").agg(F.avg(F.coalesce("_t", F.lit(0.0))).alias("precision"))


def percentile_ranks(values: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), by: str | None = None) -> DataFrame:
    """(by, p, value): exact nearest-rank percentiles, the row at floor(n * p) of the sorted values.

    Ranks come from a range-partitioned count per distinct value, so one hot group is no single sorted list.
    """
    g = [by] if by else []
    counts = values.where(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*g).orderBy(value)
    d = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*g)))
    d = d.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    at = F.least(F.floor(F.col("_n") * F.col("p")), F.col("_n") - 1)
    return d.where((F.col("_to") > at) & (F.col("_to") - F.col("_c") <= at)).select(*g, "p", F.col(value).alias("value"))


def merge_points(points: DataFrame) -> DataFrame:
    """(frac, recall) points that agree in frac to six digits become one, with the mean recall."""
    key = F.floor(F.col("frac") * 1e6 + 0.5).cast("long")
    return points.groupBy(key.alias("_k")).agg(F.min("frac").alias("frac"), F.avg("recall").alias("recall")).drop("_k")


def nearest_fraction(points: DataFrame, targets: DataFrame, factor: float = 2.5) -> DataFrame:
    """(target, recall): the recall at the point nearest to each target fraction, null beyond target * factor."""
    gap = F.abs(F.col("frac") - F.col("target"))
    d = targets.crossJoin(points).where(gap < F.col("target") * factor)
    best = d.groupBy("target").agg(F.min(F.struct(gap.alias("g"), "frac", "recall")).alias("_b"))
    return targets.join(best, "target", "left").select("target", F.col("_b.recall").alias("recall"))


def random_subset(docs: DataFrame, seed: int, p: float) -> DataFrame:
    """A reproducible Bernoulli subset of documents."""
    return docs.where(hash_uniform(F.lit(str(seed)), F.col("doc_id").cast("string")) < p)


def log_speedup(frac: Column) -> Column:
    return F.log2(1.0 / F.greatest(F.least(frac, F.lit(1.0)), F.lit(0.001)))


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): hits among the first k results of the first k truths (qid, rank, doc_id) over min(k, truths); NaN of none.

    Queries of either side are kept, so a query with results and no truth is 0 of 0.
    """
    t = truth.where(F.col("rank") <= k).select("qid", "doc_id")
    h = hits(results, t, k)
    every = results.select("qid").unionByName(truth.select("qid")).distinct()
    share = F.when(F.coalesce("n_truth", F.lit(0)) == 0, float("nan")).otherwise(F.col("hits") / F.least(F.col("n_truth"), F.lit(k)))
    return every.join(h, "qid", "left").select("qid", share.alias("recall"))


def rank_table(rows: DataFrame, by: str, key: str, first: int = 15) -> DataFrame:
    """The ``first`` rows by falling ``by``, ties to the smaller key, with their rank: a report."""
    top = rows.orderBy(F.desc(by), key).limit(first)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)))
