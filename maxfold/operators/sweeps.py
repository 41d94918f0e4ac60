"""Recall against the share of documents scored: candidate sets of every engine by parameter, and the points they give."""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from . import kmeans, plaid, warp
from .evaluate import random_subset
from .score import DIGITS, checked_broadcast

#: Parameters of the sweeps.
PROBES = (1, 2, 3, 5, 8, 13, 21, 34)
RANDOM = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)
THRESHOLDS = (0.72, 0.69, 0.66, 0.63, 0.6, 0.57, 0.54, 0.51, 0.48, 0.45, 0.42, 0.38, 0.34, 0.29, 0.24, 0.18, 0.13)
JUDGED_THRESHOLDS = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4, 0.3, 0.2)
FILTERED_THRESHOLDS = (0.95, 0.85, 0.75, 0.65, 0.5, 0.35, 0.2, 0.1)
BEAMS = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1000, 2000, 5000)
JUDGED_BEAMS = (10, 20, 30, 50, 75, 100, 150, 200)


def params(values) -> Column:
    return F.explode(F.array(*[F.lit(float(x)) for x in values])).alias("param")


def admissible(beams, n_docs: int, k: int = 10) -> list[int]:
    """Beam widths that can hold k results and are no wider than the corpus."""
    return [x for x in beams if k <= x <= n_docs]


def random_candidates(docs: DataFrame, queries: DataFrame, ps=RANDOM, seed: int = 7) -> DataFrame:
    """(param, qid, doc_id): a Bernoulli subset of the documents for each share, the same for all queries."""
    picked = None
    for p in ps:
        part = random_subset(docs.select("doc_id"), seed, p).select(F.lit(float(p)).alias("param"), "doc_id")
        picked = part if picked is None else picked.unionByName(part)
    return picked.crossJoin(checked_broadcast(queries.select("qid"))).select("param", "qid", "doc_id")


def probe_candidates(q: DataFrame, centroids: DataFrame, postings: DataFrame, probes=PROBES) -> DataFrame:
    """(param, qid, doc_id): the lists of the param nearest centroids of each query token."""
    near = plaid.probe(q, centroids, max(probes)).select("qid", "cid", "rank", params(probes)).where("rank <= param")
    return near.select("param", "qid", "cid").distinct().join(postings, "cid").select("param", "qid", "doc_id").distinct()


def threshold_candidates(maxima: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(param, qid, doc_id): documents with a token pair more similar than the threshold."""
    return warp.scores(maxima).select("qid", "doc_id", "score", params(thresholds)).where("score > param").select("param", "qid", "doc_id")


def beam_candidates(ranked: DataFrame, beams) -> DataFrame:
    """(param, qid, doc_id): the param first documents of a ranking (qid, rank, doc_id)."""
    return ranked.select("qid", "rank", "doc_id", params(beams)).where("rank <= param").select("param", "qid", "doc_id") if beams else ranked.select(F.lit(0.0).alias("param"), "qid", "doc_id").limit(0)


def topic_centroids(tok: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """(topic, cid, ce): an index of its own for each topic (doc_id, topic), of the topic's first k tokens: no iteration."""
    w = Window.partitionBy("topic").orderBy("vec_id")
    d = tok.join(topics, "doc_id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return d.select("topic", (F.col("_r") - 1).cast("int").alias("cid"), F.col("e").alias("ce"))


def fitted_topic_centroids(tok: DataFrame, topics: DataFrame, budgets: DataFrame, **fit) -> DataFrame:
    """(topic, cid, ce): each topic's tokens clustered by themselves; ``budgets`` (topic, kappa), rarer topics having more."""
    of = tok.drop("token_id").join(topics, "doc_id").withColumnRenamed("topic", "token_id")
    return kmeans.cluster_types(of, budgets.withColumnRenamed("topic", "token_id"), **fit).withColumnRenamed("token_id", "topic")


def inverse_budgets(frequencies: DataFrame, total: int, least: int = 3) -> DataFrame:
    """(topic, kappa) in inverse proportion to the share ``freq`` of a topic, ``least`` at least."""
    share = (1.0 / F.col("freq")) / F.sum(1.0 / F.col("freq")).over(Window.partitionBy())
    return frequencies.select("topic", F.greatest(F.floor(total * share + 1e-9), F.lit(least)).cast("int").alias("kappa"))


def topic_postings(tok: DataFrame, topics: DataFrame, centroids: DataFrame) -> DataFrame:
    """(topic, cid, doc_id), distinct: tokens assigned among the centroids of their document's topic."""
    t = tok.drop("token_id").join(topics, "doc_id").withColumnRenamed("topic", "token_id")
    return kmeans.assign_types(t, centroids.withColumnRenamed("topic", "token_id")).withColumnRenamed("token_id", "topic")


def route(q: DataFrame, centroids: DataFrame) -> DataFrame:
    """(qid, qpos, topic): the topic that has the centroid nearest to a query token, the larger topic of equal ones."""
    s = q.crossJoin(checked_broadcast(centroids)).select("qid", "qpos", "topic", F.round(dot(F.col("qe"), F.col("ce")), DIGITS).alias("sim"))
    best = s.groupBy("qid", "qpos", "topic").agg(F.max("sim").alias("s")).groupBy("qid", "qpos").agg(F.max(F.struct("s", "topic")).alias("_b"))
    return best.select("qid", "qpos", F.col("_b.topic").alias("topic"))


def routed_candidates(q: DataFrame, centroids: DataFrame, postings: DataFrame, probes=PROBES) -> DataFrame:
    """(param, qid, doc_id): each query token probes the param nearest centroids of the topic it is routed to."""
    mine = q.join(route(q, centroids), ["qid", "qpos"]).join(checked_broadcast(centroids), "topic")
    w = Window.partitionBy("qid", "qpos").orderBy(F.desc("sim"), "cid")
    near = mine.select("qid", "qpos", "topic", "cid", F.round(dot(F.col("qe"), F.col("ce")), DIGITS).alias("sim")).withColumn("rank", F.row_number().over(w))
    near = near.select("qid", "topic", "cid", "rank", params(probes)).where("rank <= param").select("param", "qid", "topic", "cid").distinct()
    return near.join(postings, ["topic", "cid"]).select("param", "qid", "doc_id").distinct()


def with_first(candidates: DataFrame, grid: DataFrame, first: int = 0) -> DataFrame:
    """Candidates, and the first document alone for a (param, qid) of ``grid`` without any."""
    return candidates.unionByName(grid.join(candidates.select("param", "qid").distinct(), ["param", "qid"], "left_anti").select("param", "qid", F.lit(first).cast("long").alias("doc_id")))


def points(candidates: DataFrame, values, scores: DataFrame, truth: DataFrame, queries: DataFrame, n_docs: int | Fraction, *, k: int = 10, least: bool = False, first: int | None = 0, fixed: bool = True) -> DataFrame:
    """(param, frac, recall): means over ``queries`` of the share of documents scored, and of the truths among the k best of these.

    ``n_docs``: documents a query may see, in the mean. ``fixed`` divides hits by k, else by min(k, truths). ``least``: the
    share of a query is one document at least. ``first``: the document that a query without candidates falls back to, none
    if null. Counts are summed before they are divided: equal shares are equal numbers, in whatever order queries come.
    """
    spark, n_docs = candidates.sparkSession, Fraction(n_docs) or Fraction(1)
    grid = spark.createDataFrame([(float(x),) for x in values], "param double").crossJoin(queries.select("qid"))
    n = candidates.groupBy("param", "qid").agg(F.count("*").alias("_n"))
    share = grid.join(n, ["param", "qid"], "left").select("param", "qid", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(int(least))).alias("_n"))
    scored = (candidates if first is None else with_first(candidates, grid, first)).join(scores.select("qid", "doc_id", "score"), ["qid", "doc_id"])
    w = Window.partitionBy("param", "qid").orderBy(F.desc("score"), "doc_id")
    best = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    hits = best.join(truth.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").groupBy("param", "qid").agg(F.count("*").alias("_h"))
    of = truth.select("qid", "doc_id").distinct().groupBy("qid").agg(F.least(F.count("*"), F.lit(k)).alias("_of"))
    d = share.join(hits, ["param", "qid"], "left").join(of, "qid", "left")
    unit = float(lcm(*range(1, min(k, 22) + 1)))  # hits of a query are whole numbers of unit / min(k, truths)
    hit = F.coalesce(F.col("_h") * unit / (F.lit(float(k)) if fixed else F.col("_of")), F.lit(0.0))
    frac = F.sum("_n") * float(n_docs.denominator) / (F.count("*") * float(n_docs.numerator))
    return d.groupBy("param").agg(frac.alias("frac"), (F.sum(hit) / (F.count("*") * unit)).alias("recall"))


def drop_low(pts: DataFrame, over: float = 0.001) -> DataFrame:
    return pts.where(F.col("frac") > over)


def sorted_points(pts: DataFrame) -> DataFrame:
    """Points of a curve (engine, ...) in the order of frac; of points that agree in frac to six digits the first (least param) stays."""
    by = [c for c in pts.columns if c not in ("param", "frac", "recall")]
    w = Window.partitionBy(*by, F.floor(F.col("frac") * 1e6)).orderBy("frac", "param")
    return pts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def scan_sums(scores: DataFrame, shares=(1.0, 0.2, 0.05, 0.01)) -> DataFrame:
    """(qid, share, docs, total): the summed score of the first share of the documents (by doc_id, one at least)."""
    w = Window.partitionBy("qid").orderBy("doc_id")
    d = scores.select("qid", "doc_id", "score", F.count("*").over(Window.partitionBy("qid")).alias("_n"), F.row_number().over(w).alias("_i"))
    d = d.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    d = d.where(F.col("_i") <= F.greatest(F.floor(F.col("_n") * F.col("share") + 1e-9), F.lit(1)))
    return d.groupBy("qid", "share").agg(F.count("*").alias("docs"), F.sum("score").alias("total"))


def memory_bytes(docs: Column, tokens: Column | int, dim: int = 128, width: int = 4) -> Column:
    """Bytes of a token index held in memory."""
    return docs * tokens * dim * width


def upper_median(values: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """The element at n // 2 of the sorted values."""
    from .evaluate import percentile_ranks

    return percentile_ranks(values, value, (0.5,), by).drop("p")
