"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix holds this share of all words; a source is taken this many times at most.
SHARE, MAX_EPOCHS = 1.5, 2.0
#: Sampling weights of labelled good, unlabelled and labelled bad documents.
GOOD, UNKNOWN, BAD = 2.0, 1.0, 0.5
#: Buckets of the key axis; only a source's boundary bucket is sorted row by row.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09-\\x0D; null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A reproducible number in (0, 1): 52 bits of the id's MD5, or of the text's where the id is null."""
    digest = F.coalesce(F.md5(doc_id.cast("string").cast("binary")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, w): one row per labelled document; where labels conflict the larger counts."""
    q = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return q.select("doc_id", F.when(F.col("q") >= 1, GOOD).otherwise(BAD).alias("w"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weighted water filling in closed form: sources in the order of cap/weight; the level is the largest
    (rest of the total)/(rest of the weights) that does not exceed the next source's cap/weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (
        sizes.withColumn("_w", w)
        .withColumn("_cap", max_epochs * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_rest", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)))
        .withColumn("_rest_w", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0)))
        .withColumn("_level", F.col("_rest") / F.col("_rest_w"))
        .withColumn("_top", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    )
    return s.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.coalesce("_top", F.lit(0.0))).alias("target"))


def keyed(docs: DataFrame, quality: DataFrame | None = None, *, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, _key, _b, and the columns ``carry``): documents with their exponential key and its bucket.

    Rows without an id have no label, so they are not joined: a third of all rows without one costs no single task.
    """
    d = docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"), F.log(uniform(F.col("doc_id"), F.col("text"))).alias("_log"))
    if quality is None:
        d = d.withColumn("_w", F.lit(UNKNOWN))
    else:
        weights = quality.select("doc_id", F.col("w").alias("_w"))
        weights = weights.hint("merge") if carry else weights  # labels grow with the documents: whole rows meet them alike at every size
        known = d.where("doc_id is not null").join(weights, "doc_id", "left").select(*d.columns, "_w")
        d = known.unionByName(d.where("doc_id is null").withColumn("_w", F.lit(None).cast("double"))).withColumn("_w", F.coalesce("_w", F.lit(UNKNOWN)))
    # 1 - exp(-key) orders as the exponential key does and lies in [0, 1)
    at = F.least(F.floor((1.0 - F.exp(F.col("_log") / F.col("_w"))) * buckets), F.lit(buckets - 1)).cast("int")
    return d.select("doc_id", "source", *carry, "size", (-F.col("_log") / F.col("_w")).alias("_key"), at.alias("_b"))


def mix_plan(d: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source of the keyed table ``d``: what with_taken() needs to say how much of a document is taken.

    Sums per (source, bucket) give each bucket's prefix, so only rows of the one bucket in which a source's budget ends
    are sorted, and a source with a third of all rows costs no single task. ``_cut`` is the place of the first group of
    equal rows that is not taken whole; each of that group gives ``_part`` words.
    """
    in_bucket = d.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    s = source_targets(in_bucket.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, max_epochs)
    s = s.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size")).withColumnRenamed("source", "_s")
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = (
        in_bucket.withColumn("_before", before)
        .join(s.select("_s", "_left"), F.col("source").eqNullSafe(F.col("_s")))
        .where(F.col("_before") + F.col("_sum") > F.col("_left"))
        .groupBy("_s", "_left")
        .agg(F.min("_b").alias("_edge"), F.min_by("_before", "_b").alias("_edge_before"))
    )
    edge = materialize(edge, "mix-edges")
    rows = d.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_edge")))
    groups = rows.groupBy("_s", "_left", "_edge_before", "_key", "doc_id", "size").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_s").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.col("_edge_before") + F.coalesce(F.sum(F.col("size") * F.col("_n")).over(w), F.lit(0)))
    whole = F.when(F.col("_n") == 1, 2 * F.col("_before") + F.col("size") <= 2 * F.col("_left")).otherwise(F.col("_before") + F.col("size") * F.col("_n") <= F.col("_left"))
    part = F.when(F.col("_n") > 1, F.greatest(F.floor((F.col("_left") - F.col("_before")) / F.col("_n")), F.lit(0))).otherwise(0).cast("long")
    first = groups.where(~whole).groupBy("_s").agg(F.min(F.struct(F.struct("_key", "doc_id", "size").alias("at"), part.alias("part"))).alias("_c"))
    first = first.select(F.col("_s").alias("_s2"), F.col("_c.at").alias("_cut"), F.col("_c.part").alias("_part"))
    plan = s.join(edge.select(F.col("_s").alias("_s3"), "_edge"), F.col("_s").eqNullSafe(F.col("_s3")), "left")
    plan = plan.join(first, F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2", "_s3")
    return materialize(plan, "mix-plan")


def with_taken(d: DataFrame, plan: DataFrame) -> DataFrame:
    """The keyed table ``d`` without its keys, with source_size, target and taken."""
    at, here = d.join(plan, F.col("source").eqNullSafe(F.col("_s"))), F.struct("_key", "doc_id", "size")
    inside = F.col("_edge").isNull() | (F.col("_b") < F.col("_edge"))
    picked = F.when(F.col("_left") <= 0, 0).when(inside, F.col("size")).when(F.col("_b") > F.col("_edge"), 0)
    picked = picked.when(F.col("_cut").isNull() | (here < F.col("_cut")), F.col("size")).when(here == F.col("_cut"), F.col("_part")).otherwise(0)
    out = at.withColumn("taken", (F.col("size") * F.col("_epochs") + picked).cast("long"))
    return out.drop("_key", "_b", "_s", "_epochs", "_left", "_edge", "_cut", "_part")


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken).

    ``docs`` has doc_id, source and text; ``quality`` has (doc_id, w), absent documents weigh 1. A source's complete
    epochs take all its documents; what is left of its target goes to documents in the order of the exponential
    key -ln(u)/w, up to the prefix sum of sizes that comes nearest to it. Whole documents are taken, but of rows that are
    equal in key, id and size, and which the budget does not hold together, each gives an equal part of what is left.

    Null or empty text: size 0, taken 0. A null source is a source, the last one. Rows without an id draw their key from
    their text. Repeated rows count as often as they occur. An empty table gives no rows. Other columns are ignored.
    """
    d = materialize(keyed(docs, quality, buckets=buckets), "mix")
    return with_taken(d, mix_plan(d, weights, share, max_epochs)).select("doc_id", "source", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH q AS (SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS w FROM labels
           WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT documents.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        -ln((('0x' || substr(coalesce(md5(documents.doc_id::VARCHAR), md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
          / coalesce(q.w, 1.0::DOUBLE) AS k
      FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
       FROM s2 WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT source, source_size, least(cap, w * coalesce(max(CASE WHEN lev <= ratio THEN lev END) OVER (), 0.0)) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s4),
g AS (SELECT source, k, doc_id, size, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT g.source, k, doc_id, size, n, source_size, target, epochs, target - epochs * source_size AS left_,
        coalesce(sum(size * n) OVER (PARTITION BY g.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM g JOIN s5 ON g.source IS NOT DISTINCT FROM s5.source),
y AS (SELECT *, CASE WHEN left_ <= 0 THEN 0 WHEN n = 1 THEN CASE WHEN 2 * before + size <= 2 * left_ THEN size ELSE 0 END
        WHEN before + n * size <= left_ THEN size ELSE greatest(floor((left_ - before) / n), 0) END AS picked FROM x)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, (size * epochs + picked)::BIGINT AS taken FROM (SELECT *, unnest(range(n)) AS i FROM y)
"""
