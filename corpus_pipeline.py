"""The corpus pipeline: from raw documents to a mix for training.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. Nulls may stand in any column, rows may repeat, ids may be missing or shared by different texts, and docs
may have further columns of any name: these pass through every stage. An empty table gives an empty table. A stage's
result is written before the next stage begins. SQL cannot express the classifier, so ORACLE_SQL is None and the stages
are tested by brute force.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maxfold.llm import decontaminate, exactdup, mixing, neardup, quality
from maxfold.llm._common import materialize, owned, release, table

ORACLE_SQL = None
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that the stages read; a stage sees any other under a name of its own making.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Columns that the last stage adds; a column of documents with such a name is replaced.
ADDED = ("size", "target", "taken")


def stage(f: Stage) -> Stage:
    """Call the stage with the further columns renamed, so that no name can clash with one used inside."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c in COLUMNS else f"further_column_{i}" for i, c in enumerate(docs.columns)]
        names = dict(zip(inside, docs.columns, strict=True))
        out = f(spark, docs.toDF(*inside), sf_dir)
        added = {c.lower() for c in out.columns if c not in names}
        kept = [c for c in out.columns if c not in names or names[c].lower() not in added]
        return out.select(*kept).toDF(*[names.get(c, c) for c in kept])

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Every row is judged by itself, whatever its id; nulls are read as empty or are features of their own.
    """
    scored = quality.with_quality(docs, table(spark, sf_dir, "labels"), "_quality")
    return scored.where(F.col("_quality.score") >= quality.THRESHOLD).select(*docs.columns)


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate class; rows without a doc_id stay, rows equal in id and text once.

    The ids to drop are fewer than those to keep, so the anti-join has the smaller other side. Different texts under one
    doc_id are documents of their own: all but one of them go through the classes under an id that is not in use. A null
    or empty text is a class of its own.
    """
    with owned() as mine:
        known = docs.where("doc_id is not null")
        repeated = materialize(known.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "pipeline-repeated")
        if not repeated.take(1):
            dropped = neardup.near_duplicates(docs).where("doc_id != class_id").select(F.col("doc_id").alias("_id"))
            dropped = materialize(dropped, "pipeline-dropped")
            release(mine, keep=[dropped])
            return docs.join(dropped, F.col("doc_id") == F.col("_id"), "left_anti")
        digest = F.coalesce(F.sha2("text", 256), F.lit(""))
        texts = known.join(repeated, F.col("doc_id") == F.col("_id"), "left_semi").select(F.col("doc_id").alias("_id"), digest.alias("_d")).distinct()
        first = texts.groupBy(F.col("_id").alias("_f")).agg(F.min("_d").alias("_least"))
        others = texts.join(first, F.col("_id") == F.col("_f")).where("_d != _least").select("_id", "_d")
        ids = known.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
        free, step = (ids["most"] + 1, 1) if ids["most"] < 2**62 else (ids["least"] - 1, -1)
        others = materialize(others.withColumn("_key", F.lit(free) + F.lit(step) * F.monotonically_increasing_id()), "pipeline-same-id")
        at = (F.col("doc_id") == F.col("_id")) & (digest == F.col("_d"))
        rowed = known.join(others, at, "left").withColumn("_row", F.coalesce("_key", "doc_id")).select(*docs.columns, "_row")
        rowed = materialize(rowed.dropDuplicates(["_row"]), "pipeline-rows")
        classes = materialize(neardup.near_duplicates(rowed.select(F.col("_row").alias("doc_id"), "text")), "pipeline-classes")
        named = classes.join(others.select("_id", "_key"), F.col("doc_id") == F.col("_key"), "left").select(F.col("doc_id").alias("_r"), "class_id", F.coalesce("_id", "doc_id").alias("_id"))
        kept = named.groupBy("class_id").agg(F.min(F.struct("_id", "_r")).alias("_k")).select(F.col("class_id").alias("_c"), F.col("_k._r").alias("_kept"))
        dropped = materialize(named.join(kept, F.col("class_id") == F.col("_c")).where("_r != _kept").select("_r"), "pipeline-dropped")
        release(mine, keep=[rowed, dropped])
    one = rowed.join(dropped, F.col("_row") == F.col("_r"), "left_anti").select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


@stage
def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that also start earlier; see exactdup.strip_repeats() for nulls, ties and repeats."""
    return exactdup.strip_repeats(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Every row is judged by itself, whatever its id; a null or empty text holds none."""
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), "_leaks")
    return found.where(F.size("_leaks") == 0).select(*docs.columns)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size, their source's target and the words taken (twice the size: two epochs).

    Documents are weighed by their labels: the mix is a native operator, so the Python classifier is not run again here.
    Texts without words are not taken; rows without an id or a source are mixed like any other (see mixing.mix_sources).
    """
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    plan = mixing.mix_plan(materialize(mixing.keyed(docs, weights), "mix"))
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    return mixing.with_taken(mixing.keyed(docs, weights, carry=others), plan).where("taken > 0").select(*docs.columns, *ADDED)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages, each stage's result written as Parquet and read again, and what the stage wrote besides deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        with owned() as mine:
            docs = materialize(step(spark, docs, sf_dir), f"stage-{name}")
        release(mine, keep=[docs])
        if before:
            release(before)
        before = mine
    return STAGES[-1][1](spark, docs, sf_dir)
