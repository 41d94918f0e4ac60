"""Centroids of token vectors: assignment, Lloyd steps, grouped clustering, posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, hash_uniform, matrix, mean_by
from .score import DIGITS, checked_broadcast

#: Numbers of centroids that one pass over the tokens carries.
CELLS = 4_000_000
#: Centroids of a type without a budget of its own.
KAPPA = 4


def assign(tok: DataFrame, centroids: DataFrame) -> DataFrame:
    """``tok`` with the cid of the most similar centroid, the largest cid of equal ones, and its similarity ``csim``.

    Tokens are not shuffled: each Arrow batch meets the centroids, CELLS numbers of these in one pass, the rest in further
    passes. Without centroids no token is assigned.
    """
    rows = centroids.select("cid", "ce").orderBy(F.desc("cid")).collect()
    step = max(1, CELLS // max(1, len(rows[0]["ce"]) if rows else 1))
    out = tok.withColumn("cid", F.lit(None).cast("int")).withColumn("csim", F.lit(None).cast("double"))
    for i in range(0, len(rows), step):
        out = _nearer(out, rows[i : i + step])
    return out.where("cid is not null")


def _nearer(tok: DataFrame, rows: list) -> DataFrame:
    """``tok`` with cid and csim of these centroids (falling cid) where they are more similar: a matrix product per Arrow batch."""
    ids, c = np.array([r["cid"] for r in rows], np.int32), np.array([r["ce"] for r in rows], float).T
    e, cid, csim = (tok.columns.index(x) for x in ("e", "cid", "csim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sims = np.round(matrix(b.column(e)) @ c, DIGITS)
            at = sims.argmax(1)
            best = sims[np.arange(len(at)), at]
            known, before = b.column(cid), b.column(csim).to_numpy(zero_copy_only=False)
            better = ~(before >= best)  # also where none is known; an equal one of a larger cid stays
            ours = np.where(better, ids[at], known.fill_null(0).to_numpy(zero_copy_only=False))
            b = b.set_column(cid, "cid", pa.array(ours, pa.int32())).set_column(csim, "csim", pa.array(np.where(better, best, before)))
            yield b

    return tok.mapInArrow(run, tok.schema)


def lloyd_step(tok: DataFrame, centroids: DataFrame, *, empty: str = "keep") -> DataFrame:
    """One step: each centroid becomes the unit mean of its tokens; an empty one stays ('keep') or becomes zero ('zero')."""
    means = mean_by(assign(tok, centroids), ["cid"], "e", "_m")
    old = F.col("ce") if empty == "keep" else F.transform("ce", lambda x: x * 0.0)
    return centroids.join(means, "cid", "left").select("cid", F.coalesce("_m", old).alias("ce"))


def initial(tok: DataFrame, k: int, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """k tokens (or all, if fewer) in seeded hash order, as centroids."""
    picked = tok.orderBy(hash_uniform(F.lit(str(seed)), F.col(key).cast("string")), key).limit(k)
    rows = picked.select("e").collect()  # k vectors
    return tok.sparkSession.createDataFrame([(i, r["e"]) for i, r in enumerate(rows)], "cid int, ce array<double>")


def fit(tok: DataFrame, k: int, *, iters: int = 100, tolerance: float = 1e-6, empty: str = "keep", seed: int = 42, key: str = "vec_id") -> DataFrame:
    """Spherical k-means; only the k centroids come to the driver after each step, so lineage does not grow."""
    spark, c = tok.sparkSession, initial(tok, k, seed, key)
    for _ in range(iters):
        old = {r["cid"]: r["ce"] for r in c.collect()}
        rows = lloyd_step(tok, c, empty=empty).collect()
        c = spark.createDataFrame([(r["cid"], r["ce"]) for r in rows], "cid int, ce array<double>")
        if all(sum(abs(x - y) for x, y in zip(r["ce"], old[r["cid"]], strict=True)) <= tolerance for r in rows):
            break
    return c


def sample(tok: DataFrame, n: int, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """A reproducible training sample of n tokens."""
    return tok.orderBy(hash_uniform(F.lit(str(seed)), F.col(key).cast("string")), key).limit(n)


def postings(assigned: DataFrame) -> DataFrame:
    """Distinct (cid, doc_id): the inverted lists."""
    return assigned.select("cid", "doc_id").distinct()


def cluster_types(tok: DataFrame, budgets: DataFrame, *, iters: int = 50, seed: int = 0xCAFEBABE, tolerance: float = 1e-6) -> DataFrame:
    """(token_id, cid, ce): each token type clustered into its own kappa centroids (``budgets``: token_id, kappa; KAPPA if null).

    All of a type's tokens take part: a step sums them per (token_id, cid) before the shuffle. A type stays as it is once
    its centroids move no more; only centroids come to the driver.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("token_id").orderBy(hash_uniform(F.lit(str(seed)), F.col("vec_id").cast("string")), "vec_id")
    budgets = budgets.select("token_id", F.coalesce("kappa", F.lit(KAPPA)).alias("kappa"))
    most = int(budgets.agg(F.max("kappa")).first()[0] or 0)
    first = tok.select("token_id", "vec_id", "e").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    first = first.join(budgets.select("token_id", "kappa"), "token_id").where(F.col("_r") <= F.col("kappa"))
    spark, schema = tok.sparkSession, "token_id long, cid int, ce array<double>"
    done, moving = {}, {(r["token_id"], r["_r"] - 1): r["e"] for r in first.select("token_id", "_r", "e").collect()}
    for _ in range(iters):
        if not moving:
            break
        c = spark.createDataFrame([(t, j, e) for (t, j), e in moving.items()], schema)
        sim = F.round(dot(F.col("e"), F.col("ce")), DIGITS)
        near = tok.select("token_id", "vec_id", "e").join(checked_broadcast(c), "token_id")
        near = near.groupBy("token_id", "vec_id").agg(F.max(F.struct(sim.alias("s"), (-F.col("cid")).alias("n"))).alias("_b"), F.first("e").alias("e"))
        means = mean_by(near.select("token_id", (-F.col("_b.n")).alias("cid"), "e"), ["token_id", "cid"], "e", "m")
        new = moving | {(r["token_id"], r["cid"]): r["m"] for r in means.collect()}
        moved = {t for (t, j), e in new.items() if sum(abs(x - y) for x, y in zip(e, moving[t, j], strict=True)) > tolerance}
        done |= {k: e for k, e in new.items() if k[0] not in moved}
        moving = {k: e for k, e in new.items() if k[0] in moved}
    return spark.createDataFrame([(t, j, e) for (t, j), e in (done | moving).items()], schema)


def first_vectors(tok: DataFrame, budgets: DataFrame) -> DataFrame:
    """The first min(kappa, n) vectors of each type by vec_id, as its centroids: no iteration."""
    from pyspark.sql import Window

    w = Window.partitionBy("token_id").orderBy("vec_id")
    d = tok.withColumn("_r", F.row_number().over(w)).join(budgets.select("token_id", "kappa"), "token_id").where(F.col("_r") <= F.col("kappa"))
    return d.select("token_id", (F.col("_r") - 1).cast("int").alias("cid"), F.col("e").alias("ce"))


def assign_types(tok: DataFrame, type_centroids: DataFrame) -> DataFrame:
    """(token_id, cid, doc_id), distinct: tokens assigned among the centroids of their own type, the largest cid of equal ones."""
    c = type_centroids.select("token_id", "cid", "ce")
    sim = F.round(dot(F.col("e"), F.col("ce")), DIGITS)
    best = tok.join(c, "token_id").groupBy("token_id", "doc_id", "vec_id").agg(F.max(F.struct(sim.alias("s"), "cid")).alias("_b"))
    return best.select("token_id", F.col("_b.cid").alias("cid"), "doc_id").distinct()
