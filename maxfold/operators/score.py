"""Late-interaction scoring: similarities of query and document tokens, MaxSim, top-k.

``tok`` has (doc_id, pos, token_id, e), ``q`` has (qid, qpos, token_id, qe) and optionally w. The query side is the
small one: it is broadcast when its size is under a limit, otherwise the join is left to Catalyst in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_weights
from ..functions.vectors import dot, matrix

#: A side of a join or a block of queries is broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20
#: Similarities are rounded to this many digits before they are compared, so that order does not hang on summation.
DIGITS = 9


def weight(df: DataFrame) -> int:
    """Bytes of ``df`` about: 64 a row and 8 a vector component. One job over it."""
    parts = [F.sum(F.size(f.name)) for f in df.schema if f.dataType.typeName() == "array"]
    rows = df.agg(F.count("*"), *parts).first()
    return 64 * rows[0] + 8 * sum(x or 0 for x in rows[1:])


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it weighs at most ``limit`` bytes, else as it is: joins by key are then shuffled."""
    return F.broadcast(df) if weight(df) <= limit else df


def in_blocks(df: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """``df`` dealt by the hash of ``key`` into parts of about ``limit`` bytes, each to be broadcast in a pass of its own."""
    n = max(1, -(-weight(df) // limit))
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def similarities(tok: DataFrame, q: DataFrame) -> DataFrame:
    """Every query token by every document token: (qid, qpos, [w,] doc_id, pos, sim)."""
    extra = ["w"] if "w" in q.columns else []
    t, out = tok.select("doc_id", "pos", "e"), None
    for block in in_blocks(q.select("qid", "qpos", "qe", *extra), "qid"):
        both = t.crossJoin(F.broadcast(block)).select("qid", "qpos", *extra, "doc_id", "pos", F.round(dot(F.col("e"), F.col("qe")), DIGITS).alias("sim"))
        out = both if out is None else out.unionByName(both)
    return out


def row_maxima(sims: DataFrame) -> DataFrame:
    """(qid, qpos, [w,] doc_id, m): each query token's best similarity in each document."""
    extra = ["w"] if "w" in sims.columns else []
    return sims.groupBy("qid", "qpos", *extra, "doc_id").agg(F.max("sim").alias("m"))


def maxsim(maxima: DataFrame) -> DataFrame:
    """(qid, doc_id, score): the sum of the maxima, weighted where ``w`` is known (a missing weight is 1)."""
    m = F.coalesce("w", F.lit(1.0)) * F.col("m") if "w" in maxima.columns else F.col("m")
    return maxima.groupBy("qid", "doc_id").agg(F.round(F.sum(m), DIGITS).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "qid", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each query, ties to the smaller key, with their 1-based rank."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_unmatched(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Every query by every document, 0 where nothing matched (documents without tokens, queries without tokens)."""
    every = docs.select("doc_id").distinct().crossJoin(checked_broadcast(queries.select("qid").distinct()))
    return every.join(scores, ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def restrict(tok: DataFrame, candidates: DataFrame, q: DataFrame) -> DataFrame:
    """Similarities of candidate (qid, doc_id) pairs only: the documents are joined to their candidates, then to the query's tokens."""
    extra = ["w"] if "w" in q.columns else []
    t = tok.select("doc_id", "pos", "e").join(candidates.select("qid", "doc_id"), "doc_id")
    both = t.join(checked_broadcast(q.select("qid", "qpos", "qe", *extra)), "qid")
    return both.select("qid", "qpos", *extra, "doc_id", "pos", F.round(dot(F.col("e"), F.col("qe")), DIGITS).alias("sim"))


def search(tok: DataFrame, q: DataFrame, k: int = 10) -> DataFrame:
    """Exact search: (qid, rank, doc_id, score)."""
    return top_k(maxsim(batched_maxima(tok, q)), k)


def rerank(tok: DataFrame, q: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """Exact MaxSim of candidates, shared by all engines that prune."""
    return top_k(maxsim(row_maxima(restrict(tok, candidates, q))), k)


def batched_maxima(tok: DataFrame, q: DataFrame) -> DataFrame:
    """row_maxima(similarities()) by matrix products over Arrow batches: some ten times faster for many query tokens.

    Query tokens beyond BROADCAST_BYTES are dealt to blocks, each of which is a pass over the tokens. Maxima of a document
    whose tokens lie in several batches are joined by a last max().
    """
    out = None
    for block in in_blocks(q, "qid"):
        part = _block_maxima(tok, block)
        out = part if out is None else out.unionByName(part)
    return out


def _block_maxima(tok: DataFrame, q: DataFrame) -> DataFrame:
    extra = ["w"] if "w" in q.columns else []
    kinds = {"qid": q.schema["qid"].dataType, "qpos": q.schema["qpos"].dataType, "doc_id": tok.schema["doc_id"].dataType}
    rows = q.select("qid", "qpos", "qe").orderBy("qid", "qpos").collect()  # BROADCAST_BYTES about
    schema = "qid long, qpos long, doc_id long, m double"
    if not rows:
        empty = tok.sparkSession.createDataFrame([], schema).select(*[F.col(c).cast(t) for c, t in kinds.items()], "m").select("qid", "qpos", "doc_id", "m")
        return empty.withColumn("w", F.lit(None).cast("double")).select("qid", "qpos", "w", "doc_id", "m") if extra else empty
    m = np.array([r["qe"] for r in rows], float).T
    ids, pos = (np.array([r[c] for r in rows]) for c in ("qid", "qpos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            docs, of = np.unique(b.column(0).to_numpy(), return_inverse=True)
            order = np.argsort(of, kind="stable")
            best = np.maximum.reduceat((matrix(b.column(1)) @ m)[order], np.searchsorted(of[order], np.arange(len(docs))))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(docs))), pa.array(np.tile(pos, len(docs))), pa.array(np.repeat(docs, len(ids))), pa.array(best.ravel())], names=["qid", "qpos", "doc_id", "m"])

    out = tok.select(F.col("doc_id").cast("long"), "e").mapInArrow(run, schema).select(*[F.col(c).cast(t) for c, t in kinds.items()], "m")
    out = out.groupBy("qid", "qpos", "doc_id").agg(F.round(F.max("m"), DIGITS).alias("m"))
    return out.join(F.broadcast(q.select("qid", "qpos", "w")), ["qid", "qpos"]).select("qid", "qpos", "w", "doc_id", "m") if extra else out


def lexical(words: DataFrame, q: DataFrame, n_docs: int) -> DataFrame:
    """(qid, doc_id, score): the summed idf of the distinct words that a document shares with a query.

    ``words`` (doc_id, token), ``q`` (qid, token) distinct. Documents are passed over once: what holds a word of some query
    becomes postings, from which both the document frequencies and the scores come.
    """
    asked = checked_broadcast(q.select("token").distinct())
    postings = words.join(asked, "token", "left_semi").select("doc_id", "token").distinct()
    w = query_weights(q, postings.groupBy("token").agg(F.count("*").alias("df")), n_docs)
    return postings.join(checked_broadcast(w), "token").groupBy("qid", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
