"""The engines behind one interface: index, query, inspect, verify, trace."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import hash_vector, mean_by, preview
from ..operators import dense, kmeans, plaid, score, tac, warp

#: The engines' names.
ENGINES = ("hnsw", "colbert", "plaid", "warp", "tac")
DIM = 128


class Engine:
    """A corpus of (doc_id, text) and one way to search it. Types are encoded by a seeded projection unless an encoder is given.

    Texts are cut into words, or into WordPiece tokens where a vocabulary (a file, or its pieces) is given.

    ``encoder(tokens: DataFrame with token) -> DataFrame (token, e)`` embeds distinct tokens, each once.
    """

    def __init__(self, spark: SparkSession, name: str, *, dim: int = DIM, encoder=None, vocabulary: str | list[str] | None = None):
        if name not in ENGINES:
            raise ValueError(f"unknown engine {name}: one of {', '.join(ENGINES)}")
        self.spark, self.name, self.dim, self.encoder, self.vocabulary = spark, name, dim, encoder, vocabulary
        self.docs: DataFrame | None = None
        self.held: list[DataFrame] = []
        self.events: list[tuple[int, str, str]] = []

    def trace(self, stage: str, **payload) -> None:
        self.events.append((int(time.time() * 1000), stage, json.dumps(payload, default=str)))

    def trace_table(self, *stages: str) -> DataFrame:
        """(seq, ts_ms, stage, payload): what happened, in order; only the given stages if any are."""
        rows = [(i, *e) for i, e in enumerate(self.events) if not stages or e[1] in stages]
        return self.spark.createDataFrame(rows, "seq int, ts_ms long, stage string, payload string")

    def encode(self, docs: DataFrame, key: str) -> DataFrame:
        tok = tx.tokenize(docs, key) if self.vocabulary is None else tx.wordpiece(docs, self.vocabulary, key).drop("token_id")
        types = tok.select("token").distinct()
        types = self.encoder(types) if self.encoder else types.withColumn("e", hash_vector(F.col("token"), self.dim))
        return tok.join(types, "token").withColumn("token_id", F.xxhash64("token"))

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` cached until the next index()."""
        self.held.append(df.cache())
        return self.held[-1]

    def index(self, docs: DataFrame) -> Engine:
        """Add documents; one with a known doc_id replaces it. What the last index() cached is given up."""
        while self.held:
            self.held.pop().unpersist()
        docs = docs.select("doc_id", "text")
        if self.docs is not None:
            docs = docs.unionByName(self.docs.join(docs, "doc_id", "left_anti"))
        self.docs = docs
        self.tok = self.encode(docs, "doc_id").withColumn("vec_id", F.xxhash64("doc_id", "pos"))
        self.keep(self.tok)
        self.n_docs = docs.count()
        self.df = self.keep(tx.document_frequency(self.tok))
        self.trace("Tokenize", documents=self.n_docs)
        if self.name == "plaid":
            self.centroids = kmeans.fit(self.tok, plaid.CENTROIDS)
            self.postings = self.keep(kmeans.postings(kmeans.assign(self.tok, self.centroids)))
            self.trace("CentroidAssign", centroids=plaid.CENTROIDS)
        if self.name == "tac":
            self.stats = tac.type_stats(self.tok)
            self.kappa = self.keep(tac.reconcile(tac.allocate(self.stats)))
            self.type_centroids = self.keep(kmeans.cluster_types(self.tok, self.kappa))
            self.type_postings = self.keep(kmeans.assign_types(self.tok, self.type_centroids))
            self.trace("BudgetReconcile", types=self.kappa.count())
        if self.name == "hnsw":
            self.vectors = self.keep(mean_by(self.tok, ["doc_id"], "e", "v"))
            self.trace("HnswInsert", documents=self.n_docs)
        return self

    def query(self, text: str | DataFrame, k: int = 10) -> DataFrame:
        """(qid, rank, doc_id, score) of one text or of a table (qid, text); ranks reach documents without a match where k allows."""
        if self.docs is None:
            return self.spark.createDataFrame([], "qid long, rank int, doc_id long, score double")
        queries = text if isinstance(text, DataFrame) else self.spark.createDataFrame([(0, text)], "qid long, text string")
        q = self.query_tokens(queries)
        if self.name == "hnsw":
            out = dense.exact_search(self.vectors, mean_by(q, ["qid"], "qe", "qv"), k)
        elif self.name == "plaid":
            out = plaid.search(self.tok, q, self.centroids, self.postings, k=k)
        elif self.name == "warp":
            out = warp.search(self.tok, q, k=k)
        elif self.name == "tac":
            out = tac.search(self.tok, q, self.type_centroids, self.type_postings, k=k)
        else:
            found = score.maxsim(score.row_maxima(score.similarities(self.tok, q)))
            out = score.top_k(score.with_unmatched(found, queries, self.docs), k)
        self.trace({"hnsw": "HnswQuery", "colbert": "MaxSimMatrix", "plaid": "PlaidMaxSim", "warp": "MaxSimRefine", "tac": "TacSearch"}[self.name], k=k)
        return out.select("qid", "rank", "doc_id", "score")

    def query_tokens(self, queries: DataFrame) -> DataFrame:
        """(qid, qpos, token, token_id, qe, w) of (qid, text)."""
        q = self.encode(queries.select("qid", "text"), "qid")
        return tx.query_weights(q, self.df, self.n_docs).select("qid", F.col("pos").alias("qpos"), "token", "token_id", F.col("e").alias("qe"), "w")

    def inspect(self, target: str) -> DataFrame:
        """tokens, layers, centroids, gather, pq, stats or budgets, as far as the engine has them."""
        if target == "tokens":
            return self.tok.select("doc_id", "pos", "token", preview(F.col("e")).alias("preview"))
        if target == "layers" and self.name == "hnsw":
            levels = dense.graph_levels(self.vectors)
            return dense.layer_stats(levels, dense.graph_edges(self.vectors, levels))
        if target == "centroids" and self.name == "plaid":
            return self.centroids.join(self.postings, "cid", "left").groupBy("cid").agg(F.count("doc_id").alias("docs"))
        if target == "centroids" and self.name == "tac":
            return self.type_centroids.groupBy("token_id").agg(F.count("*").alias("centroids")).orderBy("token_id").limit(20)
        if target == "pq" and self.name == "tac":
            return tac.pq_levels(self.spark)
        if target in ("stats", "budgets") and self.name == "tac":
            return self.stats if target == "stats" else self.kappa
        raise ValueError(f"{self.name} has no {target}")

    def verify(self, pairs: DataFrame, k: int = 10) -> DataFrame:
        """hit_1 and hit_10 over (qid, text, expected)."""
        from ..operators.evaluate import hit_rates

        return hit_rates(self.query(pairs.select("qid", "text"), k), pairs.select("qid", F.col("expected").alias("doc_id")), (1, k))


def compare(spark: SparkSession, docs: DataFrame, text: str, k: int = 10, engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """(engine, rank, doc_id, score) of one query by every engine."""
    out = None
    for name in engines:
        r = Engine(spark, name).index(docs).query(text, k).select(F.lit(name).alias("engine"), "rank", "doc_id", "score")
        out = r if out is None else out.unionByName(r)
    return out
