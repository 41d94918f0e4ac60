"""The stages of indexing and searching as tables, and their rendering as text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tail_class
from ..functions.vectors import preview, rounded
from ..operators import dense, kmeans, plaid, score, tac, warp
from .engine import Engine

#: The stages' names, by engine.
STAGES = {
    "hnsw": ("Tokenize", "TokenEmbed", "HnswInsert", "HnswLayerStats", "HnswQuery"),
    "colbert": ("Tokenize", "TokenEmbed", "MaxSimMatrix"),
    "plaid": ("Tokenize", "TokenEmbed", "CentroidAssign", "CentroidAnn", "CandidateExpand", "PlaidMaxSim"),
    "warp": ("Tokenize", "TokenEmbed", "XtrScore", "CandidateGather", "MaxSimRefine"),
    "tac": ("Tokenize", "TokenEmbed", "TailHandle", "DampedScore", "BudgetBound", "BudgetReconcile", "PqInspect", "TachiomSearch"),
}


def stage(engine: Engine, name: str, queries: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The rows of one stage of an indexed engine; stages of a search need ``queries`` (qid, text)."""
    if name not in STAGES[engine.name]:
        raise ValueError(f"{engine.name} has no stage {name}: one of {', '.join(STAGES[engine.name])}")
    tok = engine.tok
    q = engine.query_tokens(queries) if queries is not None else None
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    listed = lambda key: F.transform(F.array_sort(F.collect_list(F.struct("rank", key, rounded(F.col("score")).alias("score")))), lambda x: F.struct(x[key].alias(key), x["score"].alias("score")))
    if name == "Tokenize":
        return tok.groupBy("doc_id").agg(words.alias("tokens"))
    if name == "TokenEmbed":
        return tok.select("doc_id", "pos", "token", preview(F.col("e")).alias("embedding_preview"))
    if name in ("HnswInsert", "HnswLayerStats", "HnswQuery"):
        levels = dense.graph_levels(engine.vectors)
        edges = dense.graph_edges(engine.vectors, levels)
        if name == "HnswLayerStats":
            return dense.layer_stats(levels, edges)
        if name == "HnswInsert":
            layers = edges.groupBy("src", "layer").agg(F.sort_array(F.collect_list("dst")).alias("neighbours")).groupBy(F.col("src").alias("doc_id"))
            return engine.docs.join(layers.agg(F.sort_array(F.collect_list(F.struct("layer", "neighbours"))).alias("layers")), "doc_id", "left")
        vectors = dense.mean_by(q, ["qid"], "qe", "qv")
        return dense.greedy_hops(engine.vectors, levels, edges, vectors).withColumnRenamed("doc_id", "greedy_best")
    if name == "MaxSimMatrix":
        sims = score.similarities(tok, q)
        rows = sims.groupBy("qid", "doc_id", "qpos", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sim"))), lambda x: x["sim"]).alias("row"), F.max("sim").alias("m"))
        ordered = F.array_sort(F.collect_list(F.struct("qpos", "row", "m", "w")))
        return rows.groupBy("qid", "doc_id").agg(F.transform(ordered, lambda x: x["row"]).alias("matrix"), F.transform(ordered, lambda x: x["m"]).alias("row_maxima"), F.sum(F.coalesce("w", F.lit(1.0)) * F.col("m")).alias("score"))
    if name == "CentroidAssign":
        return kmeans.assign(tok, engine.centroids).select("doc_id", "pos", "token", F.col("cid").alias("centroid_id"))
    if name == "CentroidAnn":
        near = plaid.probe(q, engine.centroids, plaid.default_probes()).withColumnRenamed("sim", "score")
        return near.groupBy("qid", "qpos").agg(listed("cid").alias("top_centroids"))
    if name == "CandidateExpand":
        counts = plaid.pruned_counts(q, engine.centroids, engine.postings, engine.n_docs, plaid.default_probes())
        return counts.withColumnRenamed("pruned", "pruned_count")
    if name in ("PlaidMaxSim", "MaxSimRefine"):
        top = engine.query(queries, k).groupBy("qid").agg(F.count("*").alias("scored_count"), listed("doc_id").alias("top_k"))
        n = plaid.candidates(q, engine.centroids, engine.postings, plaid.default_probes()) if name == "PlaidMaxSim" else warp.with_fallback(warp.gather(score.batched_maxima(tok, q)), q, tok)
        return top.join(n.groupBy("qid").agg(F.count("*").alias("candidate_count")), "qid", "left")
    if name == "XtrScore":
        return score.batched_maxima(tok, q).join(q.select("qid", "qpos", "token"), ["qid", "qpos"]).select("qid", "qpos", F.col("token").alias("query_token"), "doc_id", F.col("m").alias("score"))
    if name == "CandidateGather":
        return warp.gather_stats(score.batched_maxima(tok, q), q, engine.n_docs).withColumnRenamed("fraction", "fraction_promoted")
    types = tok.groupBy("token_id").agg(F.min("token").alias("token_type"))
    if name == "TailHandle":
        return tok.groupBy("token_id").agg(F.min("token").alias("token_type"), F.count("*").alias("count")).withColumn("classification", tail_class(F.col("count")))
    if name == "DampedScore":
        return engine.stats.join(types, "token_id").select("token_type", F.col("s").alias("variance"), F.col("w").alias("weight"))
    if name == "BudgetBound":
        bound = tac.allocate(engine.stats).select("token_id", F.col("raw").alias("raw_kappa"), "floored", "ceiled")
        return bound.join(engine.kappa.select("token_id", F.col("kappa").alias("final_kappa")), "token_id").join(types, "token_id").drop("token_id")
    if name == "BudgetReconcile":
        return engine.kappa.agg(F.lit(tac.BUDGET).alias("total_budget"), F.sum("k").alias("allocated"), F.sum(F.col("kappa") - F.col("k")).alias("redistributed"))
    if name == "PqInspect":
        return tac.pq_levels(engine.spark)
    return engine.query(queries, k)


def payload(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*rows.columns))


def stages(engine: Engine, queries: DataFrame, *names: str, first: int = 100) -> DataFrame:
    """(seq, stage, payload): up to ``first`` rows of each stage, of all or the named ones, in the order of the stages: a report."""
    out = None
    for i, name in enumerate(STAGES[engine.name]):
        if names and name not in names:
            continue
        rows = stage(engine, name, queries)
        part = rows.orderBy(*[c for c in rows.columns if rows.schema[c].dataType.typeName() != "array"]).limit(first).select(F.lit(i).alias("_i"), F.lit(name).alias("stage"), payload(rows).alias("payload"))
        out = part if out is None else out.unionByName(part)
    w = Window.orderBy("_i", "payload")  # first rows a stage
    return out.select((F.row_number().over(w) - 1).alias("seq"), "stage", "payload")


def render(trace: DataFrame, first: int = 15) -> str:
    """A trace as text: rows of one stage that follow each other are a block, of which the first are shown."""
    lines, last, shown, more = [], None, 0, 0
    for r in trace.orderBy("seq").select("stage", "payload").collect():  # a report
        if r["stage"] != last:
            lines += [f"  ... {more} more"] if more else []
            lines.append(f"[{r['stage']}]")
            last, shown, more = r["stage"], 0, 0
        if shown == first:
            more += 1
            continue
        shown += 1
        fields = json.loads(r["payload"])
        lines.append("  " + "  ".join(f"{k}={json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else v}" for k, v in fields.items())[:240])
    return "\n".join([*lines, f"  ... {more} more"] if more else lines)
