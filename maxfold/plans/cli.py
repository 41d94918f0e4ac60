"""The command line: demo, repl, bench, scale, tradeoff, gt-bench, large-bench, embed."""

from __future__ import annotations

import argparse
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import shared_corpus, verify_pairs
from ..operators import score, sweeps
from ..operators.evaluate import percentile_ranks
from ..sources import files
from ..sources.vectors import read_tsv, synthetic_tokens
from . import scenario, trace
from .engine import ENGINES, Engine, compare

HELP = "index TEXT | query TEXT | inspect TARGET | trace [STAGE] | help | quit"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maxfold")
    p.add_argument("--trace-json", help="folder for the trace of a demo, as JSON lines")
    sub = p.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("demo", help="run a scenario file, or 'compare' all engines")
    demo.add_argument("name")
    demo.add_argument("--dry-run", action="store_true")
    demo.add_argument("--query", default="river bank hiking")
    repl = sub.add_parser("repl", help="an interactive session with one engine")
    repl.add_argument("engine", choices=ENGINES)
    bench = sub.add_parser("bench", help="verify and time engines over the shared corpus")
    bench.add_argument("target", choices=("all", *ENGINES, "check-sift"))
    bench.add_argument("--path", default=".")
    bench.add_argument("--out")
    scale = sub.add_parser("scale", help="full against pruned scans of synthetic corpora")
    scale.add_argument("--sizes", type=int, nargs="+", default=[1_000, 10_000, 100_000])
    for name, text in (("tradeoff", "recall by share of documents"), ("gt-bench", "recall of labelled queries"), ("large-bench", "recall under filters")):
        t = sub.add_parser(name, help=text)
        t.add_argument("data", help="folder of the Parquet tables")
        t.add_argument("--svg")
    embed = sub.add_parser("embed", help="embed passages of a TSV file into a packed store, resuming where it stopped")
    embed.add_argument("collection")
    embed.add_argument("--out-dir", required=True)
    embed.add_argument("--limit", type=int)
    return p


def scale_bench(spark: SparkSession, sizes: list[int], *, per_doc: int = 8, q_tokens: int = 10, dim: int = 128, warm: int = 1, timed: int = 3, shares=(1.0, 0.2, 0.05, 0.01)) -> DataFrame:
    """(docs, share, ms, bytes): upper median time of summing MaxSim over the first share of a synthetic corpus; 1,000,000 extrapolated."""
    rows = []
    q = synthetic_tokens(spark, 1, q_tokens, dim, seed=0x1234).select(F.col("doc_id").alias("qid"), F.col("pos").alias("qpos"), F.col("e").alias("qe"))
    for n in sizes:
        tok = synthetic_tokens(spark, n, per_doc, dim).cache()
        tok.count()
        for share in shares:
            some = tok.where(F.col("doc_id") < max(1, int(n * share)))
            took = []
            for i in range(warm + timed):
                began = time.perf_counter()
                score.maxsim(score.batched_maxima(some, q)).agg(F.sum("score")).first()
                if i >= warm:
                    took.append(1000 * (time.perf_counter() - began))
            rows.append((n, share, statistics.median_high(took), n * per_doc * dim * 4, False))
        tok.unpersist()
    if sizes:
        rows += [(1_000_000, s, ms * 1_000_000 / n, 1_000_000 * per_doc * dim * 4, True) for n, s, ms, _, _ in rows if n == sizes[-1]]
    return spark.createDataFrame(rows, "docs long, share double, ms double, bytes long, extrapolated boolean")


def bench_engines(spark: SparkSession, names, docs: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """A bench result a row: recall at 1 and 10 of the verify queries, percentiles of single-query times, queries a second, seconds to index."""
    docs, pairs, rows = docs or shared_corpus(spark), pairs or verify_pairs(spark), []
    for name in names:
        began = time.perf_counter()
        engine = Engine(spark, name).index(docs)
        built = time.perf_counter() - began
        hit = engine.verify(pairs).first()
        times = []
        for r in pairs.limit(3).collect():
            began = time.perf_counter()
            engine.query(r["text"]).collect()
            times.append((1000 * (time.perf_counter() - began),))
        p = {r["p"]: r["value"] for r in percentile_ranks(spark.createDataFrame(times, "ms double"), "ms").collect()}
        rows.append((name, "shared", hit["hit_1"], hit["hit_10"], p[0.5], p[0.95], p[0.99], 1000 * len(times) / sum(t for (t,) in times), built))
    return spark.createDataFrame(rows, "engine string, dataset string, recall_at_1 double, recall_at_10 double, p50_ms double, p95_ms double, p99_ms double, qps double, index_build_s double")


def main(argv: list[str], spark: SparkSession, *, read: Callable[[str], str] = input, write: Callable[[str], None] = print, embedder=None) -> int:
    """Run one command; ``read`` and ``write`` are the terminal, ``embedder`` sends texts to a model."""
    a = parser().parse_args(argv)
    show = lambda df: write("\n".join("  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in df.collect()))
    if a.command == "demo" and a.name == "compare":
        results = compare(spark, shared_corpus(spark), a.query)
        show(results)
        if a.trace_json:
            files.write_json(files.compare_report(a.query, results), f"{a.trace_json}/compare.json")
    elif a.command == "demo":
        with open(a.name, encoding="utf-8") as f:
            for op, table in scenario.run(spark, f.read(), dry_run=a.dry_run):
                write(op)
                if table is not None:
                    show(table)
                    if a.trace_json and op == "trace":
                        files.write_trace(table, a.trace_json)
    elif a.command == "repl":
        engine = Engine(spark, a.engine)
        while (line := read("> ").strip()) not in ("quit", "exit"):
            try:
                out = scenario.command(engine, line)
            except ValueError as error:
                out = str(error)
            if isinstance(out, DataFrame):
                show(out)
            elif out:
                write(out)
    elif a.command == "bench" and a.target == "check-sift":
        lacking = files.missing_files(spark, a.path, ["bigann_base.bvecs", "bigann_query.bvecs", "bigann_gnd.ivecs"])
        write("present" if not lacking else f"put these files into {a.path}: {', '.join(lacking)}")
        return int(bool(lacking))
    elif a.command == "bench":
        results = bench_engines(spark, ENGINES if a.target == "all" else [a.target])
        show(results)
        if a.out:
            files.write_json([r.asDict() for r in results.collect()], a.out)
    elif a.command == "scale":
        show(scale_bench(spark, a.sizes))
    elif a.command in ("tradeoff", "gt-bench", "large-bench"):
        from ..registry import QUERIES
        from .. import sweep_queries  # noqa: F401

        points = QUERIES[{"tradeoff": "tradeoff_points", "gt-bench": "judged_points", "large-bench": "filtered_points"}[a.command]](spark, a.data)
        show(sweeps.sorted_points(points).orderBy("engine", "frac"))
        if a.svg:
            with open(a.svg, "w", encoding="utf-8") as f:
                f.write(files.svg_chart(points, title=a.command))
    else:
        if embedder is None:
            raise ValueError("embedding needs a model: pass embedder")
        docs = read_tsv(spark, a.collection, take=a.limit)
        done = spark.read.parquet(a.out_dir) if not files.missing_files(spark, a.out_dir, ["_SUCCESS"]) else None
        todo = docs if done is None else docs.join(done.select("doc_id"), "doc_id", "left_anti")
        files.embedding_job(todo, embedder).write.mode("append").parquet(a.out_dir)
        write(f"{spark.read.parquet(a.out_dir).count()} passages")
    return 0


__all__ = ["HELP", "bench_engines", "main", "parser", "scale_bench", "trace"]
