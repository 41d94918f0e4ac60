"""Sources, traces, the command line and reports on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maxfold.functions import labels
from maxfold.functions import vectors as v
from maxfold.operators import evaluate, kmeans, score, sweeps
from maxfold.plans import cli, trace
from maxfold.plans.engine import ENGINES, Engine
from maxfold.sources import files
from maxfold.sources import vectors as src


def test_shared_corpus_and_its_labels(spark):
    assert labels.shared_corpus(spark).count() == 20 and labels.verify_pairs(spark).count() == 20
    assert labels.relevance(spark).count() == 20 and labels.judged_queries(spark).count() == 10
    assert labels.document(labels.shared_corpus(spark), 7).startswith("The elephant") and labels.document(labels.shared_corpus(spark), 99) is None
    got = spark.range(101).select(labels.category_of(F.col("id")).alias("c")).groupBy("c").count().orderBy("c").collect()
    assert [r["count"] for r in got] == [20, 20, 10, 10, 5, 5, 10, 10, 5, 6]
    res = spark.createDataFrame([(0, 1, 7), (0, 2, 50)], "qid long, rank int, doc_id long")
    out = {r["doc_id"]: (r["text"] is None, r["relevant"]) for r in labels.with_texts(res, labels.shared_corpus(spark), spark.createDataFrame([(0, 7)], "qid long, doc_id long")).collect()}
    assert out == {7: (False, True), 50: (True, False)}


def test_files_round_trip(spark, tmp_path):
    tok = src.synthetic_tokens(spark, 30, per_doc=3, dim=8)
    folder = f"file://{tmp_path}/packed"
    assert files.write_packed(tok, folder).agg(F.sum("docs"), F.sum("vectors")).first()[:] == (30, 90)
    assert files.passages_done(spark, folder) == 30
    want = {(r["doc_id"], r["pos"]): r["e"] for r in tok.collect()}
    got = {(r["doc_id"], r["pos"]): r["e"] for r in files.read_packed_shards(spark, folder, 8, block=4).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert files.missing_files(spark, str(tmp_path), ["packed", "nothing"]) == ["nothing"]
    m = spark.createDataFrame([("a", ["x"], [[1.0, 2.0]]), ("b", ["y"], [[1.0]])], "text string, tokens array<string>, rows array<array<double>>")
    files.write_matrix_cache(m, f"{tmp_path}/m")
    assert [r["text"] for r in src.read_matrix_cache(spark, f"{tmp_path}/m", 2).collect()] == ["a"]
    src.append_index(tok, f"{tmp_path}/idx")
    src.append_index(tok, f"{tmp_path}/idx")
    assert spark.read.parquet(f"{tmp_path}/idx").count() == 180
    src.write_meta(spark, f"{tmp_path}/meta", 3, 8, "m")
    assert spark.read.json(f"{tmp_path}/meta").first()["dim"] == 8
    assert files.pack(np.array([1.0])) == b"\x00\x00\x80?"


def test_embedding_job_retries_and_fills_what_is_missing(spark, tmp_path):
    mark = f"{tmp_path}/tried"

    def send(texts):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(i, "x" * i) for i in range(70)], "doc_id long, text string")
    cache = spark.createDataFrame([(3, [9.0, 9.0])], "doc_id long, v array<double>")
    out = {r["doc_id"]: r["v"] for r in files.fill_missing(docs, cache, "doc_id", lambda d: files.embedding_job(d, send, wait=0.01, workers=1)).collect()}
    assert len(out) == 70 and out[3] == [9.0, 9.0] and out[5] == [5.0, 1.0]
    req = files.vector_search_request("i", "p", [1.0], 3)
    assert req[0]["$vectorSearch"]["numCandidates"] == 10_000 and req[0]["$vectorSearch"]["limit"] == 3
    q = spark.createDataFrame([(1, [0.5])], "qid long, qv array<double>")
    assert [tuple(r) for r in files.remote_search(q, lambda stages: [{"doc_id": 4, "score": stages[0]["$vectorSearch"]["queryVector"][0]}]).collect()] == [(1, 1, 4, 0.5)]
    assert files.process_search(["printf", 'noise\n{"a": 1}\n[2]\n']) == [{"a": 1}]
    assert "JSON array" in files.judge_prompt("q", [(1, "t")])


@pytest.mark.parametrize("name", ENGINES)
def test_every_stage_has_rows(spark, name):
    docs = labels.shared_corpus(spark).limit(8)
    engine = Engine(spark, name, dim=16).index(docs)
    q = spark.createDataFrame([(0, "river bank")], "qid long, text string")
    table = trace.stages(engine, q)
    assert {r["stage"] for r in table.select("stage").distinct().collect()} == set(trace.STAGES[name])
    text = trace.render(table, first=2)
    assert all(f"[{s}]" in text for s in trace.STAGES[name]) and "more" in text
    with pytest.raises(ValueError, match="no stage"):
        trace.stage(engine, "Nothing")


def test_wordpiece_engine(spark):
    docs = spark.createDataFrame([(0, "rivers"), (1, "banks")], "doc_id long, text string")
    e = Engine(spark, "colbert", dim=16, vocabulary=["[UNK]", "river", "bank", "##s"]).index(docs)
    assert sorted(r["token"] for r in e.tok.collect()) == ["##s", "##s", "bank", "river"]
    assert e.query("river", 1).first()["doc_id"] == 0


def test_command_line(spark, tmp_path):
    said = []
    lines = iter(["index red apple", "index green pear", "query pear", "inspect nothing", "help", "trace Tokenize", "quit"])
    assert cli.main(["repl", "colbert"], spark, read=lambda _: next(lines), write=said.append) == 0
    assert "doc_id=1" in said[0].splitlines()[0] and "has no nothing" in said[1] and said[2].startswith("index TEXT")
    assert cli.main(["bench", "check-sift", "--path", str(tmp_path)], spark, write=said.append) == 1
    (tmp_path / "c.tsv").write_text("0\ta\n1\tbb\n2\tccc\n")
    send = lambda texts: [[float(len(t))] for t in texts]
    for limit, n in ((2, 2), (3, 3)):
        cli.main(["embed", str(tmp_path / "c.tsv"), "--out-dir", f"{tmp_path}/out", "--limit", str(limit)], spark, write=said.append, embedder=send)
        assert said[-1] == f"{n} passages"
    assert cli.main(["--trace-json", str(tmp_path), "demo", "compare"], spark, write=said.append) == 0
    assert set(json.loads((tmp_path / "compare.json").read_text())["results"]) == set(ENGINES)


def test_scale_bench_and_bench_results(spark):
    rows = cli.scale_bench(spark, [50], timed=1, warm=0, dim=8).collect()
    assert len(rows) == 8 and all(r["ms"] > 0 for r in rows) and sum(r["extrapolated"] for r in rows) == 4
    res = cli.bench_engines(spark, ["colbert"])
    assert res.first()["recall_at_10"] > 0.5
    wide = res.withColumn("recall_at_100", F.lit(1.0))
    assert {k: d.count() for k, d in files.result_points(wide).items()} == {"pareto": 1, "recall": 3, "latency": 3, "throughput": 1}


def test_reports(spark, tmp_path):
    pts = spark.createDataFrame([("a", 1.0, 0.01, 0.2), ("a", 2.0, 0.01, 0.3), ("a", 3.0, 0.5, 0.9), ("b", 1.0, 1.0, 1.0)], "engine string, param double, frac double, recall double")
    svg = files.svg_chart(pts, title="t <x>")
    assert svg.count("<polyline") == 2 and "t &lt;x&gt;" in svg
    assert [(r["engine"], r["param"]) for r in sweeps.sorted_points(pts).orderBy("engine", "param").collect()] == [("a", 1.0), ("a", 3.0), ("b", 1.0)]
    assert sweeps.drop_low(pts, 0.01).count() == 2 and sweeps.admissible((4, 10, 64), 50) == [10]
    t = spark.createDataFrame([(0, 1, "S", "{}")], "seq int, ts_ms long, stage string, payload string")
    files.write_trace(t, f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/t").first()["stage"] == "S"
    files.write_json({"a": 1}, f"{tmp_path}/j.json")
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": 1}
    r = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7)], "qid long, rank int, doc_id long")
    g = spark.createDataFrame([(0, 1, 6), (0, 2, 9), (0, 3, 5)], "qid long, rank int, doc_id long")
    got = {x["qid"]: x["recall"] for x in evaluate.recall_at_k(r, g, 2).collect()}
    assert got[0] == 0.5 and math.isnan(got[1])


def test_assignment_does_not_shuffle_and_takes_many_centroids(spark, monkeypatch):
    rng = np.random.default_rng(1)
    tok = spark.createDataFrame([(i, i, rng.normal(size=4).tolist()) for i in range(50)], "doc_id long, vec_id long, e array<double>")
    c = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)] + [(20, [0.0] * 4), (21, [0.0] * 4)], "cid int, ce array<double>")
    plan = kmeans.assign(tok, c)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    whole = {r["vec_id"]: (r["cid"], r["csim"]) for r in plan.collect()}
    monkeypatch.setattr(kmeans, "CELLS", 12)
    assert {r["vec_id"]: (r["cid"], r["csim"]) for r in kmeans.assign(tok, c).collect()} == whole
    ce = {r["cid"]: np.array(r["ce"]) for r in c.collect()}
    for r in tok.collect():
        assert whole[r["vec_id"]][0] == max((round(float(np.dot(x, r["e"])), 9), i) for i, x in ce.items())[1]
    few = kmeans.cluster_types(tok.withColumn("token_id", F.lit(1)), spark.createDataFrame([(1, None)], "token_id int, kappa int"), iters=2)
    assert few.count() == kmeans.KAPPA


def test_queries_in_blocks_equal_one_block(spark, monkeypatch):
    tok = src.synthetic_tokens(spark, 20, dim=8)
    q = src.synthetic_tokens(spark, 5, 3, 8, seed=1).select(F.col("doc_id").alias("qid"), F.col("pos").alias("qpos"), F.col("e").alias("qe"))
    want = sorted(map(tuple, score.search(tok, q).collect()))
    sims = score.similarities(tok, q).count()
    monkeypatch.setattr(score, "BROADCAST_BYTES", 400)
    monkeypatch.setattr(score.in_blocks, "__defaults__", (400,))
    assert sorted(map(tuple, score.search(tok, q).collect())) == want and score.similarities(tok, q).count() == sims
    n = v.normalize(F.array(F.lit(3.0), F.lit(4.0)))
    assert spark.range(1).select(n.alias("n")).first()["n"] == [0.6, 0.8]
