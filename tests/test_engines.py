"""Behaviour of the engines, sources, scenarios and the trace on small fixtures."""

import json
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from maxfold.functions import text as tx
from maxfold.functions import vectors as v
from maxfold.operators import dense, evaluate, kmeans, plaid, score, sweeps, tac, warp
from maxfold.plans import scenario
from maxfold.plans.engine import ENGINES, Engine, compare
from maxfold.sources import vectors as src
from maxfold.streaming.index import append_stream, latest

DOCS = [(0, "the cat sat on the mat"), (1, "dogs chase cats in the park"), (2, "vector search finds near neighbours"), (3, "late interaction scores tokens"), (4, "stream of words and windows")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def tok(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i // 6, i % 6, i % 4, i, r.tolist()) for i, r in enumerate(x)], "doc_id long, pos long, token_id int, vec_id long, e array<double>").cache()


@pytest.fixture(scope="module")
def q(tok):
    return tok.where("doc_id in (0, 10)").select(F.col("doc_id").alias("qid"), F.col("pos").alias("qpos"), "token_id", F.col("e").alias("qe"))


def ranks(df):
    return sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


def test_pruned_engines_equal_the_exact_one_without_pruning(tok, q):
    exact = ranks(score.search(tok, q))
    c = kmeans.fit(tok, 6, iters=3)
    p = kmeans.postings(kmeans.assign(tok, c))
    assert ranks(plaid.search(tok, q, c, p, n_probe=6)) == exact
    assert ranks(warp.search(tok, q, threshold=-1.1, bound=1000)) == exact
    assert ranks(warp.search(tok, q, threshold=1.1)) == exact  # nothing gathered: all documents
    assert ranks(score.top_k(score.maxsim(score.batched_maxima(tok, q)), 10)) == exact
    assert {r[0]: r[2] for r in exact if r[1] == 1} == {0: 0, 10: 10}


def test_token_aware_scores_are_exact_scores(tok, q):
    c = kmeans.cluster_types(tok, tac.budgets(tok))
    p = kmeans.assign_types(tok, c)
    exact = {(a, d): s for a, _, d, s in ranks(score.search(tok, q, 1000))}
    assert all(exact[(a, d)] == s for a, _, d, s in ranks(tac.search(tok, q, c, p)))
    unknown = q.withColumn("token_id", F.lit(99))
    assert ranks(tac.search(tok, unknown, c, p)) == ranks(score.search(tok, q))


def test_budget_bounds(spark):
    w = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 0.5), (3, 10.0)], "token_id int, w double")
    got = {r["token_id"]: (r["k"], r["kappa"]) for r in tac.reconcile(tac.allocate(w)).collect()}
    assert all(4 <= k <= 39 and k <= kappa <= 39 for k, kappa in got.values())
    even = spark.createDataFrame([(i, 1.0) for i in range(4)], "token_id int, w double")
    assert {r["k"] for r in tac.allocate(even, 100).collect()} == {25}
    flat = spark.createDataFrame([(i, 0.0) for i in range(4)], "token_id int, w double")
    assert {r["k"] for r in tac.allocate(flat).collect()} == {4}
    n = spark.createDataFrame([(127,), (128,), (255,), (256,)], "n int").select(tx.tail_class(F.col("n")).alias("c"))
    assert [r["c"] for r in n.collect()] == ["Tail", "Normal", "Normal", "Heavy"]


def test_kmeans_is_unit_and_clamped(tok):
    got = kmeans.fit(tok.limit(3), 8).collect()
    assert len(got) == 3 and all(abs(np.linalg.norm(r["ce"]) - 1) < 1e-9 for r in got)


def test_kmeans_fit_is_a_fixed_point(spark):
    x = np.random.default_rng(5).normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    many = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, e array<double>").cache()
    c = kmeans.fit(many, 8)
    got, again = ({r["cid"]: r["ce"] for r in d.collect()} for d in (c, kmeans.lloyd_step(many, c)))
    assert max(np.abs(np.subtract(got[i], again[i])).sum() for i in got) <= 1e-6


def test_ivf_recall_against_brute_force(spark, tmp_path):
    from maxfold import registry

    x = np.random.default_rng(8).normal(size=(1600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, r.tolist(), i % 5) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    truth, found = ({(r["qid"], r["doc_id"]) for r in registry.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("dense_exact_topk", "ivf_search"))
    assert len(truth & found) >= 0.9 * len(truth)


def test_types_are_clustered_over_all_their_tokens(spark):
    n = 20_600  # more than the 20,000 that one type was once cut to
    angle = np.random.default_rng(9).uniform(0, 2 * np.pi, n)
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    many = spark.createDataFrame([(7, i, r.tolist()) for i, r in enumerate(x)], "token_id long, vec_id long, e array<double>").cache()
    one = spark.createDataFrame([(7, 1)], "token_id long, kappa int")
    got = kmeans.cluster_types(many, one).collect()
    mean = x.mean(0) / np.linalg.norm(x.mean(0))
    assert len(got) == 1 and np.abs(np.array(got[0]["ce"]) - mean).sum() < 1e-6


def test_dense_search_and_graph(tok):
    s = dense.sentence_vectors(tok).cache()
    qs = s.select(F.col("doc_id").alias("qid"), F.col("v").alias("qv"))
    assert all(r["qid"] == r["doc_id"] for r in dense.exact_search(s, qs, 1).collect())
    c = kmeans.initial(s.select("doc_id", F.col("v").alias("e")), 4, key="doc_id")
    assert ranks(dense.ivf_search(s, qs, c, n_probe=4)) == ranks(dense.exact_search(s, qs))
    levels = dense.graph_levels(s)
    edges = dense.graph_edges(s, levels)
    assert ranks(dense.graph_search(s, levels, edges, qs, ef=20)) == ranks(dense.exact_search(s, qs))
    many = dense.graph_edges(s, levels, list_rows=6, probes=2, block=3).where("layer = 0").select("src", "dst").collect()
    seen = {0}
    while more := {r["dst"] for r in many if r["src"] in seen} - seen:
        seen |= more
    assert len(seen) == 20  # several lists, and yet every node is reached
    assert {r["nodes"] for r in dense.layer_stats(levels, edges).where("layer = 0").collect()} == {20}
    assert dense.greedy_hops(s, levels, edges, qs).where("layer = 0").count() == 20


def test_metrics(spark):
    r = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7)], "qid long, rank int, doc_id long")
    t = spark.createDataFrame([(0, 5), (0, 9), (1, 8)], "qid long, doc_id long")
    assert {x["qid"]: x["recall"] for x in evaluate.recall_min(r, t, 10).collect()} == {0: 0.5, 1: 0.0}
    assert {x["qid"]: x["recall"] for x in evaluate.recall_fixed(r, t, 10).collect()} == {0: 0.1, 1: 0.0}
    assert {x["qid"]: x["precision"] for x in evaluate.precision(r, t).collect()} == {0: 0.5, 1: 0.0}
    vals = [random.Random(1).randrange(50) for _ in range(101)]
    got = {x["p"]: x["value"] for x in evaluate.percentile_ranks(spark.createDataFrame([(float(x),) for x in vals], "x double"), "x").collect()}
    assert got == {p: float(sorted(vals)[int(101 * p)]) for p in (0.5, 0.95, 0.99)}


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([-2.0, 2.0],)], "v array<double>")
    got = df.select(v.normalize(F.col("v")).alias("n"), v.quantize(F.col("v")).alias("c")).collect()
    assert got[0]["n"] == [0.6, 0.8] and got[1]["n"] == [0.0, 0.0] and got[2]["c"] == [0, 255]
    m = spark.range(3).select(v.mock_embedding(F.col("id").cast("string"), 64).alias("m"), v.string_hash(F.lit("añ")).alias("h")).collect()
    assert len({tuple(r["m"]) for r in m}) == 3 and all(abs(np.linalg.norm(r["m"]) - 1) < 1e-9 for r in m)
    h = 0
    for b in "añ".encode():
        h = (h * 31 + b) % 2**32
    assert m[0]["h"] == h
    assert spark.range(1).select(tx.align_ids(F.array(F.lit(1), F.lit(2)), 3).alias("a")).first()["a"] == [1, 2, 0]


@pytest.mark.parametrize("name", ENGINES)
def test_engine(spark, docs, name):
    e = Engine(spark, name, dim=32).index(docs)
    got = e.query("late interaction tokens", 3).orderBy("rank").collect()
    assert 0 < len(got) <= 3 and got[0]["doc_id"] == 3
    assert got == e.query("late interaction tokens", 3).orderBy("rank").collect()
    assert e.trace_table().count() >= 2 and e.inspect("tokens").count() > 20
    with pytest.raises(ValueError, match="has no"):
        e.inspect("nothing")
    again = e.index(spark.createDataFrame([(3, "something else")], "doc_id long, text string"))
    assert again.n_docs == 5


def test_unmatched_documents_score_zero(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(9, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in Engine(spark, "colbert", dim=16).index(more).query("", 10).collect()}
    assert got == {d: 0.0 for d in (0, 1, 2, 3, 4, 9)}


def test_compare_and_verify(spark, docs):
    got = compare(spark, docs, "dogs in the park", 2, ("hnsw", "colbert"))
    assert {r["engine"]: r["doc_id"] for r in got.where("rank = 1").collect()} == {"hnsw": 1, "colbert": 1}
    pairs = spark.createDataFrame([(i, t, i) for i, t in DOCS], "qid long, text string, expected long")
    assert Engine(spark, "colbert", dim=32).index(docs).verify(pairs).first().asDict() == {"hit_1": 1.0, "hit_10": 1.0}


SCENARIO = """
[meta]
title = "t"
engine = "colbert"
version = 1
[corpus]
type = "inline"
docs = ["red apple", "green pear", "blue sky"]
[[steps]]
op = "index"
args = ["all"]
[[steps]]
op = "query"
args = ["green", "pear", "1"]
[[steps]]
op = "trace"
args = ["Tokenize"]
"""


def test_scenario(spark, docs):
    out = scenario.run(spark, SCENARIO)
    assert [op for op, _ in out] == ["index", "query", "trace"]
    assert [r["doc_id"] for r in out[1][1].collect()] == [1] and out[2][1].count() == 1
    assert all(t is None for _, t in scenario.run(spark, SCENARIO, dry_run=True))
    with pytest.raises(ValueError, match="version"):
        scenario.load(SCENARIO.replace("version = 1", "version = 2"))
    e = Engine(spark, "colbert", dim=16)
    assert scenario.command(e, "index a text") is None and scenario.command(e, "query text").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("0\ta b\n1\tc\td\n2\te\n")
    assert [tuple(r) for r in src.read_tsv(spark, str(tmp_path / "p.tsv"), skip=1, take=1).collect()] == [(1, "c\td")]
    (tmp_path / "bad.tsv").write_text("no tab\n")
    with pytest.raises(Exception, match="no tab"):
        src.read_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "x.bvecs").write_bytes(struct.pack("<I3B", 3, 1, 2, 255) * 2 + b"\3\0")
    (tmp_path / "x.ivecs").write_bytes(struct.pack("<I2i", 2, -5, 70000))
    assert [(r["id"], r["v"]) for r in src.read_vecs(spark, str(tmp_path / "x.bvecs"), kind="b").collect()] == [(0, [1, 2, 255]), (1, [1, 2, 255])]
    assert src.read_vecs(spark, str(tmp_path / "x.ivecs"), kind="i").first()["v"] == [-5.0, 70000.0]
    store = tmp_path / "store"
    store.mkdir()
    (store / "offsets.bin").write_bytes(struct.pack("<2Q", 0, 2))
    (store / "lengths.bin").write_bytes(struct.pack("<2I", 2, 1))
    (store / "data.bin").write_bytes(struct.pack("<6f", 1, 2, 3, 4, 5, 6))
    assert [tuple(r) for r in src.read_packed(spark, str(store), 2).collect()] == [(0, 0, [1, 2]), (0, 1, [3, 4]), (1, 0, [5, 6])]
    (tmp_path / "v.json").write_text(json.dumps({"7": [1, 2.5]}))
    assert [tuple(r) for r in src.read_vector_cache(spark, str(tmp_path / "v.json")).collect()] == [(7, [1.0, 2.5])]
    (tmp_path / "m.json").write_text(json.dumps({"a": {"tokens": ["a"], "rows": [[1, 2]]}, "b": {"tokens": ["b"], "rows": [[1]]}}))
    assert [r["text"] for r in src.read_matrix_cache(spark, str(tmp_path / "m.json"), 2).collect()] == ["a"]
    (tmp_path / "l.json").write_text(json.dumps({"q": [3, 4]}))
    assert [tuple(r) for r in src.read_label_cache(spark, str(tmp_path / "l.json")).collect()] == [("q", 3), ("q", 4)]
    assert spark.range(1).select(src.judged_ids(F.lit("```json\n[1, 2]\n```")).alias("x")).first()["x"] == [1, 2]
    (tmp_path / "vocab.txt").write_text("[UNK]\nhello\nwor\n##ld\n!\n")
    wp = tx.wordpiece(spark.createDataFrame([(1, "Héllo world!")], "doc_id long, text string"), str(tmp_path / "vocab.txt"))
    assert [r["token"] for r in wp.orderBy("pos").collect()] == ["hello", "wor", "##ld", "!"]
    t = src.synthetic_tokens(spark, 3, dim=8)
    assert t.count() == 24 and src.pool_tokens(t, 2).count() == 12


def test_stream_appends_and_latest_wins(spark, tmp_path):
    inp, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "old"), (2, 1, "b"), (1, 2, "new")], "doc_id long, seq long, text string").write.parquet(inp)
    stream = spark.readStream.schema("doc_id long, seq long, text string").parquet(inp)
    append_stream(stream, out, str(tmp_path / "cp")).awaitTermination(60)
    got = latest(spark.read.parquet(out))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "new"), (2, "b")]


def test_wordpiece_encodes_bounded_portions(spark, monkeypatch):
    long = "alpha beta, gamma\n" * 40 + "x" * 300 + " beta" + "é" * 5
    rows = [(1, long), (2, None), (3, ""), (4, "beta"), (None, "alpha beta"), (5, "\n" * 90 + "gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    words = ["[UNK]", "alpha", "beta", "gamma", ",", "##e"]
    sort = lambda df: sorted((r["doc_id"] or 0, r["pos"], r["token"], r["token_id"]) for r in df.collect())
    whole, cut = sort(tx.wordpiece(docs, words)), sort(tx.wordpiece(docs, words, most=50))
    assert whole == cut and [x[1] for x in whole if x[0] == 1] == list(range(167))
    assert "".join(tx.portions(long, 50)) == long and len(list(tx.portions(long, 50))) > 10
    odd = spark.createDataFrame([(1, "a\tb\u00a0c\x1cd\u0301 e\r\nÉ,f 漢字\x85g\u2028h  \u0301 i\x00j")], "doc_id long, text string")
    t = tokenizers.Tokenizer(tokenizers.models.WordPiece(vocab := {w: i for i, w in enumerate(["[UNK]", *"abcdefghij漢,", *(f"##{c}" for c in "abcdefghij")])}, unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = tokenizers.normalizers.BertNormalizer(), tokenizers.pre_tokenizers.BertPreTokenizer()
    assert [x[3] for x in sort(tx.wordpiece(odd, list(vocab), most=4))] == t.encode(odd.first()["text"], add_special_tokens=False).ids
    monkeypatch.setattr(tx, "KNOWN", 3)  # words are forgotten and looked up again
    assert sort(tx.wordpiece(docs, words, most=50)) == whole


def test_points_of_equal_shares_are_equal(spark):
    docs = [(q, 128 + q % 2) for q in range(13)]
    every = spark.createDataFrame([(float(p), q, d) for q, n in docs for d in range(n) for p in (2, 3)], "param double, qid long, doc_id long")
    scores = every.where("param = 2").select("qid", "doc_id", (-F.col("doc_id")).cast("double").alias("score"))
    queries, n = scores.select("qid").distinct(), Fraction(sum(n for _, n in docs), 13)
    pts = sweeps.points(every, (2, 3), scores, scores.where("doc_id < 3 + qid % 5"), queries, n, first=None, fixed=False)
    assert sorted(map(tuple, pts.collect())) == [(2, 1, 1), (3, 1, 1)] and [r["param"] for r in sweeps.sorted_points(pts).collect()] == [2]
    one = sweeps.points(every.where("qid = 0 and doc_id = 0"), (2,), scores, scores, queries.where("qid = 0"), Fraction(1, 2), first=None, fixed=False)
    assert one.first()["frac"] == 2  # half a document a query in the mean, and this one has seen one


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_edges_are_exact_in_large_layers(spark):
    x = unit(np.random.default_rng(5), 4500, 8)
    x[4400:] = x[:100]  # copies: ties go to the smaller id
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, v array<double>")
    levels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0).alias("level"))
    got = {(r["layer"], r["src"], r["dst"]): r["sim"] for r in dense.graph_edges(docs, levels).collect()}
    want = {}
    for layer, ids in ((0, np.arange(4500)), (1, np.arange(0, 4500, 3)), (2, np.arange(0, 4500, 3))):
        sims = np.round(x[ids] @ x[ids].T, 9)
        np.fill_diagonal(sims, -2)
        for i, near in zip(ids, ids[np.argsort(-sims, axis=1, kind="stable")[:, :4]], strict=True):
            for j in near:
                want[layer, i, j] = want[layer, j, i] = x[i] @ x[j]
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 2e-9 for e in want)


def test_layers_in_which_no_node_ends_count(spark):
    levels = spark.createDataFrame([(0, 0), (1, 3), (2, 1), (3, 3)], "doc_id long, level int")
    edges = spark.createDataFrame([(2, 1, 3, 0.5), (2, 3, 1, 0.5)], "layer int, src long, dst long, sim double")
    got = {r["layer"]: (r["nodes"], r["avg_degree"]) for r in dense.layer_stats(levels, edges).collect()}
    assert got == {0: (4, 0), 1: (3, 0), 2: (2, 1), 3: (2, 0)}


def test_hops_of_all_layers_have_a_plan_of_scans(tok):
    s = dense.sentence_vectors(tok).cache()
    levels = s.select("doc_id", (F.col("doc_id") % 9).cast("int").alias("level"))
    edges = dense.graph_edges(s, levels)
    hops = dense.greedy_hops(s, levels, edges, s.select(F.col("doc_id").alias("qid"), F.col("v").alias("qv")))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (edges, hops)]
    assert hops.count() == 9 * 20 and not any(x in p for p in plans for x in ("Join", "Window", "Aggregate"))


def test_graph_search_completes_what_a_narrow_beam_misses(spark):
    x = unit(np.random.default_rng(6), 300, 24)
    x[150:] = x[:150]  # copies
    s = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, v array<double>").cache()
    qs = s.where("doc_id % 30 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("qv"))
    levels = dense.graph_levels(s)
    edges = dense.graph_edges(s, levels)
    exact = ranks(dense.exact_search(s, qs))
    assert ranks(dense.graph_search(s, levels, edges, qs, ef=12)) == exact
    assert ranks(dense.graph_search(s, levels, edges, qs, ef=3)) == exact  # fewer than ten found
    assert ranks(dense.graph_search(s, levels, edges, qs, ef=12, exact=False)) != exact
