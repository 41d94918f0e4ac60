"""Registered queries of sweeps, routing, labels, reports and file round trips, and their SQL. See registry for the fixtures.

A document's topic is doc_id % 5; the first three tokens of a topic are its centroids.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import labels
from .functions import text as tx
from .functions import vectors as v
from .functions.vectors import rounded
from .operators import dense, evaluate, filters, kmeans, score, sweeps, tac, warp
from .registry import BASE, POSTINGS, SENT, SIMS, TDF, U, UNIT, metadata, r6, register, setup, sql, table, tokens
from .shared import scratch, stored
from .sources import files
from .sources import vectors as src

PROBES, RANDOM, THRESHOLDS, BEAMS = (1, 2, 3, 5, 8), (0.05, 0.2, 0.5, 1.0), (0.1, 0.2, 0.3, 0.4, 2.0), (4, 10, 16, 24, 32)
TOPICS, PER_TOPIC = 5, 3


def values(xs) -> str:
    return ", ".join(f"({float(x)}::DOUBLE)" for x in xs)


def engine_params() -> str:
    pairs = [(e, x) for e, xs in (("random", RANDOM), ("plaid", PROBES), ("warp", THRESHOLDS), ("tac", PROBES)) for x in xs]
    return ", ".join(f"('{e}', {float(x)}::DOUBLE)" for e, x in pairs)


QIDS = "qids AS (SELECT DISTINCT qid FROM q), docs AS (SELECT DISTINCT doc_id FROM tok)"
ROUTE = f"""
tc AS (SELECT topic, (r - 1)::INT AS cid, e AS ce FROM (SELECT doc_id % {TOPICS} AS topic, e, row_number() OVER (PARTITION BY doc_id % {TOPICS} ORDER BY vec_id) AS r FROM tok) WHERE r <= {PER_TOPIC}),
tp AS (SELECT DISTINCT topic, b.cid AS cid, doc_id FROM (SELECT doc_id % {TOPICS} AS topic, doc_id, vec_id, max({{'s': round(list_dot_product(e, ce), 9), 'cid': cid}}) AS b FROM tok JOIN tc ON topic = doc_id % {TOPICS} GROUP BY ALL)),
ts AS (SELECT qid, qpos, topic, cid, round(list_dot_product(qe, ce), 9) AS sim FROM q, tc),
routed AS (SELECT qid, qpos, max({{'s': s, 't': topic}}).t AS topic FROM (SELECT qid, qpos, topic, max(sim) AS s FROM ts GROUP BY ALL) GROUP BY ALL)"""
CANDS = f"""
psims AS (SELECT qid, qpos, cid, row_number() OVER (PARTITION BY qid, qpos ORDER BY round(list_dot_product(qe, ce), 9) DESC, cid) AS r FROM q, c0),
xs AS (SELECT qid, doc_id, max(m) AS x FROM maxima GROUP BY ALL),
near AS (SELECT ts.qid, ts.topic, cid, row_number() OVER (PARTITION BY ts.qid, ts.qpos ORDER BY sim DESC, cid) AS r FROM ts JOIN routed USING (qid, qpos, topic)),
cands AS (
  SELECT 'random' AS engine, p AS param, qid, doc_id FROM docs, qids, (VALUES {values(RANDOM)}) t(p) WHERE {U.format(k="'7#' || doc_id")} < p
  UNION SELECT 'plaid', p, qid, doc_id FROM psims JOIN postings USING (cid), (VALUES {values(PROBES)}) t(p) WHERE r <= p
  UNION SELECT 'warp', p, qid, doc_id FROM xs, (VALUES {values(THRESHOLDS)}) t(p) WHERE x > p
  UNION SELECT 'tac', p, qid, doc_id FROM near JOIN tp USING (topic, cid), (VALUES {values(PROBES)}) t(p) WHERE r <= p
  UNION SELECT 'dense', p, qid, doc_id FROM sranked, ndocs, (VALUES {values(BEAMS)}) t(p) WHERE rank <= p AND p >= 10 AND p <= n),
params(engine, param) AS (SELECT * FROM (VALUES {engine_params()}) UNION SELECT 'dense', p FROM (VALUES {values(BEAMS)}) t(p), ndocs WHERE p >= 10 AND p <= n)"""


def points_sql(least: str, first: bool, scores: str, denominator: str, cands: str = "cands", params: str = "params", qids: str = "qids") -> str:
    filled = f"SELECT * FROM {cands}" + (f" UNION SELECT g.engine, g.param, g.qid, 0 FROM grid g WHERE NOT EXISTS (SELECT 1 FROM {cands} c WHERE c.engine = g.engine AND c.param = g.param AND c.qid = g.qid)" if first else "")
    return f"""
grid AS (SELECT * FROM {params}, {qids}),
filled AS ({filled}),
top AS (SELECT engine, param, qid, doc_id FROM (SELECT f.*, row_number() OVER (PARTITION BY engine, param, qid ORDER BY score DESC, doc_id) AS r FROM filled f JOIN {scores} USING (qid, doc_id)) WHERE r <= 10),
got AS (SELECT engine, param, qid, count(*) AS h FROM top JOIN truth USING (qid, doc_id) GROUP BY ALL),
num AS (SELECT engine, param, qid, count(*) AS c FROM {cands} GROUP BY ALL),
tn AS (SELECT qid, least(count(*), 10) AS t FROM truth GROUP BY 1),
pts AS (SELECT engine, param, avg(CASE WHEN {least} THEN greatest(coalesce(c, 0) / n, 1.0 / n) ELSE coalesce(c, 0) / n END) AS frac, avg(coalesce(coalesce(h, 0) / {denominator}, 0.0)) AS recall
  FROM grid LEFT JOIN num USING (engine, param, qid) LEFT JOIN got USING (engine, param, qid) LEFT JOIN tn USING (qid), ndocs GROUP BY ALL)"""


def topics(tok: DataFrame) -> DataFrame:
    return tok.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % TOPICS).cast("int").alias("topic"))


def world(spark, d) -> dict:
    """What the sweeps share."""
    tok, q, c = setup(spark, d)
    docs = tok.select("doc_id").distinct()
    s = dense.sentence_vectors(tok)
    ranked = dense.exact_search(s, s.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("qv")), max(sweeps.JUDGED_BEAMS))
    tc = sweeps.topic_centroids(tok, topics(tok), PER_TOPIC)
    n = docs.count()
    return {"tok": tok, "q": q, "docs": docs, "qids": q.select("qid").distinct(), "n": n, "maxima": score.batched_maxima(tok, q), "ranked": ranked, "postings": kmeans.postings(kmeans.assign(tok, c)), "c": c, "tc": tc, "tp": sweeps.topic_postings(tok, topics(tok), tc), "beams": sweeps.admissible(BEAMS, n)}


def candidate_sets(w: dict, thresholds=THRESHOLDS) -> dict[str, tuple[DataFrame, tuple]]:
    return {
        "random": (sweeps.random_candidates(w["docs"], w["qids"], RANDOM), RANDOM),
        "plaid": (sweeps.probe_candidates(w["q"], w["c"], w["postings"], PROBES), PROBES),
        "warp": (sweeps.threshold_candidates(w["maxima"], thresholds), thresholds),
        "tac": (sweeps.routed_candidates(w["q"], w["tc"], w["tp"], PROBES), PROBES),
        "dense": (sweeps.beam_candidates(w["ranked"], w["beams"]), tuple(w["beams"])),
    }


def curve(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, pts in parts.items():
        p = pts.select(F.lit(name).alias("engine"), "param", rounded(F.col("frac")).alias("frac"), rounded(F.col("recall")).alias("recall"))
        out = p if out is None else out.unionByName(p)
    return out


POINTS = f"SELECT engine, param, {r6('frac')} AS frac, {r6('recall')} AS recall FROM pts"


@register("tradeoff_points", sql(BASE, SIMS, SENT, POSTINGS, QIDS, ROUTE, CANDS, "truth AS (SELECT qid, doc_id FROM ranked WHERE rank <= 10)", points_sql("engine = 'warp'", True, "scores", "10.0"), select=POINTS + " WHERE engine <> 'warp' OR frac > 0.001"))
def _(spark, d):
    w = world(spark, d)
    exact = score.maxsim(w["maxima"])
    truth = score.top_k(exact, 10)
    parts = {e: sweeps.points(c, xs, exact, truth, w["qids"], w["n"], least=e == "warp") for e, (c, xs) in candidate_sets(w).items() if xs}
    parts["warp"] = sweeps.drop_low(parts["warp"])
    return curve(parts)


JUDGED_TRUTH = "truth AS (SELECT qid, doc_id FROM meta JOIN wants USING (category))"
JUDGED_PARAMS = f"jp AS (SELECT * FROM params WHERE engine IN ('plaid', 'warp', 'tac')), jc AS (SELECT * FROM cands WHERE engine IN ('plaid', 'warp', 'tac')), ws AS (SELECT qid, doc_id, round(sum(w * m), 9) AS score FROM maxima JOIN qw USING (qid, qpos) GROUP BY ALL)"


@register("judged_points", sql(BASE, SIMS, SENT, POSTINGS, QIDS, ROUTE, CANDS, TDF, JUDGED_PARAMS, JUDGED_TRUTH, points_sql("engine = 'warp'", True, "ws", "t", "jc", "jp"),
    f"""full_ AS (SELECT 'colbert' AS engine, 1.0::DOUBLE AS param, qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM ws) WHERE r <= 10
      UNION ALL SELECT 'hnsw', p, qid, doc_id FROM sranked, ndocs, (VALUES {values((10, 20, 30, 50))}) t(p) WHERE rank <= 10 AND p <= n),
    others AS (SELECT engine, param, CASE WHEN engine = 'hnsw' THEN param / any_value(n) ELSE 1.0 END AS frac, sum(CASE WHEN truth.doc_id IS NULL THEN 0 ELSE 1.0 / t END) / (SELECT count(*) FROM qids) AS recall
      FROM full_ LEFT JOIN truth USING (qid, doc_id) LEFT JOIN tn USING (qid), ndocs GROUP BY engine, param)""",
    select=f"SELECT engine, param, {r6('frac')} AS frac, {r6('recall')} AS recall FROM (SELECT * FROM pts WHERE engine <> 'warp' OR frac > 0.005 UNION ALL SELECT * FROM others)"))
def _(spark, d):
    w = world(spark, d)
    q = tx.query_weights(w["q"], tx.document_frequency(w["tok"], token="token_id"), w["n"], "token_id").select("qid", "qpos", "w")
    weighted = score.maxsim(w["maxima"].join(score.checked_broadcast(q), ["qid", "qpos"]))
    meta, wants = metadata(w["tok"])
    truth = labels.heuristic_labels(meta, wants)
    sets = candidate_sets(w)
    parts = {e: sweeps.points(*sets[e], weighted, truth, w["qids"], w["n"], least=e == "warp", fixed=False) for e in ("plaid", "warp", "tac")}
    parts["warp"] = sweeps.drop_low(parts["warp"], 0.005)
    every = weighted.select(F.lit(1.0).alias("param"), "qid", "doc_id")
    parts["colbert"] = sweeps.points(every, (1.0,), weighted, truth, w["qids"], w["n"], fixed=False).withColumn("frac", F.lit(1.0))
    beams = [x for x in (10, 20, 30, 50) if x <= w["n"]]
    if beams:
        first = w["ranked"].where("rank <= 10").select("qid", "doc_id", "score", sweeps.params(beams))
        pts = sweeps.points(first.select("param", "qid", "doc_id"), beams, w["ranked"], truth, w["qids"], w["n"], fixed=False)
        parts["hnsw"] = pts.withColumn("frac", F.col("param") / w["n"])
    return curve(parts)


MODES = ("none", "category", "category_year")
MODE_SQL = {"none": "SELECT qid, doc_id FROM qids, docs", "category": "SELECT qid, doc_id FROM meta JOIN wants USING (category)", "category_year": "SELECT qid, doc_id FROM meta JOIN wants USING (category) WHERE year >= year_floor"}


def filtered_sql() -> str:
    allowed = "allowed AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, qid, doc_id FROM ({x})" for m, x in MODE_SQL.items()) + ")"
    return sql(BASE, SIMS, SENT, POSTINGS, QIDS, ROUTE, CANDS, allowed, """
fc AS (SELECT mode, engine, param, qid, doc_id FROM cands JOIN allowed USING (qid, doc_id) WHERE engine IN ('plaid', 'warp', 'tac')),
ftruth AS (SELECT mode, qid, doc_id FROM (SELECT mode, qid, doc_id, row_number() OVER (PARTITION BY mode, qid ORDER BY score DESC, doc_id) AS r FROM allowed JOIN scores USING (qid, doc_id)) WHERE r <= 10),
ftop AS (SELECT mode, engine, param, qid, doc_id FROM (SELECT fc.*, row_number() OVER (PARTITION BY mode, engine, param, qid ORDER BY score DESC, doc_id) AS r FROM fc JOIN scores USING (qid, doc_id)) WHERE r <= 10),
fgot AS (SELECT mode, engine, param, qid, count(*) AS h FROM ftop JOIN ftruth USING (mode, qid, doc_id) GROUP BY ALL),
fnum AS (SELECT mode, engine, param, qid, count(*) AS c FROM fc GROUP BY ALL),
ft AS (SELECT mode, qid, least(count(*), 10) AS t FROM ftruth GROUP BY ALL),
en AS (SELECT mode, count(*) / (SELECT count(*) FROM qids) AS en FROM allowed GROUP BY 1),
fgrid AS (SELECT * FROM (SELECT * FROM params WHERE engine IN ('plaid', 'warp', 'tac')), (SELECT DISTINCT mode, qid FROM allowed)),
fp AS (SELECT mode, engine, param, avg(CASE WHEN engine = 'warp' THEN greatest(coalesce(c, 0) / en, 1 / en) ELSE coalesce(c, 0) / en END) AS frac, avg(coalesce(h, 0) / t) AS recall
  FROM fgrid JOIN ft USING (mode, qid) JOIN en USING (mode) LEFT JOIN fnum USING (mode, engine, param, qid) LEFT JOIN fgot USING (mode, engine, param, qid) GROUP BY ALL)""",
        select=f"SELECT mode, engine, param, {r6('frac')} AS frac, {r6('recall')} AS recall FROM (SELECT *, row_number() OVER (PARTITION BY mode, engine, floor(frac * 1e6) ORDER BY frac, param) AS r FROM fp WHERE engine <> 'warp' OR frac > 0.001) WHERE r = 1")


@register("filtered_points", filtered_sql())
def _(spark, d):
    w = world(spark, d)
    exact, nq, out = stored(score.maxsim(w["maxima"]), "scores"), w["qids"].count(), None
    meta, wants = metadata(w["tok"])
    sets = {e: (stored(c, "candidates"), xs) for e, (c, xs) in candidate_sets(w).items() if e in ("plaid", "warp", "tac")}
    for mode in MODES:
        allowed = stored(filters.allowed(meta, wants, mode=mode), "allowed")
        n = Fraction(allowed.count(), max(1, nq))
        if not n:
            continue
        truth = stored(score.top_k(allowed.join(exact, ["qid", "doc_id"]), 10), "truth")
        for e in ("plaid", "warp", "tac"):
            c, xs = sets[e]
            pts = sweeps.points(c.join(allowed, ["qid", "doc_id"]).select("param", "qid", "doc_id"), xs, exact, truth, allowed.select("qid").distinct(), n, least=e == "warp", first=None, fixed=False)
            pts = sweeps.sorted_points(sweeps.drop_low(pts) if e == "warp" else pts)
            part = pts.select(F.lit(mode).alias("mode"), F.lit(e).alias("engine"), "param", rounded(F.col("frac")).alias("frac"), rounded(F.col("recall")).alias("recall"))
            part = stored(part, "points")  # the plans of all curves in one took the driver's memory
            out = part if out is None else out.unionByName(part)
    return out


@register("topic_routing", sql(BASE, ROUTE, select="SELECT qid, qpos, topic FROM routed"))
def _(spark, d):
    tok, q, _ = setup(spark, d)
    return sweeps.route(q, sweeps.topic_centroids(tok, topics(tok), PER_TOPIC)).select("qid", "qpos", F.col("topic").cast("long").alias("topic"))


@register("first_fallback", sql(BASE, SIMS, QIDS, "x AS (SELECT p, qid, doc_id FROM (SELECT qid, doc_id, max(m) AS x FROM maxima GROUP BY ALL), (VALUES (0.2::DOUBLE), (2.0)) t(p) WHERE x > p)", select="SELECT p AS param, qid, doc_id FROM x UNION ALL SELECT p, qid, 0 FROM (VALUES (0.2::DOUBLE), (2.0)) t(p), qids WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.p = t.p AND x.qid = qids.qid)"))
def _(spark, d):
    tok, q, _ = setup(spark, d)
    grid = spark.createDataFrame([(0.2,), (2.0,)], "param double").crossJoin(q.select("qid").distinct())
    return sweeps.with_first(sweeps.threshold_candidates(score.batched_maxima(tok, q), (0.2, 2.0)), grid)


@register("warp_fallback", sql(BASE, SIMS, select=f"SELECT qid, rank, doc_id, {r6('score')} AS score FROM ranked WHERE rank <= 10"))
def _(spark, d):
    tok, q, _ = setup(spark, d)
    return warp.search(tok, q, threshold=1.5).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", rounded(F.col("score")).alias("score"))


#: Query tokens of type 1 have centroids but no postings, those of type 2 and 3 neither.
@register("tac_fallbacks", sql(BASE, """
tc AS (SELECT token_id, (r - 1)::INT AS cid, e AS ce FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY vec_id) AS r FROM tok WHERE token_id NOT IN (2, 3)) WHERE r <= 4),
tb AS (SELECT DISTINCT token_id, b.cid AS cid, doc_id FROM (SELECT t.token_id, doc_id, vec_id, max({'s': round(list_dot_product(e, ce), 9), 'cid': cid}) AS b FROM tok t JOIN tc USING (token_id) GROUP BY ALL) WHERE token_id <> 1),
pr AS (SELECT * FROM (SELECT qid, qpos, q.token_id, cid, count(*) OVER (PARTITION BY qid, qpos) AS n, row_number() OVER (PARTITION BY qid, qpos ORDER BY round(list_dot_product(qe, ce), 9) DESC, cid) AS r FROM qq q JOIN tc USING (token_id)) WHERE r <= greatest(n // 2, 1))""".replace("tc AS", "qq AS (SELECT vec_id % 50 AS qid, vec_id // 50 AS qpos, token_id, e AS qe FROM tok WHERE vec_id < 500 AND vec_id % 50 < 5 AND vec_id // 50 < 3),\ntc AS", 1),
    select="SELECT DISTINCT qid, doc_id FROM pr JOIN tb USING (token_id, cid) UNION SELECT qid, doc_id FROM qq JOIN tok USING (token_id) WHERE token_id = 1 UNION SELECT qid, doc_id FROM (SELECT DISTINCT qid FROM qq WHERE token_id IN (2, 3)), (SELECT DISTINCT doc_id FROM tok)"))
def _(spark, d):
    tok = tokens(spark, d)
    q = tok.where("vec_id < 500 and vec_id % 50 < 5 and vec_id div 50 < 3").select((F.col("vec_id") % 50).alias("qid"), F.expr("vec_id div 50").alias("qpos"), "token_id", F.col("e").alias("qe"))
    c = kmeans.first_vectors(tok, spark.createDataFrame([(i, 4) for i in range(10) if i not in (2, 3)], "token_id int, kappa int"))
    return tac.candidates(q, c, kmeans.assign_types(tok, c).where("token_id <> 1"), tok)


@register("scan_sums", sql(BASE, SIMS, "s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY qid) AS n FROM scores)",
    select=f"SELECT qid, p AS share, count(*) AS docs, {r6('sum(score)')} AS total FROM s, (VALUES {values((1.0, 0.2, 0.05, 0.01))}) t(p) WHERE i <= greatest(floor(n * p + 1e-9), 1) GROUP BY ALL"))
def _(spark, d):
    tok, q, _ = setup(spark, d)
    return sweeps.scan_sums(score.maxsim(score.batched_maxima(tok, q))).withColumn("total", rounded(F.col("total")))


@register("memory_estimate", sql(BASE, select="SELECT token_id, count(DISTINCT doc_id) AS docs, count(DISTINCT doc_id) * 8 * 64 * 4 AS bytes FROM tok GROUP BY 1"))
def _(spark, d):
    n = tokens(spark, d).groupBy("token_id").agg(F.count_distinct("doc_id").alias("docs"))
    return n.withColumn("bytes", sweeps.memory_bytes(F.col("docs"), 8, dim=64))


@register("upper_median", "SELECT event_type, " + r6("value") + " AS value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = n // 2")
def _(spark, d):
    return sweeps.upper_median(table(spark, d, "events"), "value", "event_type").withColumn("value", rounded(F.col("value")))


@register("log_speedup", "SELECT doc_id, " + r6("log2(1.0 / greatest(least(n_chars / 20000.0, 1.0), 0.001))") + " AS speedup FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", rounded(evaluate.log_speedup(F.col("n_chars") / 20000.0)).alias("speedup"))


CATEGORY = "CASE WHEN doc_id <= 19 THEN 0 WHEN doc_id <= 39 THEN 1 WHEN doc_id <= 49 THEN 2 WHEN doc_id <= 59 THEN 3 WHEN doc_id <= 64 THEN 4 WHEN doc_id <= 69 THEN 5 WHEN doc_id <= 79 THEN 6 WHEN doc_id <= 89 THEN 7 WHEN doc_id <= 94 THEN 8 ELSE 9 END"


@register("category_ranges", f"SELECT doc_id, {CATEGORY} AS category FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", labels.category_of(F.col("doc_id")).alias("category"))


@register("topic_pick", f"SELECT doc_id, CASE WHEN u < 0.3 THEN 0 WHEN u < 0.6 THEN 1 WHEN u < 0.73 THEN 2 WHEN u < 0.87 THEN 3 ELSE 4 END AS topic FROM (SELECT doc_id, {U.format(k=chr(39) + 't#' + chr(39) + ' || doc_id')} AS u FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", labels.topic_of(v.hash_uniform(F.lit("t"), F.col("doc_id").cast("string"))).alias("topic"))


@register("heuristic_labels", f"SELECT qid, doc_id FROM (SELECT item_id AS qid, item_id % 10 AS category FROM benchmark) JOIN (SELECT doc_id, {CATEGORY} AS category FROM documents WHERE doc_id < 100) USING (category)")
def _(spark, d):
    docs = table(spark, d, "documents").where("doc_id < 100").select("doc_id", labels.category_of(F.col("doc_id")).alias("category"))
    return labels.heuristic_labels(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % 10).cast("int").alias("category")))


@register("results_with_texts", sql(BASE, SIMS, select="SELECT r.qid, rank, r.doc_id, d.text, coalesce(l.quality = 1, false) AS relevant FROM ranked r LEFT JOIN documents d ON d.doc_id = r.doc_id LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality = 1) l ON l.doc_id = r.doc_id WHERE rank <= 10"))
def _(spark, d):
    tok, q, _ = setup(spark, d)
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").crossJoin(score.checked_broadcast(q.select("qid").distinct()))
    out = labels.with_texts(score.search(tok, q), table(spark, d, "documents"), good)
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "text", "relevant")


@register("document_lookup", "SELECT doc_id, text FROM documents WHERE doc_id = 42")
def _(spark, d):
    return table(spark, d, "documents").where("doc_id = 42").select("doc_id", "text")


@register("topic_postings", sql(BASE, ROUTE, select="SELECT topic, cid, doc_id FROM tp"))
def _(spark, d):
    tok = tokens(spark, d)
    return sweeps.topic_postings(tok, topics(tok), sweeps.topic_centroids(tok, topics(tok), PER_TOPIC)).select(F.col("topic").cast("long").alias("topic"), "cid", "doc_id")


@register("filter_union", sql(BASE, "allowed AS (SELECT qid, doc_id FROM meta JOIN wants USING (category) WHERE year >= year_floor)", select="SELECT DISTINCT doc_id FROM allowed"))
def _(spark, d):
    return filters.union(filters.allowed(*metadata(tokens(spark, d))))


@register("concat_corpora", "SELECT 'document' AS part, doc_id, text FROM documents UNION ALL SELECT 'query', item_id, text FROM benchmark")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("part"), "doc_id", "text")
    return docs.unionByName(table(spark, d, "benchmark").select(F.lit("query").alias("part"), F.col("item_id").alias("doc_id"), "text"))


@register("rank_table", sql(BASE, select="SELECT token_id, n, rank FROM (SELECT token_id, n, row_number() OVER (ORDER BY n DESC, token_id) AS rank FROM (SELECT token_id, count(*) AS n FROM tok GROUP BY 1)) WHERE rank <= 15"))
def _(spark, d):
    return evaluate.rank_table(tx.token_frequency(tokens(spark, d), "token_id"), "n", "token_id").select("token_id", "n", F.col("rank").cast("long").alias("rank"))


@register("centroids_per_type", sql(BASE, select="SELECT token_id, least(count(*), 4 + token_id) AS centroids FROM tok GROUP BY 1"))
def _(spark, d):
    tok = tokens(spark, d)
    c = kmeans.first_vectors(tok, tok.select("token_id").distinct().withColumn("kappa", F.col("token_id") + 4))
    return c.groupBy("token_id").agg(F.count("*").alias("centroids"))


@register("pq_levels", "SELECT * FROM (VALUES (1, 128, 8, 1), (2, 64, 4, 1), (3, 32, 2, 1)) t(level, subspaces, dims, code_bits)")
def _(spark, d):
    return tac.pq_levels(spark)


@register("training_sample", sql(BASE, select=f"SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {U.format(k=chr(39) + '42#' + chr(39) + ' || vec_id')}, vec_id) AS r FROM tok) WHERE r <= 50"))
def _(spark, d):
    return kmeans.sample(tokens(spark, d), 50).select("vec_id")


@register("align_ids", "SELECT doc_id, array_to_string(list_resize(list_slice(x, 1, 6), 6, 0::BIGINT), ',') AS ids FROM (SELECT doc_id, [doc_id + i FOR i IN range(doc_id % 9)] AS x FROM documents)")
def _(spark, d):
    ids = F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), F.lit(1), (F.col("doc_id") % 9).cast("int")), lambda i: F.col("doc_id") + i)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(tx.align_ids(ids, 6), lambda x: x.cast("string")), ",").alias("ids"))


@register("resolve_tokens", sql(BASE, select="SELECT vec_id, token_id, CASE WHEN token_id < 5 THEN 'type' || token_id ELSE token_id::VARCHAR END AS token FROM tok"))
def _(spark, d):
    names = spark.createDataFrame([(i, f"type{i}") for i in range(5)], "token_id int, token string")
    return tx.resolve_tokens(tokens(spark, d).select("vec_id", "token_id"), names)


def _noise(d: str) -> str:
    return f"(2 * {U.format(k=d)} - 1)"


@register("biased_vectors", sql(BASE, "b AS (SELECT vec_id, [e[i] + 0.2 * " + _noise("'n' || vec_id || '#' || (i - 1)") + " FOR i IN range(1, 65)] AS vec FROM tok)", select=f"SELECT vec_id, {r6(UNIT.format(v='vec') + '[1]')} AS d1, {r6(UNIT.format(v='vec') + '[64]')} AS d64 FROM b"))
def _(spark, d):
    b = v.biased(F.col("e"), 0.2, F.concat(F.lit("n"), F.col("vec_id").cast("string")))
    return tokens(spark, d).select("vec_id", b.alias("b")).select("vec_id", rounded(F.get("b", F.lit(0))).alias("d1"), rounded(F.get("b", F.lit(63))).alias("d64"))


@register("mock_vectors", sql("m AS (SELECT doc_id, [sqrt(-2.0 * ln(greatest(" + U.format(k="doc_id || '#a' || i") + ", 1e-9))) * cos(6.283185307179586 * " + U.format(k="doc_id || '#b' || i") + ") FOR i IN range(16)] AS vec FROM documents)", select=f"SELECT doc_id, {r6(UNIT.format(v='vec') + '[1]')} AS d1, {r6(UNIT.format(v='vec') + '[16]')} AS d16 FROM m"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", v.mock_embedding(F.col("doc_id").cast("string"), 16).alias("m")).select("doc_id", rounded(F.get("m", F.lit(0))).alias("d1"), rounded(F.get("m", F.lit(15))).alias("d16"))


# files written to the shared folder and read again
@register("packed_round_trip", sql(BASE, select="SELECT doc_id, pos, round(e[1], 6) + 0.0 AS d1, round(e[64], 6) + 0.0 AS d64 FROM tok"))
def _(spark, d):
    folder = scratch(spark, "packed")
    files.write_packed(tokens(spark, d), folder)
    return files.read_packed_shards(spark, folder, 64).select("doc_id", "pos", rounded(F.get("e", F.lit(0))).alias("d1"), rounded(F.get("e", F.lit(63))).alias("d64"))


@register("bvecs_round_trip", sql(BASE, select="SELECT vec_id, list_sum([floor(least(greatest((x + 1.0) * 127.5, 0.0), 255.0)) FOR x IN e])::BIGINT AS code_sum FROM tok"))
def _(spark, d):
    folder = scratch(spark, "bvecs")
    files.write_vecs(tokens(spark, d).select("vec_id", v.quantize(F.col("e")).alias("v")), folder, kind="b")
    back = src.read_vecs(spark, folder, kind="b")
    ids = files.vec_ids(spark, folder)
    return back.withColumn("file", F.substring_index("file", "/", -1)).join(ids, ["file", "id"]).select("vec_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).cast("long").alias("code_sum"))


@register("cache_round_trip", "SELECT vec_id AS doc_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS d1 FROM embeddings")
def _(spark, d):
    path = scratch(spark, "cache")
    files.write_vector_cache(tokens(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("e").alias("v")), path)
    return src.read_vector_cache(spark, path).select("doc_id", rounded(F.get("v", F.lit(0))).alias("d1"))


@register("label_cache_round_trip", "SELECT DISTINCT lang AS query, doc_id FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    path = scratch(spark, "labels")
    files.write_label_cache(table(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("query"), "doc_id").distinct(), path)
    return src.read_label_cache(spark, path)


@register("tsv_scan", "SELECT doc_id, text FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r > 5 AND r <= 105")
def _(spark, d):
    path = scratch(spark, "tsv")
    docs = table(spark, d, "documents").where("text is not null")
    docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.translate("text", "\n\r", "  ")).alias("value")).write.text(path)
    return src.read_tsv(spark, path, skip=5, take=100)


@register("pooled_tokens", sql(BASE, "pm AS (SELECT doc_id, pos // 2 AS pos, d, avg(x) AS m FROM (SELECT doc_id, pos, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM tok) GROUP BY ALL), pv AS (SELECT doc_id, pos, list(m ORDER BY d) AS m FROM pm GROUP BY ALL)", select=f"SELECT doc_id, pos, {r6(UNIT.format(v='m') + '[1]')} AS d1 FROM pv"))
def _(spark, d):
    return src.pool_tokens(tokens(spark, d), 2).select("doc_id", "pos", rounded(F.get("e", F.lit(0))).alias("d1"))


@register("wordpiece_tokens")
def _(spark, d):
    """Pieces are the words and letters of the benchmark: a vocabulary file that the query writes itself."""
    words = tx.tokenize(table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")).select("token").distinct()
    vocabulary = [r["token"] for r in words.orderBy("token").collect()]  # of the benchmark, not of the corpus
    letters = sorted({c for w in vocabulary for c in w})
    return tx.wordpiece(table(spark, d, "documents"), ["[UNK]", *vocabulary, *letters, *(f"##{c}" for c in letters)])
