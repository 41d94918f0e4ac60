"""Each stage against a brute-force version, on its own input."""

import random
from collections import Counter

import corpus_pipeline
from maxfold.llm import decontaminate, quality
from maxfold.llm import queries as registered

from .helpers import DOCUMENTS, corpus, documents, words
from .test_operators import LABELS, bag, brute_classes, brute_repeats, junk

STAGES = dict(corpus_pipeline.STAGES)


def folder(spark, tmp_path):
    rng = random.Random(21)
    rows = [r for r in corpus() if r[0] is not None]
    item = words(rng, 40, 9000)
    rows += [(3000 + i, junk(rng, 80)) for i in range(40)]
    rows += [(4000, f"{words(rng, 40)} {item} {words(rng, 10)}"), (4001, words(rng, 100))]
    documents(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(3000 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), item


def test_stages_by_brute_force(spark, tmp_path):
    sf, docs, item = folder(spark, tmp_path)
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    out = STAGES["quality"](spark, docs, sf)
    assert out.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    want = rows(docs)
    assert rows(out) == Counter({k: n for k, n in want.items() if scores[k[0]] >= 0.5})
    assert not [k for k, _ in rows(out) if 3000 <= k < 3040] and {i for i in range(60)} <= {k for k, _ in rows(out)}

    out = STAGES["near_dedup"](spark, docs, sf)
    classes = brute_classes([(d, t) for d, t in want])
    assert out.columns == docs.columns
    assert rows(out) == Counter({k: 1 for k in want if classes[k[0]] == k[0]})

    unique = docs.dropDuplicates(["doc_id"])
    out = STAGES["suffix_dedup"](spark, unique, sf)
    gone = brute_repeats([(r["doc_id"], r["text"]) for r in unique.collect()])
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    for d, (n, removed, _, _) in gone.items():
        if d == 156:
            continue
        assert (d not in kept and removed == n) or len((kept[d] or "").encode()) == n - removed

    out = STAGES["decontamination"](spark, docs, sf)
    assert out.columns == docs.columns
    assert rows(out) == Counter({k: n for k, n in want.items() if decontaminate.normalise(item) not in decontaminate.normalise(k[1])})

    out = STAGES["mixing"](spark, docs, sf).collect()
    total = sum(len((t or "").split()) * n for (_, t), n in want.items())
    assert all(r["taken"] in (r["size"], 2 * r["size"]) and r["size"] > 0 for r in out)
    assert abs(sum(r["taken"] for r in out) - 1.5 * total) <= 30000


def test_run_and_empty_input(spark, tmp_path):
    sf, docs, _ = folder(spark, tmp_path)
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got and 4000 not in got and not {101, 102, 103} & got and not {3000, 3001} & got
    none = spark.createDataFrame([], DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(31)
    copied = words(rng, 80, 9000)
    rows = [(i, words(rng, 60, 9000), f"s{i % 2}") for i in range(20)] + [(5000 + i, junk(rng, 80), "s0") for i in range(20)]
    rows += [(None, words(rng, 60, 9000), "s0") for _ in range(15)]
    rows += [(30, copied, "s1"), (31, copied, "s1"), (31, words(rng, 70, 9000), "s1"), (31, words(rng, 75, 9000), "s1"), (0, rows[0][1], "s0")]
    documents(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in (*range(20), 30, 31)] + [(5000 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(rng, 40, 9000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = documents(spark, [r for r in rows if r[0] is None or r[0] < 5000], extra=False)
    pairs = lambda out: Counter((r["doc_id"], r["text"]) for r in out)
    want = Counter((d, t) for d, t in {r[:2] for r in rows} if (d is None or d < 5000) and (d, t) != (31, copied))
    assert pairs(STAGES["near_dedup"](spark, clean, str(tmp_path)).collect()) == want

    out = STAGES["mixing"](spark, clean, str(tmp_path)).collect()
    mix = corpus_pipeline.mixing.mix_sources(clean, corpus_pipeline.mixing.quality_weights(spark.createDataFrame(labels, LABELS))).where("taken > 0").collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in out) == Counter((r["doc_id"], r["size"], r["taken"]) for r in mix)
    assert [r for r in out if r["doc_id"] is None] and {r["text"] for r in out if r["doc_id"] == 31}

    whole = {(r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert [t for d, t in whole if d is None] and [t for d, t in whole if d == 31]


CLASHING = "_id long, _row long, size string, target string, taken string, _quality string, _leaks string, `weird name` int"


def test_further_columns_of_any_name_pass_through(spark, tmp_path):
    sf, docs, _ = folder(spark, tmp_path)
    more = spark.createDataFrame([(*r, i, 7, "s", "t", "u", "q", "l", 1) for i, r in enumerate(docs.union(docs.limit(3)).collect())], f"{DOCUMENTS}, {CLASHING}")
    plain = docs.union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        out, want = stage(spark, more, sf), stage(spark, plain, sf)
        if name == "mixing":
            kept = [c for c in more.columns if c not in corpus_pipeline.ADDED]
            assert out.columns == [*kept, *corpus_pipeline.ADDED]
        else:
            assert out.columns == more.columns
        key = lambda r: (r["doc_id"], r["text"])
        assert Counter(map(key, out.collect())) == Counter(map(key, want.collect())), name
        assert {r["_quality"] for r in out.select("_quality").collect()} == {"q"}


def test_every_operator_is_registered():
    names = registered.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert bag("a b c d e f")[("a", "b", "c", "d", "e")] == 1
