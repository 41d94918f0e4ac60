import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest

from maxfold.llm import ann, chat, decontaminate, exactdup, licenses, mixing, neardup, quality, tokens, toxicity
from maxfold.llm.boosting import BoostedTrees, Isotonic, sigmoid
from maxfold.llm.components import connected_components
from maxfold.llm.suffix import suffix_array

from .helpers import corpus, documents, words

LABELS = "doc_id long, quality int, toxic int"


# 1 ann


def cosine(a, b):
    """Of vectors of any lengths: what one lacks is zero."""
    return sum(x * y for x, y in zip(a, b)) / np.linalg.norm(a) / np.linalg.norm(b)


def brute_nearest(rows, k=5, every=50):
    """rows: (id, vector); an id may have several vectors."""
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max([best.get(i, -2)] + [cosine(x, v) for j, x in rows if j == q])
        out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted((-round(s, 12), i) for i, s in best.items())[:k])]
    return out


def test_ann_small_is_exact_and_ignores_bad_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    good[51] = (51, good[50][1])
    good[52] = (52, good[50][1])  # equal vectors: ties to the smaller id
    good += [(450, [1.0]), (451, rng.normal(size=11).tolist()), (7, rng.normal(size=8).tolist()), (50, good[3][1]), (3, good[60][1])]
    bad = [(200, None), (250, [0.0] * 8), (300, [1.0, None] + [0.0] * 6), (350, [float("nan")] * 8), (400, [float("inf")] + [0.0] * 7), (None, good[1][1]), (500, [])]
    rows = [(i, v, "x", 1) for i, v in [*good, *bad, good[7]]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, rank int")
    got = ann.nearest(df, min_candidates=1000).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(brute_nearest(good))
    assert all(r["score"] == pytest.approx(max(cosine(x, y) for i, x in good for j, y in good if i == r["query_id"] and j == r["vec_id"]), abs=1e-12) for r in got)
    assert ann.nearest(df.limit(0)).count() == 0
    few = df.where("vec_id in (100, 61, 62)")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(few).orderBy("rank").collect()] == [(r, i) for _, r, i in brute_nearest([x for x in good if x[0] in (100, 61, 62)])]


def test_ann_recall(spark):
    rng = np.random.default_rng(4)
    v = {i: x for i, x in enumerate(rng.normal(size=(3000, 32)).tolist())}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df).collect()}
    want = set()
    x = np.array([v[i] for i in sorted(v)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 3000, 50):
        near = x @ x[q]
        near[q] = -2
        want |= {(q, int(i)) for i in np.argsort(-near)[:5]}
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_cell_order_is_by_summed_distance():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(6), rng.random(5)
    sizes = np.ones(30, int)
    got = ann.cell_order(d1, d2, sizes, 30)
    sums = [d1[c // 5] + d2[c % 5] for c in got]
    assert sorted(got) == list(range(30)) and sums == sorted(sums)


# 2 quality


def junk(rng, n):
    return " ".join(f"w{rng.randrange(400)}{rng.choice(['###', '$$$', '%%%'])}" for _ in range(n))


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    rng = random.Random(5)
    rows = [(i, junk(rng, 60) if i % 4 == 0 else words(rng, 80)) for i in range(600)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 1)], LABELS)
    got = {r["doc_id"]: r for r in quality.score_quality(documents(spark, rows), labels).collect()}
    wrong = sum((got[i]["keep"] == 1) != (i % 4 != 0) for i in range(300, 600))
    assert len(got) == 600 and wrong <= 6
    assert all(0 <= got[i]["score"] <= 1 and 0 <= got[i]["page_score"] <= 1 for i in got)


def test_quality_edges(spark):
    docs = documents(spark, corpus())
    none = spark.createDataFrame([], LABELS)
    got = quality.score_quality(docs, none).collect()
    assert len(got) == docs.count() and all(r["keep"] == 1 and r["score"] == 1.0 for r in got)
    assert quality.score_quality(docs.limit(0), none).count() == 0
    kept = quality.with_quality(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS), "_quality")
    assert kept.columns == [*docs.columns, "_quality"] and kept.count() == docs.count()
    with pytest.raises(ValueError, match="already"):
        quality.with_quality(docs, none, "score")


def test_boosting_and_isotonic():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees(trees=60, depth=3).fit(x[:1000], y[:1000])
    assert ((m.score(x[1000:]) > 0) == (y[1000:] > 0.5)).mean() > 0.95
    s = m.score(x[1000:])
    p = Isotonic(s, y[1000:])(np.sort(s))
    assert (np.diff(p) >= 0).all() and 0 <= p[0] and p[-1] <= 1
    ids = m.leaf_ids(x[:50])
    assert np.array_equal(m.at_leaves(ids), m.score(x[:50]))
    sums = m.leaf_sums(ids, y[:50])
    assert all(sums[t, leaf] == y[:50][ids[:, t] == leaf].sum() for t in range(0, 60, 7) for leaf in range(8))


def test_views_exchange_pseudo_labels():
    """One round against the same sums and steps written out row by row."""
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.6).astype(float)
    views = [rng.normal(size=(300, 3)) + 2 * y[:, None], rng.normal(size=(300, 2)) + 1.5 * y[:, None]]
    pool_y = (rng.random(200) < 0.5).astype(float)
    pool = [rng.normal(size=(200, 3)) + 2 * pool_y[:, None], rng.normal(size=(200, 2)) + 1.5 * pool_y[:, None]]
    fold = np.arange(300) % quality.FOLDS
    model = quality.CoTrained().fit(views, y, fold)
    assert len(model.models) == quality.FOLDS + 1
    told = model.gather(model.leaves(pool))
    half = model.gather(model.leaves([x[:90] for x in pool])) + model.gather(model.leaves([x[90:] for x in pool]))
    assert np.allclose(told, half)
    want = []
    for m, pair in enumerate(model.models):
        known = fold != m - 1
        sure = [model.calibrated[v](pair[v].score(pool[v])) for v in (0, 1)]
        for v, t in enumerate(pair):
            g, h = np.zeros((t.trees, 8)), np.zeros((t.trees, 8))
            at = t.leaf_ids(views[v][known])
            for row, label in zip(at, y[known]):
                p = sigmoid(t.base + sum(t.leaves[i, leaf] for i, leaf in enumerate(row)))
                for i, leaf in enumerate(row):
                    g[i, leaf] += p - label
                    h[i, leaf] += p * (1 - p)
            for label in (0.0, 1.0):
                rows = [i for i in range(200) if (sure[1 - v][i] if label else 1 - sure[1 - v][i]) >= quality.CONFIDENCE]
                assert told[m, v, int(label), -1] == len(rows)
                for row, p in zip(t.leaf_ids(pool[v][rows]), sigmoid(t.score(pool[v][rows]))):
                    for i, leaf in enumerate(row):
                        scale = quality.PSEUDO_WEIGHT * (y[known] == label).sum() / len(rows)
                        g[i, leaf] += scale * (p - label)
                        h[i, leaf] += scale * p * (1 - p)
            want.append(t.leaves - g / (h + t.l2) / t.trees)
    before = model.calibrated
    model.exchange(told)
    assert all(np.allclose(t.leaves, w, atol=1e-8) for t, w in zip([t for pair in model.models for t in pair], want))
    assert model.calibrated is not before
    scores = model.light().score(pool)
    assert ((scores[2] > 0.5) == pool_y).mean() > 0.9


# 3 suffix sort


def brute_repeats(rows, n=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) of rows with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            w = x[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(x), sum(gone), spans, hashlib.sha256(kept).digest())
    return out


@pytest.mark.parametrize("letters", [1, 2, 4, 300, 40000])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in [*range(25), 100, 500]:
        t = rng.integers(0, letters, n)
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_sha256"])) for r in df.collect()}


def test_repeats_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(d, t) for d, t in dict(r for r in corpus() if r[0] is not None).items()]
    rows += [(500 + i, "".join(rng.choice("ab") for _ in range(300))) for i in range(10)]
    rows += [(600, "ab" * 400), (601, "ba" * 300), (602, "\0" * 250), (603, "x" * 99), (604, "x" * 100), (605, "x" * 101)]
    got = result(exactdup.find_repeats(documents(spark, rows)))
    assert got == brute_repeats(rows)


def test_repeats_with_hot_names(spark, monkeypatch):
    monkeypatch.setattr(exactdup, "HOT", 2)
    monkeypatch.setattr(exactdup, "CHUNK", 2000)
    monkeypatch.setattr(exactdup, "SORT", 1000)
    monkeypatch.setattr(exactdup, "STEP", 700)
    rows = [(d, t) for d, t in dict(r for r in corpus(9) if r[0] is not None).items()]
    assert result(exactdup.find_repeats(documents(spark, rows))) == brute_repeats(rows)


def test_repeats_edges(spark):
    docs = documents(spark, corpus())
    got = exactdup.find_repeats(docs).collect()
    assert len(got) == docs.count()
    twice = [r for r in got if r["doc_id"] == 0]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n_removed"] == 0
    assert exactdup.find_repeats(docs.limit(0)).count() == 0
    assert exactdup.strip_repeats(docs.limit(0)).count() == 0


def test_strip_repeats_keeps_columns_and_drops_copies(spark):
    docs = documents(spark, corpus())
    out = exactdup.strip_repeats(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = out.collect()
    ids = Counter(r["doc_id"] for r in got)
    assert not {101, 102, 103, 104} & set(ids) and {100, 150, 151, 152, 153, 154} <= set(ids)
    assert next(r for r in got if r["doc_id"] == 150)["text"] is None
    want = brute_repeats([(d, t) for d, t in dict(r for r in corpus() if r[0] is not None).items()])
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 156:
            n, gone, _, _ = want[r["doc_id"]]
            assert len((r["text"] or "").encode()) == n - gone
            assert r["text"] is None or not gone or r["n_chars"] == len(r["text"])


# 4 decontamination


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(6)
    for _ in range(60):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert decontaminate.myers(p, t)[0] == edit_distance_within(p, t)


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[i : i + (kind != 1)] = [] if kind == 0 else ["q"]
    return "".join(s)


def test_leaks_match_brute_force(spark):
    rng = random.Random(7)
    items = [(i, words(rng, rng.randrange(8, 40))) for i in range(12)]
    docs = [(i, words(rng, 60)) for i in range(20)]
    for i, (_, t) in enumerate(items):
        budget = int(len(t) * decontaminate.ERROR_RATE)
        docs.append((100 + i, f"{words(rng, 20)} {t.upper()}\n\n{words(rng, 9)}"))
        docs.append((200 + i, f"{words(rng, 20)} {edited(rng, t, budget)} {words(rng, 9)}"))
        docs.append((300 + i, f"{words(rng, 20)} {edited(rng, t, budget * 3 + 4)}"))
    docs += [(400, None), (401, ""), (None, items[0][1]), (100, "repeated row"), (402, words(rng, 20000) + items[3][1])]
    docs += [(403, "a short one."), (404, "a shorts one, shortone, short ones"), (405, "x91 ax9 (x9)"), (406, "ax9 x99")]
    small = {92: {403}, 93: {405}}
    bench = spark.createDataFrame([*items, (90, None), (None, "no id but a text of some length"), (91, ""), (92, "Short  one"), (93, "x9"), items[0]], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(documents(spark, docs), bench).collect())
    want = Counter()
    for d, t in docs:
        norm = decontaminate.normalise(t)
        for i, x in items:
            n = edit_distance_within(x, norm) if len(norm) < 5000 else (0 if x in norm else 10**6)
            if n <= int(len(x) * decontaminate.ERROR_RATE):
                want[(d, i, n)] += 1
        for i, at in small.items():
            want[(d, i, 0)] += d in at
    assert got == +want


def test_leaks_edges(spark):
    docs = documents(spark, corpus())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0
    assert decontaminate.with_leaks(docs, none, "_leaks").count() == docs.count()
    assert decontaminate.find_leaks(docs.limit(0), none).count() == 0


def test_leaks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_CHARS", 60)
    rng = random.Random(9)
    items = [(i, words(rng, 10)) for i in range(6)]
    docs = documents(spark, [(1, " ".join(t for _, t in items)), (2, words(rng, 50))])
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, i) for i in range(6)]


# 5 mixing


def brute_targets(sizes):
    """Water filling by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / w for s in names}
        capped |= over


def mixing_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randrange(1, 60)), f"s{rng.randrange(7)}") for i in range(400)]
    rows += [(1000 + i, words(rng, 20), None) for i in range(30)] + [(2000, None, "s1"), (2001, "", "s2"), (2002, "x " * 5000, "huge"), (2003, "", "empty")]
    return [*rows, rows[0], (None, "a b c", "s3")]


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_mix_meets_targets(spark, buckets):
    rows = mixing_rows()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400, 3)] + [(None, 1, 1), (3, None, 1)], LABELS)
    got = mixing.mix_sources(documents(spark, rows), mixing.quality_weights(labels), buckets=buckets).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = brute_targets(sizes)
    largest, taken = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6, s
    if buckets == 7:
        again = mixing.mix_sources(documents(spark, rows[::-1]), mixing.quality_weights(labels)).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_prefers_good_documents(spark):
    rows = [(i, "a b c d", s) for i in range(3000) for s in (("a",) if i % 3 else ("b",))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)], LABELS)
    got = mixing.mix_sources(documents(spark, rows, extra=False), mixing.quality_weights(labels)).where("source = 'a'").toPandas()
    picked = got.taken > got.taken.min()
    assert 0 < picked.sum() < len(got)
    assert picked[got.doc_id % 2 == 1].mean() > picked[got.doc_id % 2 == 0].mean() + 0.2


def test_mix_edges(spark):
    none = documents(spark, [])
    assert mixing.mix_sources(none).count() == 0
    only = mixing.mix_sources(documents(spark, [(1, None, None), (2, "", "x")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2


def test_mix_of_equal_rows_shares_what_is_left(spark):
    rows = [(None, "a b c d e", "a")] * 900 + [(i, "x y", "b") for i in range(2000)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    a = [r for r in got if r["source"] == "a"]
    assert len({r["taken"] for r in a}) == 1 and abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 900
    assert all(r["taken"] <= 2 * r["size"] for r in got)


# 6 tokens


def test_token_counts(spark):
    rows = corpus()
    docs = documents(spark, rows).repartition(3)
    encoder = tokens._encoder(None)
    want = Counter((d, len(encoder.encode_ordinary(t or ""))) for d, t in rows)
    for stores in (tokens.RANGED, ()):
        got = tokens.count_document_tokens(docs, ranged=stores)
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
        assert tokens.count_document_tokens(docs.limit(0), ranged=stores).count() == 0


@pytest.mark.parametrize("fan", [1, 3, 1024])
@pytest.mark.parametrize("step", [2, 5, 16, 1 << 22])
def test_token_files_round_trip(spark, tmp_path, monkeypatch, step, fan):
    monkeypatch.setattr(tokens, "FAN", fan)
    rng = random.Random(step + fan)
    want = {}
    for f in range(3):
        lengths = [rng.choice([0, 0, 1, 2, 5, 30]) for _ in range(rng.randrange(0, 12))]
        tail = rng.choice([0, 4])
        ids = [x for n in lengths for x in [*[7] * n, tokens.EOD]] + [0xC450 >> 8 | 0x5000] * tail
        (tmp_path / f"f{f}.bin").write_bytes(struct.pack(f"<{len(ids)}H", *ids))
        want[f"f{f}.bin"] = [(n, True) for n in lengths] + ([(tail, False)] if tail else [])
    for stores in (tokens.RANGED, ()):  # by byte ranges, and whole
        found = {}
        for r in tokens.count_tokens(tokens.scan_files(spark, str(tmp_path), step=step, ranged=stores)).orderBy("file_id", "ordinal").collect():
            rows = found.setdefault(r["file_id"].rsplit("/", 1)[-1], [])
            assert r["ordinal"] == len(rows)
            rows.append((r["n_tokens"], r["complete"]))
        assert found == {k: v for k, v in want.items() if v}


# 7 licenses


def brute_licenses(rows):
    """Every window of every template counted word by word; overlaps settled by looking at all pairs."""
    templates = licenses.compile_templates()
    phrases = [(name, w, x.split()) for name, x, w in licenses.phrase_rows()]
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        s = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
        spans = {(name, 1.0, n, i, i + n) for name, n, x in phrases for i in range(len(w)) if w[i] == x[0] and w[i : i + n] == x}
        for c in templates:
            shingles = set(c.shingles)
            wins, every = [], [i for i, x in enumerate(s) if x in shingles]
            for a in sorted({a for i in every for a in range(max(0, i - c.window + 1), i + 1) if a % c.stride == 0}):
                at = [i for i in every if a <= i < a + c.window]
                held = len({s[i] for i in at})
                if held >= 0.8 * len(c.shingles):
                    wins.append((held, -a, at))
            for held, a, at in wins:
                if not any((h, b) > (held, a) and abs(a - b) < c.window for h, b, _ in wins):
                    spans.add((c.license, held / len(c.shingles), held + 4, at[0], at[-1] + 5))
        for name, share, m, a, b in spans:
            rank = (-m, -share, name)
            if not any(y[0] != name and y[3] < b and a < y[4] and (-y[2], -y[1], y[0]) < rank for y in spans):
                best = (share, m, -a, len(w))
                out[(d, name)] = max(out.get((d, name), best), best)
    return out


def scanned(df):
    return {(r["doc_id"], r["license"]): (r["containment"], r["matched"], -r["word"], r["n_words"]) for r in df.collect()}


def test_licenses_match_brute_force(spark):
    rng = random.Random(11)
    rows = corpus()
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        rows.append((1000 + i, f"{words(rng, rng.randrange(0, 40))}\n{t}\n{words(rng, 30)}"))
        w = t.split()
        if len(w) > 20:
            w[3] = "oops"
        rows.append((2000 + i, " ".join(w).upper()))
    both = " ".join(t for n, t in licenses.TEMPLATES if n in ("GPL-2.0", "GPL-3.0"))
    rows += [(3000, "license " * 500), (3001, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (1000, rows[-1][1]), (3002, both), (3003, f"{both} " * 3)]
    got = scanned(licenses.scan_licenses(documents(spark, rows)))
    assert got == brute_licenses(rows)
    assert {n for _, n in got} >= {n for n, _ in licenses.TEMPLATES} - {"0BSD"}
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_versions_and_headers_are_told_apart(spark):
    header = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 100)
    rows = [(1, "one two three four This work is licensed under the GNU General Public License, version 3."), (2, f"a b c d {header}"), (3, "")]
    got = scanned(licenses.scan_licenses(documents(spark, rows)))
    assert set(got) == {(1, "GPL-3.0"), (2, "Apache-2.0")}
    assert got[(1, "GPL-3.0")][:3] == (1.0, 12, -4) and got[(2, "Apache-2.0")][0] == 1.0 and got[(2, "Apache-2.0")][2] == -4


def test_license_texts_from_a_table(spark):
    rng = random.Random(3)
    text = f"this license {words(rng, 900)} of this software " + words(rng, 900).replace("w1", "license w1")
    table = spark.createDataFrame([("Own-1.0", text), ("MIT", "Released under the MIT License."), (None, text), ("x", None)], "license string, text string")
    rows = [(1, f"{words(rng, 300)} {text} {words(rng, 300)}"), (2, words(rng, 3000)), (None, text), (None, text)]
    got = scanned(licenses.scan_licenses(documents(spark, rows), table))
    assert got[(1, "Own-1.0")][:3] == (1.0, len(text.split()), -300) and got[(None, "Own-1.0")][0] == 1.0 and not [k for k in got if k[0] == 2]


def test_licenses_in_a_long_text(spark):
    """Twice the words in about twice the time; anchor words everywhere."""
    rng, took = random.Random(5), []
    import time

    for n in (100_000, 200_000):
        w = words(rng, n).split()
        w[::20] = ["license"] * len(w[::20])
        docs = documents(spark, [(1, " ".join(w) + " " + "Released under the MIT License. " * 200)]).cache()
        docs.count()
        began = time.time()
        assert scanned(licenses.scan_licenses(docs)) == {(1, "MIT"): (1.0, 5, -n, n + 1000)}
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 2


def test_templates_keep_the_guarantee():
    for t in licenses.compile_templates():
        assert (1 - t.jaccard) ** licenses.BANDS < 1e-7, t.license
    with pytest.raises(ValueError, match="fewer"):
        licenses.compile_templates([("x", "a license")])
    with pytest.raises(ValueError, match="anchor"):
        licenses.compile_templates([("x", "one two three four five six seven eight nine")])
    with pytest.raises(ValueError, match="key word"):
        licenses.phrase_rows({"x": ("one two three",)})


def test_short_notices_and_usual_wordings(spark):
    stated = {
        "All rights reserved.": "All-rights-reserved",
        "Licensed under the MIT License": "MIT",
        "SPDX-License-Identifier: MIT": "MIT",
        "Made available under the terms of the Apache License, Version 2.0": "Apache-2.0",
        "Distributed under the GNU GPL v3": "GPL-3.0",
        "Used under CC BY-SA 4.0 here": "CC-BY-SA-4.0",
        "This program is free software: you can redistribute it": "GPL-unversioned",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "GPL-2.0",
    }
    rows = [(i, f"one two -- {t}\nthree") for i, t in enumerate(stated)] + [(50, "ALL RIGHTS\nRESERVED"), (51, "overall rights reserved"), (52, "all rights, not reserved"), (None, "All rights reserved")]
    got = scanned(licenses.scan_licenses(documents(spark, rows)))
    assert {(i, name) for i, name in enumerate(stated.values())} <= set(got)
    assert got[(0, "All-rights-reserved")] == (1.0, 3, -2, 6) and got[(50, "All-rights-reserved")] == (1.0, 3, 0, 3)
    assert (None, "All-rights-reserved") in got and not {d for d, _ in got} & {51, 52}


# 8 toxicity


def test_toxicity_learns_words_and_obfuscation(spark):
    rng = random.Random(12)
    rude = ["blorgh", "snarfy", "vexwort"]
    rows = []
    for i in range(1500):
        w = words(rng, rng.randrange(10, 60)).split()
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), "you")
            w.insert(rng.randrange(len(w)), rng.choice(rude))
        rows.append((i, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "bl0rgh you"), (None, "x"), (0, rows[0][1])]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1500)] + [(None, 1, 1), (9, 1, None)], LABELS)
    got = toxicity.score_toxicity(documents(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    import zlib

    held = [r for r in got if r["held_out"] and r["doc_id"] < 1500]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert next(r for r in got if r["doc_id"] == 5002)["score"] > 0.5


def brute_shape(text):
    """Capitals, marks and shouted words, character by character."""
    word = lambda c: c.isalnum() or c == "_"
    upper = sum(c.isupper() for c in text)
    marks = sum(not word(c) and not c.isspace() for c in text)
    shouted = 0
    for run in re.findall(r"\w+", text):
        i = 0
        while i < len(run):
            j = i
            while j < len(run) and run[j].isupper():
                j += 1
            shouted += j - i >= 3 and i == 0 and j == len(run)
            i = max(j, i + 1)
    return upper, marks, shouted


def test_text_shapes_are_the_same_at_every_length():
    rng = random.Random(17)
    line = "ДА НЕТ Привет, МИР! ΑΒΓ ŁÓDŹ abcDEF ABC1 A_B \u2028 漢字 ÀÉÎ?? "
    texts = ["", "A", "ABC", "AB!", line, line * 200, "".join(rng.choice("ABcd1_ !?Ж") for _ in range(5000))]
    for t in texts:
        s = toxicity.Shape(t)
        assert (s.upper, s.marks, s.shouted) == brute_shape(t)
        assert s.n == max(1, len(s.words)) and s.you == sum(w in toxicity.SECOND_PERSON for w in s.words)
    assert toxicity.Shape(line * 200).upper == 200 * toxicity.Shape(line).upper


def test_lexicons_do_not_see_their_fold(spark):
    rng = random.Random(18)
    rows = [(f"{words(rng, 20)} {'blorgh' if i % 2 else 'fine'} {f'only{i % 3}' if i % 2 else ''}", i % 2, i % 3) for i in range(120)]
    got = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    assert all("blorgh" in x for x in got) and {"only0", "only1", "only2"} <= set(got[0])
    for f in range(3):
        assert f"only{f}" not in got[f + 1] and f"only{(f + 1) % 3}" in got[f + 1]
    pos = sum(y and "blorgh" in t for t, y, _ in rows)
    n_pos, n_neg = sum(y for _, y, _ in rows), sum(not y for _, y, _ in rows)
    assert got[0]["blorgh"] == pytest.approx(np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log(0.5 / (n_neg + 0.5)))


def test_toxicity_edges(spark):
    docs = documents(spark, corpus())
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 1) for i in range(60)], LABELS)
    assert {r["score"] for r in toxicity.score_toxicity(docs, one).collect()} == {1.0}
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


# 9 near-duplicates


def bag(text, k=5):
    w = (text or "").lower().split()
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def brute_classes(rows, similarity=0.8):
    bags = {d: bag(t) for d, t in rows if d is not None}
    ids = sorted(bags)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = sum((bags[a] & bags[b]).values())
            if common and common >= similarity * (sum(bags[a].values()) + sum(bags[b].values()) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def near_rows():
    rng = random.Random(14)
    rows = [r for r in corpus() if r[0] is not None]
    base = words(rng, 400, 5000).split()
    for i in range(60):  # variants that are linked through the original only
        w = list(base)
        for j in range(6):
            w[(i * 6 + j) * 61 % 400] = f"v{i}"
        rows.append((700 + i, " ".join(w)))
    rows.append((800, " ".join(base)))
    crowd = words(rng, 400, 5000).split()
    for i in range(120):  # near copies of one text, and some that only a few of these link
        w = list(crowd)
        for j in range(1 if i < 100 else 9):
            w[(i * 7 + j * 43) % 400] = f"u{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(900, "go " * 500), (901, "go " * 480), (902, "go " * 300)]
    return rows


@pytest.mark.parametrize("tile", [2048, 128, 16])
def test_near_duplicates_match_brute_force(spark, tile):
    rows = near_rows()
    got = neardup.near_duplicates(documents(spark, [*rows, (None, rows[0][1])]), tile=tile).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, [(3, None), (1, ""), (2, "a b"), (5, "A  b")])).collect()}
    assert got == {3: 3, 1: 1, 2: 2, 5: 2}


def test_bag_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for s in range(40):
        h = rng.integers(0, 2**63, 120).astype(np.uint64)
        a, b = rng.integers(1, 12, 100), rng.integers(1, 12, 100)
        x, y = (np.sort(h[:100]), a), (np.sort(h[20:]), b)
        got = (np.equal(*neardup.bag_signatures([x, y]))).mean()
        errors.append(got - neardup.overlap(x, y))
    assert abs(np.mean(errors)) < 0.03


def test_overlaps_match_one_by_one(monkeypatch):
    rng = np.random.default_rng(6)
    bags = [(np.unique(rng.integers(0, 60, n).astype(np.uint64)), None) for n in rng.integers(1, 50, 40)]
    bags = [(h, rng.integers(1, 5, len(h))) for h, _ in bags]
    for step in (1_000_000, 50):
        monkeypatch.setattr(neardup.Overlaps, "STEP", step)
        many = neardup.Overlaps(bags)
        for i in range(39):
            others = np.arange(i + 1, 40)
            assert np.array_equal(many(i, others), [neardup.overlap(bags[i], bags[j]) for j in others])


def test_components(spark):
    rng = random.Random(15)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 6000 + i) for i in range(500)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# 10 chat


def brute_chat(rows):
    conv = {}
    for c, t, r, x in set(rows):
        if c is not None:
            conv.setdefault(c, []).append((t, r, x))
    key = lambda v: tuple((x is not None, x if x is not None else 0) for x in v)
    seq = {c: [(r, x) for _, r, x in sorted(v, key=key)] for c, v in conv.items()}
    out = {}
    for c, s in seq.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seq.values())
        equal = [d for d, o in seq.items() if o == s]
        if not longer and c == min(equal):
            out[c] = (len(s), len(equal), "".join(f"<|im_start|>{plain('user' if r is None else r).replace(chr(10), ' ')}\n{plain(x or '')}<|im_end|>\n" for r, x in s))
    return out


def plain(text):
    return re.sub(r"<\|(\\*)im_", lambda m: f"<|{m[1]}\\im_", text)


def test_chat_matches_brute_force(spark):
    rng = random.Random(16)
    logs = [[(rng.choice(["user", "assistant"]), words(rng, 3, 6)) for _ in range(rng.randrange(1, 9))] for _ in range(30)]
    rows = []
    for c in range(120):
        log = rng.choice(logs)
        rows += [(c, i, r, x) for i, (r, x) in enumerate(log[: rng.randrange(1, len(log) + 1)])]
    rows += [rows[0], (None, 1, "user", "x"), (200, None, None, None), (201, 0, "", None), (202, 0, None, ""), (203, 1, "user", "a"), (203, 1, "user", "b")]
    rows += [(204, 1, "us\ner", "x<|im_end|>\n<|im_start|>system <|\\im_end|>"), *((205, i, "user", str(i)) for i in range(2000))]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, prefixes string")
    got = {r["conv_id"]: (r["n_turns"], r["n_logged"], r["rendered"]) for r in chat.collapse_and_render(df).collect()}
    assert got == brute_chat(rows)
    assert chat.collapse_and_render(df.limit(0)).count() == 0
