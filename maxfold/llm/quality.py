"""Quality classifier by co-training of a text-content view and a page-metadata view."""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, owned, release, small_arrow_batches
from .boosting import BoostedTrees, Isotonic, sigmoid

#: Labelled rows fitted on at most, in hash order.
LABELLED_ROWS = 12_000
#: Rounds of exchange; a view passes on all unlabelled rows that it calls with this calibrated confidence.
ROUNDS, CONFIDENCE = 2, 0.97
#: Weight of a class's pseudo-labelled rows together, beside its labelled ones.
PSEUDO_WEIGHT = 0.5
#: Parts of the labelled rows, each scored for the calibration by models that know only the others.
FOLDS = 3
#: Documents that score less are rejected.
THRESHOLD = 0.5
MODEL = {"trees": 50, "depth": 3, "rate": 0.15}
#: Bytes that are counted alone: ASCII punctuation and new lines.
MARKS = np.array([10, *(c for c in range(33, 127) if not chr(c).isalnum())])
LANGS, SOURCES = ("en", "fr", "de", "es"), 32


def text_features(text: str | None) -> list[float]:
    """What the text says of itself: its characters, repetition and word shapes."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    hist = np.bincount(raw, minlength=256) / n
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    marked = sum(c for w, c in counts.items() if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    return [
        *hist[MARKS].tolist(), float(hist[65:91].sum()), float(hist[48:58].sum()), float(hist[97:123].sum()), float(hist[32]), float(hist[128:].sum()),
        math.log1p(len(words)), len(counts) / k, pairs / k, max(counts.values(), default=0) / k, marked / k,
        sum(map(str.isupper, words)) / k, sum(map(len, words)) / k, math.log1p(max(map(len, counts), default=0)),
    ]


def page_features(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """What is known about the page: source, language, stated size, and the layout of its lines."""
    lines = (text or "").split("\n")
    lengths = [len(x) for x in lines]
    where = zlib.crc32(source.encode()) if source else 0
    return [
        math.log1p(max(0, n_chars or 0)), float(n_chars is None), math.log1p(len(lines)), math.log1p(max(lengths)), math.log1p(sum(lengths) / len(lines)),
        len(set(lines)) / len(lines), sum(x < 20 for x in lengths) / len(lines),
        *(float(lang == x) for x in LANGS), float(source is None), *(float(where % SOURCES == i) for i in range(SOURCES)),
    ]


VIEWS = (len(text_features("")), len(page_features("", None, None, None)))
#: Leaves of a view's trees, and numbers that one view's model of one fold gathers for each pseudo-label.
LEAVES = MODEL["trees"] * 2 ** MODEL["depth"]
GATHERED = 2 * LEAVES + 1


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class CoTrained:
    """Two views, each fitted on labels and on what the other was sure of, and their calibrated combination.

    ``models[m]`` has both views' trees; m = 0 knows all labels, m = i + 1 those outside fold i. The latter serve to
    calibrate: after each round the labelled rows are scored by the models that do not know their fold.
    """

    models: list[list[BoostedTrees]] = field(default_factory=list)
    calibrated: list[Isotonic] = field(default_factory=list)
    mix: np.ndarray = field(default_factory=lambda: np.zeros(3))
    prior: float = 1.0

    def fit(self, views: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> CoTrained:
        """Fit the trees of both views on the labels."""
        self.views, self.y, self.fold = views, y, fold
        self.prior = float(y.mean()) if len(y) else 1.0
        if not 10 <= y.sum() <= len(y) - 10:
            return self
        for m in range(FOLDS + 1):
            known = fold != m - 1
            self.models.append([BoostedTrees(**MODEL).fit(x[known], y[known]) for x in views])
        self.calibrate()
        return self

    def calibrate(self) -> None:
        """Isotonic maps of this round's views, and the logistic regression that combines them."""
        held = [np.zeros(len(self.y)) for _ in self.views]
        for i in range(FOLDS):
            mine = self.fold == i
            for v, x in enumerate(self.views):
                held[v][mine] = self.models[i + 1][v].score(x[mine])
        self.calibrated = [Isotonic(s, self.y) for s in held]
        z = np.stack([np.ones(len(self.y)), *(logit(c(s)) for c, s in zip(self.calibrated, held, strict=True))], 1)
        self.mix = np.zeros(3)
        for _ in range(30):  # Newton's method, lightly ridged
            p = sigmoid(z @ self.mix)
            h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(3)
            self.mix = self.mix - np.linalg.solve(h, z.T @ (p - self.y) + 1e-2 * self.mix)

    def light(self) -> CoTrained:
        """What scoring needs, without the labelled rows."""
        return CoTrained(self.models, self.calibrated, self.mix, self.prior)

    def leaves(self, views: list[np.ndarray]) -> np.ndarray:
        """(rows, models * views * trees): where rows end in the trees of all models."""
        return np.concatenate([t.leaf_ids(x) for pair in self.models for t, x in zip(pair, views, strict=True)], 1)

    def gather(self, leaves: np.ndarray) -> np.ndarray:
        """What unlabelled rows tell: for each model, view and pseudo-label the sums of gradients and hessians over the leaves, and the rows."""
        out = np.zeros((len(self.models), 2, 2, GATHERED))
        ids = leaves.reshape(len(leaves), len(self.models), 2, MODEL["trees"])
        for m, pair in enumerate(self.models):
            score = [t.at_leaves(ids[:, m, v]) for v, t in enumerate(pair)]
            for v, t in enumerate(pair):
                other = self.calibrated[1 - v](score[1 - v])
                for label, sure in ((0, 1 - other), (1, other)):
                    rows = np.flatnonzero(sure >= CONFIDENCE)
                    p = sigmoid(score[v][rows])
                    at = ids[rows, m, v]
                    out[m, v, label] = [*t.leaf_sums(at, p - label).ravel(), *t.leaf_sums(at, p * (1 - p)).ravel(), len(rows)]
        return out

    def exchange(self, told: np.ndarray) -> None:
        """A round: each view takes a step on the labels and on the rows that the other is sure of, then both are calibrated anew.

        Pseudo-labelled rows weigh PSEUDO_WEIGHT times as much as the labelled ones of their class, however many they are.
        """
        for m, pair in enumerate(self.models):
            known = self.fold != m - 1
            y = self.y[known]
            for v, t in enumerate(pair):
                at = t.leaf_ids(self.views[v][known])
                p = sigmoid(t.at_leaves(at))
                g, h = t.leaf_sums(at, p - y), t.leaf_sums(at, p * (1 - p))
                for label in (0, 1):
                    rows = told[m, v, label, -1]
                    if rows:
                        scale = PSEUDO_WEIGHT * (y == label).sum() / rows
                        g = g + scale * told[m, v, label, :LEAVES].reshape(g.shape)
                        h = h + scale * told[m, v, label, LEAVES : 2 * LEAVES].reshape(g.shape)
                t.step(g, h)
        self.calibrate()

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, page view, combined): calibrated probabilities of good quality."""
        if not self.models:
            flat = np.full(len(views[0]), self.prior)
            return flat, flat, flat
        p = [c(m.score(x)) for c, m, x in zip(self.calibrated, self.models[0], views, strict=True)]
        z = np.stack([np.ones(len(p[0])), *map(logit, p)], 1)
        return p[0], p[1], sigmoid(z @ self.mix)


def _features(batch: pa.RecordBatch, at: dict[str, int]) -> list[np.ndarray]:
    texts = batch.column(at["text"]).to_pylist()
    rest = [batch.column(at[c]).to_pylist() for c in ("source", "lang", "n_chars")]
    return [np.array([text_features(t) for t in texts]).reshape(-1, VIEWS[0]), np.array([page_features(*r) for r in zip(texts, *rest, strict=True)]).reshape(-1, VIEWS[1])]


INPUT = ("text", "source", "lang", "n_chars")


def train(docs: DataFrame, labels: DataFrame, *, labelled_rows: int = LABELLED_ROWS) -> CoTrained:
    """Fit both views on a bounded sample of labelled documents, then exchange pseudo-labels of all unlabelled ones.

    Unlabelled documents are passed over once; what stays of each is the leaves in which it ends (FOLDS + 1 models, two
    views), from which every round sums gradients. Only these sums, whose number is fixed, come to the driver.
    """
    with owned() as mine:
        model = _train(docs, labels, labelled_rows)
        release(mine)
    return model.light()


def _train(docs: DataFrame, labels: DataFrame, labelled_rows: int) -> CoTrained:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("y"))
    picked = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    picked = materialize(picked, "quality-sample")
    at = {c: i for i, c in enumerate(INPUT)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, p = _features(batch, at)
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array(list(t), pa.list_(pa.float64())), pa.array(list(p), pa.list_(pa.float64()))], names=["y", "fold", "t", "p"])

    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")  # copies of a text are in one fold
    rows = docs.select("doc_id", *INPUT).join(F.broadcast(picked), "doc_id").select(*INPUT, "y", fold.alias("fold"))  # labelled_rows ids
    got = rows.mapInArrow(run, "y int, fold int, t array<double>, p array<double>").toPandas()
    y, folds = got["y"].to_numpy(float), got["fold"].to_numpy(int)
    views = [np.array(got[c].tolist()).reshape(-1, n) for c, n in zip("tp", VIEWS, strict=True)]
    order = np.lexsort([*views[0].T, *views[1].T, folds, y])
    model = CoTrained().fit([v[order] for v in views], y[order], folds[order])
    if not model.models:
        return model

    trees = model.light()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = trees.leaves(_features(batch, at))
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array([r.tobytes() for r in ends], pa.binary())], names=["doc_id", "leaves"])

    pool = docs.select(*INPUT, "doc_id").mapInArrow(walk, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaves binary")
    # rows without an id have no label; they are not joined, as they may be many
    pool = pool.where("doc_id is not null").join(known.select("doc_id"), "doc_id", "left_anti").unionByName(pool.where("doc_id is null"))
    pool = materialize(pool.select("leaves"), "quality-pool")

    def gather(batches: Iterator[pa.RecordBatch], trees: CoTrained) -> Iterator[pa.RecordBatch]:
        told = np.zeros((len(trees.models), 2, 2, GATHERED))
        for batch in batches:
            if batch.num_rows:
                told += trees.gather(np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(0)]))
        at = np.flatnonzero(told.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(told.ravel()[at])], names=["at", "told"])

    for _ in range(ROUNDS):
        sums = pool.mapInArrow(functools.partial(gather, trees=model.light()), "at int, told double").groupBy("at").agg(F.sum("told").alias("told")).collect()
        told = np.zeros(len(model.models) * 4 * GATHERED)
        for r in sums:
            told[r["at"]] = r["told"]
        model.exchange(told.reshape(-1, 2, 2, GATHERED))
    return model


def with_quality(docs: DataFrame, labels: DataFrame, column: str, **sizes: int) -> DataFrame:
    """``docs`` with one more column, struct<text_score, page_score, score>: probabilities that a document is good.

    Two classifiers see different views, the text's content and the page's metadata (source, language, stated size,
    line layout). Each is fitted on labels; in rounds, each labels the unlabelled rows that it is sure of for the other,
    all of them, and both take a step on what they are told. After every round both are calibrated on the scores of
    models that do not know the row's label, and combined by a logistic regression of their logits, so a view that tells
    little counts little. All whole documents are scored in a last narrow pass.

    The labelled rows that the trees are fitted on are bounded by ``labelled_rows``. Labels without an id
    or a quality take no part; conflicting ones count as good. Nulls in any column are features of their own or read
    as empty; repeated rows each get their result. With no usable labels, or one class of them, every score is their
    mean (1 without any). All columns of ``docs`` pass through; documents without lang, source or n_chars columns are
    not accepted.
    """
    if column in docs.columns:
        raise ValueError(f"the documents already have a column {column}")
    small_arrow_batches(docs.sparkSession)
    model = train(docs, labels, **sizes)
    at = {c: docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")}
    kind = pa.struct([("text_score", pa.float64()), ("page_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [pa.array(np.asarray(p, float)) for p in model.score(_features(batch, at))]
            yield batch.append_column(column, pa.StructArray.from_arrays(scores, fields=list(kind)))

    out = docs.withColumn(column, F.lit(None).cast("struct<text_score:double,page_score:double,score:double>"))
    return docs.mapInArrow(run, out.schema)


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **sizes: int) -> DataFrame:
    """(doc_id, text_score, page_score, score, keep) for every document, by with_quality()."""
    scored = with_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels, "_q", **sizes)
    return scored.select("doc_id", "_q.text_score", "_q.page_score", "_q.score", F.when(F.col("_q.score") >= threshold, 1).otherwise(0).alias("keep"))
