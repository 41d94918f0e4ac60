"""Toxicity scores: boosted trees over dense text features, isotonically calibrated."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small_arrow_batches
from .boosting import BoostedTrees, Isotonic

#: Labelled rows that the model is fitted on at most, in hash order.
TRAIN_ROWS = 20_000
#: A lexicon term occurs in this many toxic training documents and has this log-odds ratio at least.
MIN_TOXIC, MIN_ODDS, STRONG_ODDS = 8, 1.5, 3.0
THRESHOLD = 0.7
#: Parts of the training rows whose scores, for the calibration, come from models learnt on the other parts.
FOLDS = 3
PREFIXES = range(3, 9)
WORD = re.compile(r"[\w@$*]+")
#: Words that address the reader, in the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes tú ti tus vosotros su sus".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans("0134578@$", "oleastbas")
MODEL = {"trees": 60, "depth": 4, "rate": 0.12}


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings."""
    return [word, *(f"{word[:n]}^" for n in PREFIXES if n < len(word))]


#: What a character is: 1 a capital, 2 another letter, digit or underscore, 3 white space, 0 a mark; by code point.
_kinds: list[np.ndarray] = []


def kinds_of(text: str) -> np.ndarray:
    """The kind of each character of ``text``, whatever its length or script."""
    if not _kinds:
        every = [chr(i) for i in range(sys.maxunicode + 1)]
        _kinds.append(np.array([1 if c.isupper() else 2 if c.isalnum() or c == "_" else 3 if c.isspace() else 0 for c in every], np.uint8))
    return _kinds[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def shouted_words(kinds: np.ndarray) -> int:
    """Runs of three capitals or more that no other letter, digit or underscore touches."""
    k = np.concatenate([[0], kinds, [0]])
    up = np.flatnonzero(np.diff(np.concatenate([[False], k == 1, [False]]).astype(np.int8)))
    begin, end = up[::2], up[1::2]
    return int(((end - begin >= 3) & (k[begin - 1] != 2) & (k[np.minimum(end, len(k) - 1)] != 2)).sum())


class Features:
    """Dense features of a text, given a lexicon (term -> log-odds)."""

    SIZE = 22

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo = lexicon, {}

    def odds(self, word: str) -> tuple[float, bool]:
        """The word's highest log-odds, and whether it is obfuscated."""
        plain = word.translate(LEET).replace("*", "")
        hidden = not word.isalpha() and not word.isdigit() and any(c.isalpha() for c in word) and "_" not in word
        own = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)
        if hidden and plain:
            own = max(own, max(self.lexicon.get(t, 0.0) for t in terms_of(plain)))
        return own, hidden

    def of(self, text: str | None) -> list[float]:
        return self.given(Shape(text))

    def given(self, shape: Shape) -> list[float]:
        words, counts, n, chars = shape.words, shape.counts, shape.n, shape.chars
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        weak = strong = total = hidden_n = hidden_hits = 0.0
        top, distinct = 0.0, 0
        hits = set()
        for w, c in counts.items():
            if w not in memo:
                memo[w] = self.odds(w)
            o, hidden = memo[w]
            if o > 0:
                weak += c
                total += o * c
                top = max(top, o)
                distinct += 1
                if o >= STRONG_ODDS:
                    strong += c
                    hits.add(w)
            if hidden:
                hidden_n += c
                hidden_hits += c * (o > 0)
        near = 0
        if hits and shape.you:
            last_you = last_hit = -99
            for i, w in enumerate(words):
                if w in hits:
                    near += i - last_you <= 5
                    last_hit = i
                elif w in SECOND_PERSON:
                    near += i - last_hit <= 5
                    last_you = i
        return [
            math.log1p(n), weak / n, strong / n, math.log1p(weak), math.log1p(strong), distinct, len(hits), top, total / n,
            near, near / n, shape.you / n, shape.upper / chars, shape.shouted / n, shape.marks / chars, shape.exclaimed / chars, shape.asked / chars,
            hidden_n / n, hidden_hits, shape.letters / n, len(counts) / n, max(counts.values(), default=0) / n,
        ]


class Shape:
    """What a text tells without a lexicon."""

    def __init__(self, text: str | None):
        text = text or ""
        self.words = WORD.findall(text.lower())
        self.counts = Counter(self.words)
        self.n, self.chars = max(1, len(self.words)), max(1, len(text))
        kinds = kinds_of(text)
        self.upper, self.marks, self.shouted = int((kinds == 1).sum()), int((kinds == 0).sum()), shouted_words(kinds)
        self.exclaimed, self.asked = text.count("!"), text.count("?")
        self.you = sum(c for w, c in self.counts.items() if w in SECOND_PERSON)
        self.letters = sum(map(len, self.words))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        yield batch, batch.column(column).to_pylist()


def learn_lexicons(train: DataFrame, *, min_toxic: int = MIN_TOXIC) -> list[dict[str, float]]:
    """Terms of toxic training texts (text, toxic, fold) and their smoothed log-odds ratio, from document frequencies.

    One lexicon of all rows, and then one for each fold, from the rows of the others. Their size is bounded by the texts
    of the training rows only.
    """

    def present(only: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in _text_batches(batches, 0):
                counts: dict[tuple[int, int], Counter] = {}
                for t, y, f in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    terms = {x for w in set(WORD.findall((t or "").lower())) for x in terms_of(w)}
                    counts.setdefault((y, f), Counter()).update(terms if only is None else terms & only)
                every = [(x, y, f, c) for (y, f), found in counts.items() for x, c in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*every, strict=True) if every else ([],) * 4, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["term", "toxic", "fold", "n"])

        return run

    schema = "term string, toxic int, fold int, n long"
    rows = np.zeros((2, FOLDS))
    for r in train.groupBy("toxic", "fold").count().collect():
        rows[r["toxic"], r["fold"]] = r["count"]
    texts = train.select("text", "toxic", "fold")
    first = texts.where("toxic = 1").mapInArrow(present(None), schema).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_toxic)
    wanted = frozenset(r["term"] for r in first.select("term").collect())  # words of train_rows texts
    out: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    if not wanted:
        return out
    per = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)) for y in (0, 1) for f in range(FOLDS)]
    for r in texts.mapInArrow(present(wanted), schema).groupBy("term").agg(F.array(*per).alias("n")).collect():
        n = np.array(r["n"], float).reshape(2, FOLDS)
        for i, lexicon in enumerate(out):
            held = np.arange(FOLDS) != i - 1
            (neg, pos), (all_neg, all_pos) = (n * held).sum(1), (rows * held).sum(1)
            o = math.log((pos + 0.5) / (all_pos - pos + 0.5)) - math.log((neg + 0.5) / (all_neg - neg + 0.5))
            if pos >= min_toxic and o >= MIN_ODDS:
                lexicon[r["term"]] = o
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): a calibrated probability of the label toxic for every whole text.

    Features: densities and counts of lexicon words (whole, by beginning, or obfuscated), the lexicon being learnt
    from training labels; lexicon words near second-person words; capitals, punctuation and obfuscation rates; length
    and repetition. Boosted trees are fitted on at most ``train_rows`` labelled texts in hash order, none of them
    held out (crc32 of the id as text, mod 3 equal to 1). They are calibrated on the scores of FOLDS other models, each
    of which, lexicon and trees, was learnt without the labels of the rows that it scores.

    Null labels and null ids in ``labels`` take no part; conflicting labels of an id count as toxic. A null or empty
    text has the features of no words and gets the score of such. Repeated rows each get their result. With no usable
    labels, or one class of them, every score is their mean (0 without any). Other columns are ignored.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")  # copies of a text are in one fold
    train = materialize(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", fold.alias("fold")), "toxic-train")  # train_rows ids at most
    lexicons = learn_lexicons(train)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [Features(x) for x in lexicons]
        for batch, texts in _text_batches(batches, 0):
            shapes = map(Shape, texts)
            x = [[v for f in every for v in f.given(s)] for s in shapes]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    rows = train.mapInArrow(featurise, "toxic int, fold int, x array<double>").collect()  # train_rows short vectors
    x, y, fold = np.array([r["x"] for r in rows]).reshape(-1, FOLDS + 1, Features.SIZE), np.array([r["toxic"] for r in rows], float), np.array([r["fold"] for r in rows], int)
    order = np.lexsort([*x.reshape(len(x), (FOLDS + 1) * Features.SIZE).T, fold, y])
    x, y, fold = x[order], y[order], fold[order]
    model = calibrate = None
    if 10 <= y.sum() <= len(y) - 10:
        unseen = np.zeros(len(y))
        for i in range(FOLDS):
            if (fold == i).any():
                unseen[fold == i] = BoostedTrees(**MODEL).fit(x[fold != i, i + 1], y[fold != i]).score(x[fold == i, i + 1])
        calibrate = Isotonic(unseen, y)
        model = BoostedTrees(**MODEL).fit(x[:, 0], y)
    prior = float(y.mean()) if len(y) else 0.0
    lexicon = lexicons[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(lexicon)
        for batch, texts in _text_batches(batches, 1):
            p = np.full(len(texts), prior)
            if model is not None and len(texts):
                p = calibrate(model.score(np.array([f.of(t) for t in texts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(p, 0, 1))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
