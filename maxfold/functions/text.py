"""Tokens, frequencies and weights of texts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: A type is Tail under the first count, Heavy from the second on, Normal between.
TAIL, HEAVY = 128, 256
#: Characters that WordPiece encodes at a time: an encoding takes some 100 bytes a piece.
ENCODED = 1 << 18
#: Pieces of known words that a worker keeps, about.
KNOWN = 1 << 21


def words(text: Column) -> Column:
    """Runs of letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, token): one row per word."""
    return docs.select(key, F.posexplode(words(F.col(text))).alias("pos", "token"))


def token_frequency(tok: DataFrame, token: str = "token") -> DataFrame:
    return tok.groupBy(token).agg(F.count("*").alias("n"))


def document_frequency(tok: DataFrame, key: str = "doc_id", token: str = "token") -> DataFrame:
    return tok.select(key, token).distinct().groupBy(token).agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    """ln(N / (1 + df)) + 1, with N at least 1; an unseen token has df 0."""
    return F.log(F.greatest(n_docs, F.lit(1)) / (F.lit(1.0) + F.coalesce(df, F.lit(0)))) + 1.0


def query_weights(query_tokens: DataFrame, df: DataFrame, n_docs: int, token: str = "token") -> DataFrame:
    """Query tokens with their idf as ``w``."""
    return query_tokens.join(df, token, "left").withColumn("w", idf(F.lit(n_docs), F.col("df"))).drop("df")


def tail_class(n: Column, tail: int = TAIL, heavy: int = HEAVY) -> Column:
    return F.when(n >= heavy, "Heavy").when(n >= tail, "Normal").otherwise("Tail")


def snippet(text: Column, n: int = 60) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def align_ids(ids: Column, n: int) -> Column:
    """Cut or zero-padded to n entries."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), n)), 1, n)


def resolve_tokens(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``token`` by token_id, the id itself where the vocabulary lacks it."""
    v = vocabulary.select("token_id", F.col("token").alias("_t"))
    return df.join(v, "token_id", "left").withColumn("token", F.coalesce("_t", F.col("token_id").cast("string"))).drop("_t")


def portions(text: str, most: int) -> Iterator[str]:
    """``text`` in parts of ``most`` characters about, each of which ends after a space or line break, so that no word is cut."""
    at, n = 0, len(text)
    while n - at > most:
        end = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most)) + 1
        if not end:
            after = [x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0]
            end = min(after) + 1 if after else n
        yield text[at:end]
        at = end
    if at < n:
        yield text[at:]


def wordpiece(docs: DataFrame, vocabulary: str | list[str], key: str = "doc_id", text: str = "text", most: int = ENCODED) -> DataFrame:
    """(key, pos, token, token_id) by WordPiece over a vocabulary (a file of one piece a line, or the pieces): normalised, greedy, no special tokens.

    ``most`` characters about are encoded at a time and passed on as one Arrow batch, however many or long the texts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads for short words cost thrice the time
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        if isinstance(vocabulary, str):
            with open(vocabulary, encoding="utf-8") as lines:
                pieces = [line.rstrip("\n") for line in lines]
        else:
            pieces = list(vocabulary)
        t = Tokenizer(models.WordPiece({piece: i for i, piece in enumerate(pieces)}, unk_token="[UNK]"))
        t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
        names, first = pa.array(pieces, pa.string()), 0  # first: the pos of the next piece of the text at hand
        known: dict[str, int] = {}  # what stood between spaces or line breaks: pieces do not depend on what is beyond these
        table, ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

        def encoded(group: list[tuple[int, bool, str]], keys: pa.Array) -> pa.RecordBatch:
            nonlocal first, table, ends
            split = [part.replace("\n", " ").split(" ") for _, _, part in group]
            if len(table) > KNOWN:
                known.clear()
                table, ends = table[:0], ends[:1]
            if new := [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in known]:
                ids = [e.ids for e in t.encode_batch_fast(new, add_special_tokens=False)]
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                ends = np.append(ends, ends[-1] + np.cumsum([len(x) for x in ids]))
                table = np.append(table, np.fromiter(chain.from_iterable(ids), np.int64))
            at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
            n = ends[at + 1] - ends[at]
            flat = pa.array(table[np.repeat(ends[at] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            each, firsts = np.add.reduceat(n, np.cumsum([0, *map(len, split[:-1])])), []  # pieces of each part
            for (_, begins, _), x in zip(group, each.tolist(), strict=True):
                first = 0 if begins else first
                firsts.append(first)
                first += x
            pos = np.arange(len(flat)) + np.repeat(np.array(firsts) - np.cumsum(each) + each, each)
            of = np.repeat([i for i, _, _ in group], each)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(pos.astype(np.int32)), names.take(flat), flat], names=[key, "pos", "token", "token_id"])

        for b in batches:
            group, size = [], 0
            for i, whole in enumerate(b.column(1)):
                for j, part in enumerate(portions(whole.as_py() or "", most)):
                    if group and size + len(part) > most:
                        yield encoded(group, b.column(0))
                        group, size = [], 0
                    group.append((i, j == 0, part))
                    size += len(part)
            if group:
                yield encoded(group, b.column(0))

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, pos int, token string, token_id long")
