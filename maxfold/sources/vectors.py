"""Readers and writers of vector and text files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, *, skip: int = 0, take: int | None = None) -> DataFrame:
    """(doc_id, text) of lines ``id TAB text``; a line without a tab or a numeric id raises. skip/take count lines by id order."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t", 2)
    text = F.when(F.size(parts) == 2, parts[1]).otherwise(F.raise_error(F.concat(F.lit("no tab in line: "), F.substring("value", 1, 80))))
    df = lines.select(parts[0].cast("long").alias("doc_id"), text.alias("text"))
    if skip or take is not None:
        df = df.orderBy("doc_id").offset(skip)
        df = df if take is None else df.limit(take)
    return df


def read_vecs(spark: SparkSession, path: str, *, kind: str) -> DataFrame:
    """(file, id, v) of bvecs (kind 'b': bytes) or ivecs (kind 'i': 32-bit integers): each vector after its u32 dimension.

    Reading stops at a truncated record. A file is read whole by one task: keep shards to some hundred MB.
    """
    dtype = {"b": "<u1", "i": "<i4"}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                at, rows, width = 0, [], np.dtype(dtype).itemsize
                while at + 4 <= len(raw):
                    (dim,) = struct.unpack_from("<I", raw, at)
                    end = at + 4 + dim * width
                    if end > len(raw):
                        break
                    rows.append(np.frombuffer(raw, dtype, dim, at + 4).astype(float))
                    at = end
                    if len(rows) == 4096:
                        yield pd.DataFrame({"file": name, "n": 1, "v": rows})
                        rows = []
                if rows:
                    yield pd.DataFrame({"file": name, "n": 1, "v": rows})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in run(batches):
            name = b["file"].iloc[0]
            first = seen.get(name, 0)
            seen[name] = first + len(b)
            yield pd.DataFrame({"file": b["file"], "id": range(first, first + len(b)), "v": b["v"]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(numbered, "file string, id long, v array<double>")


def read_packed(spark: SparkSession, folder: str, dim: int = 128) -> DataFrame:
    """(doc_id, pos, e) of a packed token store: offsets.bin u64[N], lengths.bin u32[N], data.bin f32[sum * dim].

    doc_id is the position in the index; offsets count vectors. The three files are read by one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = {name.rsplit("/", 1)[-1]: raw for b in batches for name, raw in zip(b["path"], b["content"], strict=True)}
        if not files:
            return
        offsets, lengths = np.frombuffer(files["offsets.bin"], "<u8").astype(np.int64), np.frombuffer(files["lengths.bin"], "<u4").astype(np.int64)
        data = np.frombuffer(files["data.bin"], "<f4").reshape(-1, dim)
        for i in range(0, len(offsets), 1024):
            ids = np.repeat(np.arange(i, min(i + 1024, len(offsets))), lengths[i : i + 1024])
            pos = np.concatenate([np.arange(n) for n in lengths[i : i + 1024]]) if len(ids) else np.zeros(0, int)
            yield pd.DataFrame({"doc_id": ids, "pos": pos, "e": list(data[offsets[ids] + pos].astype(float))})

    files = spark.read.format("binaryFile").load(f"{folder}/*.bin").select("path", "content").coalesce(1)
    return files.mapInPandas(run, "doc_id long, pos long, e array<double>")


def read_vector_cache(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, v) of a JSON object id -> vector."""
    raw = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string,array<double>>")
    return raw.select(F.explode(m).alias("k", "v")).select(F.col("k").cast("long").alias("doc_id"), "v")


def read_matrix_cache(spark: SparkSession, path: str, dim: int = 128) -> DataFrame:
    """(text, tokens, rows) of a JSON object text -> {tokens, rows}; an entry with a row of another dimension is dropped."""
    raw = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string,struct<tokens:array<string>,rows:array<array<double>>>>")
    d = raw.select(F.explode(m).alias("text", "x")).select("text", "x.tokens", "x.rows")
    return d.where(F.forall("rows", lambda r: F.size(r) == dim))


def read_label_cache(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id) of a JSON object query -> [doc_id]."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("query", "ids")).select("query", F.explode("ids").alias("doc_id"))


def judged_ids(answer: Column) -> Column:
    """The ids in a judge's answer: a JSON array, perhaps within code fences."""
    return F.from_json(F.trim(F.regexp_replace(answer, r"```(?:json)?", "")), "array<bigint>")


def missing(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows still to embed: the resume step of an embedding job."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def append_index(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """Append to a Parquet index table; a job's rows appear together or not at all."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_meta(spark: SparkSession, path: str, count: int, dim: int, model: str) -> None:
    """The JSON sidecar of an index."""
    spark.createDataFrame([(count, dim, model)], "count long, dim int, model string").coalesce(1).write.mode("overwrite").json(path)


def pool_tokens(tok: DataFrame, factor: int) -> DataFrame:
    """Means of ``factor`` adjacent token vectors, normalised."""
    from ..functions.vectors import mean_by

    d = tok.select("doc_id", F.floor(F.col("pos") / factor).cast("long").alias("pos"), "e")
    return mean_by(d, ["doc_id", "pos"], "e", "e")


def embed(df: DataFrame, embedder, schema: str) -> DataFrame:
    """Run an embedding model over Arrow batches: ``embedder(batches of pandas) -> batches of pandas``."""
    return df.mapInPandas(embedder, schema)


def synthetic_tokens(spark: SparkSession, n_docs: int, per_doc: int = 8, dim: int = 128, seed: int = 42) -> DataFrame:
    """(doc_id, pos, vec_id, e): seeded unit vectors."""
    from ..functions.vectors import hash_vector

    d = spark.range(n_docs * per_doc).select((F.col("id") / per_doc).cast("long").alias("doc_id"), (F.col("id") % per_doc).alias("pos"), F.col("id").alias("vec_id"))
    return d.withColumn("e", hash_vector(F.concat_ws("#", F.lit(str(seed)), F.col("vec_id").cast("string")), dim))
