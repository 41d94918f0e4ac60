"""Writers of vector files, caches, reports and charts, and what an embedding job needs around a model."""

from __future__ import annotations

import json
import re
import subprocess
import time
from collections.abc import Callable, Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import matrix
from .vectors import missing


def _store(uri: str):
    """(file system, path) of a shared folder that Python workers can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", uri) if uri.startswith("file:") else f"file://{uri}" if uri.startswith("/") else uri)


def pack(v: np.ndarray) -> bytes:
    """32-bit floats, little endian."""
    return np.asarray(v, "<f4").tobytes()


def write_packed(tok: DataFrame, folder: str) -> DataFrame:
    """A packed token store in shards, one a task: ids.bin and offsets.bin u64[N], lengths.bin u32[N], data.bin f32[sum * dim].

    A shard holds a range of doc_ids, each whole. Data is written before the index files, so a shard with lengths is
    complete, and a task that is run again writes the same files. Returns (shard, docs, vectors).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = _store(folder)
        shard = f"shard-{TaskContext.get().partitionId():05d}"
        ids: list[int] = []
        lengths: list[int] = []
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(f"{path}/{shard}", recursive=True)
                out = store.open_output_stream(f"{path}/{shard}/data.bin")
            out.write(pack(matrix(b.column(1))))
            for d in b.column(0).to_pylist():
                if ids and ids[-1] == d:
                    lengths[-1] += 1
                else:
                    ids.append(d)
                    lengths.append(1)
        if out is not None:
            out.close()
            n = np.array(lengths, np.int64)
            for name, x in (("ids", np.array(ids, "<u8")), ("offsets", (np.cumsum(n) - n).astype("<u8")), ("lengths", n.astype("<u4"))):
                with store.open_output_stream(f"{path}/{shard}/{name}.bin") as f:
                    f.write(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(ids)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "docs", "vectors"])

    ordered = tok.select("doc_id", "pos", "e").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "pos").select("doc_id", "e")
    rows = ordered.mapInArrow(run, "shard string, docs long, vectors long").collect()  # a row a shard
    return tok.sparkSession.createDataFrame(rows, "shard string, docs long, vectors long")


def read_packed_shards(spark: SparkSession, folder: str, dim: int = 128, block: int = 1024) -> DataFrame:
    """(doc_id, pos, e) of a store written by write_packed(): a task reads a block of documents of a shard by byte ranges."""
    index = spark.read.format("binaryFile").option("pathGlobFilter", "lengths.bin").option("recursiveFileLookup", "true").load(folder)
    blocks = index.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") / 4 - 1) / block))).alias("block")).repartition("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, path = _store(name.rsplit("/", 1)[0])

                def part(file: str, kind: str, at: int, n: int) -> np.ndarray:
                    with store.open_input_file(f"{path}/{file}.bin") as f:
                        width = np.dtype(kind).itemsize
                        return np.frombuffer(f.read_at(n * width, at * width), kind)

                ids, offsets, lengths = (part(*x, i * block, block).astype(np.int64) for x in (("ids", "<u8"), ("offsets", "<u8"), ("lengths", "<u4")))
                data = part("data", "<f4", int(offsets[0]) * dim, int(lengths.sum()) * dim).astype(np.float64)
                pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                e = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1) * dim, pa.int32()), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, lengths)), pa.array(pos), e], names=["doc_id", "pos", "e"])

    return blocks.mapInArrow(run, "doc_id long, pos long, e array<double>")


def passages_done(spark: SparkSession, folder: str) -> int:
    """Documents in the complete shards of a packed store: what an interrupted job need not do again."""
    index = spark.read.format("binaryFile").option("pathGlobFilter", "lengths.bin").option("recursiveFileLookup", "true").load(folder)
    return int(index.agg(F.sum("length")).first()[0] or 0) // 4


def write_vecs(df: DataFrame, folder: str, *, kind: str) -> None:
    """(vec_id, v) as bvecs ('b') or ivecs ('i') files, one a task, and beside them which id is where (vec_ids)."""
    dtype = {"b": "<u1", "i": "<i4"}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = _store(folder)
        name, n, out = f"part-{TaskContext.get().partitionId():05d}.{kind}vecs", 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}")
            for x in b.column(1):
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), dtype)
                out.write(np.array([len(v)], "<u4").tobytes() + v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(np.arange(n, n + b.num_rows)), b.column(0)], names=["file", "id", "vec_id"])
            n += b.num_rows
        if out is not None:
            out.close()

    df.select("vec_id", "v").mapInArrow(run, "file string, id long, vec_id long").write.parquet(f"{folder}-ids")


def vec_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(file, id, vec_id): the id of each vector of write_vecs(), by file name and place."""
    return spark.read.parquet(f"{folder}-ids")


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Names that the folder lacks; a dataset is present where this is empty."""
    fs = spark._jvm.org.apache.hadoop.fs
    path = fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in names if not system.exists(fs.Path(path, n))]


def _one_object(df: DataFrame, key: str, value, path: str) -> None:
    """A JSON object, key -> value, as one text row: for caches that fit one."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))
    df.agg(F.to_json(entries).alias("value")).write.text(path)


def write_vector_cache(df: DataFrame, path: str) -> None:
    """(doc_id, v) as read_vector_cache() reads it."""
    _one_object(df, "doc_id", F.col("v"), path)


def write_matrix_cache(df: DataFrame, path: str) -> None:
    """(text, tokens, rows) as read_matrix_cache() reads it."""
    _one_object(df, "text", F.struct("tokens", "rows"), path)


def write_label_cache(df: DataFrame, path: str) -> None:
    """(query, doc_id) as read_label_cache() reads it."""
    _one_object(df.groupBy("query").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")), "query", F.col("ids"), path)


def fill_missing(docs: DataFrame, cache: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache and, embedded, what it lacks of ``docs``; both have ``key``, and ``embed`` returns the cache's columns."""
    return cache.unionByName(embed(missing(docs, cache, key)))


def embedding_job(texts: DataFrame, send: Callable[[list[str]], list[list[float]]], *, key: str = "doc_id", batch: int = 32, tries: int = 8, wait: float = 0.5, longest: float = 30.0, workers: int | None = None) -> DataFrame:
    """(key, v): a remote model called in batches by every task, at most ``workers`` at a time.

    A call that raises is tried again after a wait that doubles up to ``longest``; after ``tries`` the task fails and Spark
    runs it again. To resume, write the result by parts and pass what missing() leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = b.column(0), b.column(1).to_pylist()
            out: list[list[float]] = []
            for i in range(0, len(rows), batch):
                pause = wait
                for attempt in range(tries):
                    try:
                        out += send([t or "" for t in rows[i : i + batch]])
                        break
                    except Exception:
                        if attempt + 1 == tries:
                            raise
                        time.sleep(pause)
                        pause = min(2 * pause, longest)
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.list_(pa.float64()))], names=[key, "v"])

    d = texts.select(key, "text")
    d = d if workers is None else d.repartition(workers)
    return d.mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, v array<double>")


def vector_search_request(index: str, path: str, vector: list[float], k: int, candidates: int = 10_000) -> list[dict]:
    """The stages that ask a remote vector store for a query's nearest documents."""
    search = {"index": index, "path": path, "queryVector": vector, "numCandidates": candidates, "limit": k}
    return [{"$vectorSearch": search}, {"$project": {"_id": 0, "doc_id": 1, "score": {"$meta": "vectorSearchScore"}}}]


def remote_search(queries: DataFrame, send: Callable[[list[dict]], list[dict]], *, index: str = "vectors", path: str = "embedding", k: int = 10) -> DataFrame:
    """(qid, rank, doc_id, score) by a store that ``send`` reaches; queries (qid, qv)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(qid, i + 1, int(r["doc_id"]), float(r["score"])) for qid, qv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, r in enumerate(send(vector_search_request(index, path, qv, k)))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["qid", "rank", "doc_id", "score"])

    return queries.select("qid", "qv").mapInArrow(run, "qid long, rank int, doc_id long, score double")


def process_search(command: list[str], timeout: float = 600.0) -> list[dict]:
    """Run an external engine; the JSON objects among its output lines."""
    done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=True)
    out = []
    for line in done.stdout.splitlines():
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict):
            out.append(row)
    return out


def judge_prompt(query: str, docs: list[tuple[int, str]]) -> str:
    """What a judging model is asked: the ids of the relevant documents as a JSON array (read by judged_ids)."""
    listed = "\n".join(f"{i}: {t}" for i, t in docs)
    return f"Query: {query}\n\nDocuments:\n{listed}\n\nAnswer with a JSON array of the ids of all documents that are relevant to the query, and nothing else."


def write_json(value, path: str) -> None:
    """A report, indented, to a file of the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, default=str)


def compare_report(query: str, results: DataFrame) -> dict:
    """{query, results: engine -> [[doc_id, score], ...]} of a comparison (engine, rank, doc_id, score)."""
    out: dict[str, list] = {}
    for r in results.orderBy("engine", "rank").collect():  # k rows an engine
        out.setdefault(r["engine"], []).append([r["doc_id"], r["score"]])
    return {"query": query, "results": out}


def write_trace(trace: DataFrame, path: str) -> None:
    """A trace table (seq, ts_ms, stage, payload) as JSON lines, in order, in one file of a folder."""
    trace.orderBy("seq").coalesce(1).select("ts_ms", "stage", "payload").write.mode("overwrite").json(path)


def svg_chart(points: DataFrame, *, x: str = "frac", y: str = "recall", series: str = "engine", title: str = "", size: tuple[int, int] = (720, 420), log_x: bool = True) -> str:
    """A line chart of a point table, a line a series; x on a logarithmic axis where it is a share."""
    rows = points.select(series, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(series, x).collect()  # sweep points
    at = (lambda v: np.log10(max(v, 1e-3)) / 3 + 1) if log_x else float
    w, h, left, low = *size, 56, 36
    place = lambda r: (left + at(r[x]) * (w - left - 150), h - low - r[y] * (h - low - 40))
    names = list(dict.fromkeys(r[series] for r in rows))
    inks = ("#b24a3b", "#2f6f9f", "#3d8a57", "#8a5aa8", "#c08a1e", "#4a4a4a", "#1f8a8a", "#a0527a")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="12">', f'<text x="{left}" y="20" font-size="14">{escape(title)}</text>']
    for v in (0.0, 0.25, 0.5, 0.75, 1.0):
        yy = h - low - v * (h - low - 40)
        out.append(f'<line x1="{left}" x2="{w - 150}" y1="{yy:.1f}" y2="{yy:.1f}" stroke="#ddd"/><text x="{left - 8}" y="{yy + 4:.1f}" text-anchor="end">{v:g}</text>')
    for v in (0.001, 0.01, 0.1, 1.0) if log_x else (0.0, 0.5, 1.0):
        out.append(f'<text x="{left + at(v) * (w - left - 150):.1f}" y="{h - 14}" text-anchor="middle">{v:g}</text>')
    for i, name in enumerate(names):
        line = " ".join(f"{a:.1f},{b:.1f}" for a, b in (place(r) for r in rows if r[series] == name))
        out.append(f'<polyline points="{line}" fill="none" stroke="{inks[i % len(inks)]}" stroke-width="2"/><text x="{w - 140}" y="{48 + 18 * i}" fill="{inks[i % len(inks)]}">{escape(str(name))}</text>')
    return "\n".join([*out, "</svg>"])


def result_points(results: DataFrame) -> dict[str, DataFrame]:
    """The four point tables of a bench result (engine, dataset, recall_at_1/10/100, p50/p95/p99_ms, qps)."""
    stack = lambda names, key: results.select("engine", "dataset", F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(c).alias("value")) for n, c in names])).alias("p")).select("engine", "dataset", f"p.{key}", "p.value")
    return {
        "pareto": results.select("engine", "dataset", "recall_at_10", "qps"),
        "recall": stack([(k, f"recall_at_{k}") for k in (1, 10, 100)], "k"),
        "latency": stack([(0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")], "p"),
        "throughput": results.select("engine", "dataset", "qps", F.dense_rank().over(Window.orderBy(F.desc("qps"))).alias("place")),
    }
