"""Token counts by separator scan over flat, unindexed token files."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import fresh_path, materialize, small_arrow_batches

EOD = 50256
#: Bytes of a file that one row of ranges stands for, and that a worker reads and searches at once.
RANGE = 1 << 22
#: Ranges of a file that share one level of the prefix scan.
FAN = 1024
#: Schemes of stores whose files Python workers can open and read by byte range (add "hdfs" where workers have libhdfs).
#: Files of any other are read whole by Spark, 2 GB at most each.
RANGED = ("file", "s3", "gs")


def _encoder(vocabulary: str | None):
    import tiktoken

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenise(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): little-endian 16-bit ids of each text; a null text is empty.

    ``vocabulary`` is the path of a rank file, by default that of the installed public tokenizers.
    """
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            ids = [np.array(encoder.encode_ordinary(t or ""), "<u2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def write_token_files(tokens: DataFrame, path: str, *, eod: int = EOD) -> None:
    """Flat files of 16-bit ids, one per partition of ``tokens`` (ids), each document ended by ``eod``; nothing else is in them."""
    end = int(eod).to_bytes(2, "little").decode("latin-1")  # the sink's row separator
    tokens.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").text(path)


def _search(raw: np.ndarray, eod: int) -> tuple[int, int, int, np.ndarray]:
    """(separators, place of the first, of the last, lengths between) of a run of ids; places are -1 where there is none."""
    at = np.flatnonzero(raw == eod)
    return (len(at), int(at[0]), int(at[-1]), np.diff(at) - 1) if len(at) else (0, -1, -1, np.zeros(0, np.int64))


def _scheme(spark: SparkSession, path: str) -> str:
    """The scheme of a path's store."""
    default = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme()
    return re.match(r"(?:([a-zA-Z][\w+.-]*):)?", path)[1] or default


def _store(uri: str):
    """(file system, path in it), for a worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"file://{uri}" if uri.startswith("/") else re.sub("^file:/*", "file:///", uri))


SCAN = "file_id string, block long, n long, seps long, first long, last long, inner array<long>"


def scan_files(spark: SparkSession, path: str, *, eod: int = EOD, dtype: str = "<u2", step: int = RANGE, ranged: tuple[str, ...] = RANGED) -> DataFrame:
    """What each byte range of the files tells: (file_id, block, n, seps, first, last, inner).

    ``n`` ids from place block * step / width on; ``first`` and ``last`` are the absolute places of separators, ``inner``
    the lengths between them. Only these leave the worker, which reads its range and searches it at once. Bytes after a
    file's last whole id are ignored.
    """
    width = np.dtype(dtype).itemsize
    step = max(width, step // width * width)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def rows(name: str, first_block: int, blocks) -> Iterator[tuple]:
        for i, raw in enumerate(blocks):
            ids = np.frombuffer(raw, dtype, len(raw) // width)
            seps, first, last, inner = _search(ids, eod)
            base = (first_block + i) * (step // width)
            yield name, first_block + i, len(ids), seps, base + first, base + last, inner

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["file_id", "block", "n", "seps", "first", "last", "inner"])

    if _scheme(spark, path) not in ranged:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = content.as_buffer()
                    for row in rows(name, 0, (raw[a : a + step] for a in range(0, len(raw), step))):
                        yield batch([row])

        small_arrow_batches(spark, 8)
        return files.select("path", "content").where("length > 0").mapInArrow(whole, SCAN)

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, inside = _store(name)
                with store.open_input_file(inside) as f:
                    yield batch(list(rows(name, block, [f.read_at(step, block * step)])))

    cuts = files.select("path", "length").where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))
    return cuts.repartition("path", "block").mapInArrow(by_range, SCAN)


def count_tokens(scan: DataFrame) -> DataFrame:
    """Tokens of each document, separator excluded: (file_id, ordinal, n_tokens, complete).

    Ranges are searched alone (scan_files). A prefix scan over them, of the last separator's place and of their number,
    says where the first document of a range began and how many came before. It has two levels, FAN ranges to one, so
    that a file of any size is many tasks. Tokens after a file's last separator are a last document with ``complete``
    false. An empty document counts 0. Ranges may come in any order; none give no rows.
    """
    s = materialize(scan.withColumn("_top", F.floor(F.col("block") / FAN)), "token-ranges")
    slim = s.select("file_id", "_top", "block", "n", "seps", F.when(F.col("seps") > 0, F.col("last")).alias("last"))
    over = lambda w, c, f: F.coalesce(f(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1 if f is F.max else 0))
    tops = slim.groupBy("file_id", "_top").agg(F.max("last").alias("last"), F.sum("seps").alias("seps"), F.sum("n").alias("n"))
    high = Window.partitionBy("file_id").orderBy("_top")
    before = tops.select("file_id", "_top", over(high, "last", F.max).alias("_last"), over(high, "seps", F.sum).alias("_seps"))
    low = Window.partitionBy("file_id", "_top").orderBy("block")
    at = slim.join(before, ["file_id", "_top"]).select("file_id", "block", F.greatest("_last", over(low, "last", F.max)).alias("_open"), (F.col("_seps") + over(low, "seps", F.sum)).alias("_base"))
    d = s.where("seps > 0").join(at, ["file_id", "block"])
    done = d.select("file_id", "_base", F.posexplode(F.concat(F.array(F.col("first") - F.col("_open") - 1), "inner")).alias("_i", "n_tokens"))
    done = done.select("file_id", (F.col("_base") + F.col("_i")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    ends = tops.groupBy("file_id").agg(F.sum("seps").alias("ordinal"), (F.sum("n") - 1 - F.coalesce(F.max("last"), F.lit(-1))).alias("n_tokens"))
    return done.unionByName(ends.where("n_tokens > 0").select("file_id", "ordinal", "n_tokens", F.lit(False).alias("complete")))


def encode_to_files(docs: DataFrame, folder: str, *, vocabulary: str | None = None, eod: int = EOD) -> DataFrame:
    """Write texts to flat token files, one a task, by the workers themselves; (doc_id, file, ordinal) says which is where.

    A task that runs again writes a file of another name, and only its last run's names are returned.
    """
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = _store(folder)
        encoder, name, n, out = _encoder(vocabulary), f"part-{uuid.uuid4().hex}.bin", 0, None
        end = np.array([eod], "<u2").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(inside, recursive=True)
                out = store.open_output_stream(f"{inside}/{name}")
            for t in batch.column(1).to_pylist():
                out.write(np.array(encoder.encode_ordinary(t or ""), "<u2").tobytes() + end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows))], names=["doc_id", "file", "ordinal"])
            n += batch.num_rows
        if out is not None:
            out.close()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, file string, ordinal long")


def count_document_tokens(docs: DataFrame, *, vocabulary: str | None = None, eod: int = EOD, ranged: tuple[str, ...] = RANGED) -> DataFrame:
    """(doc_id, n_tokens) of every row, counted in flat token files that are written to the shared folder first.

    The files hold nothing but ids and separators; which document is which is known by its place in its file. Where Python
    workers cannot open the shared folder's store, Spark writes the files from a table of tokens, one per partition and in
    its order, and a second look at that table numbers its rows. A document that no file counts fails the query.

    A null or empty text counts 0; rows without an id and repeated rows each get their result; an empty table gives no
    rows; other columns are ignored. A text that holds ``eod`` as a token is not possible: plain text encodes to none.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    if _scheme(spark, path) in ranged:
        rows = materialize(encode_to_files(docs, path, vocabulary=vocabulary, eod=eod), "token-rows")
        if not rows.take(1):
            return rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
        file = F.substring_index("file_id", "/", -1)
    else:
        tokens = materialize(tokenise(docs, vocabulary=vocabulary), "tokens")
        write_token_files(tokens, path, eod=eod)
        at = tokens.select("doc_id", F.monotonically_increasing_id().alias("_id"))
        rows = materialize(at.select("doc_id", F.shiftright("_id", 33).cast("string").alias("file"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal")), "token-rows")
        file = F.regexp_extract("file_id", r"part-(\d+)-[^/]*$", 1).cast("int").cast("string")
    counts = count_tokens(scan_files(spark, path, eod=eod, ranged=ranged)).where("complete").select(file.alias("file"), "ordinal", "n_tokens")
    wrong = F.raise_error(F.concat_ws(" ", F.lit("no count of document"), F.col("ordinal").cast("string"), F.lit("in token file"), F.col("file")))
    return rows.join(counts, ["file", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", wrong.cast("long")).alias("n_tokens"))
