"""Repeated passages by a distributed difference-cover suffix sort: every byte of a 100-byte string that starts earlier.

How the work is spread: each 100-byte window has a locally chosen sample, the leftmost 32-byte block in it with the least
hash. Equal windows have equal samples, so windows can only repeat where the sample's name does. Three exchanges follow:
names are counted; 128-bit digests of the contexts of repeated names find contexts that occur whole somewhere earlier;
the contexts that are left, each once, go to the bucket of their name, where a difference-cover suffix sort orders
their windows and adjacent ones are compared byte by byte. Texts themselves stay in a bucketed table, and are not
shuffled. Whole documents are compared by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, small_arrow_batches, written_table
from .suffix import suffix_array

#: Bytes that must repeat; bytes of a sample block; blocks that a window chooses from.
LENGTH, BLOCK = 100, 32
CHOICE = LENGTH - BLOCK + 1
#: Bytes of text in a chunk row (a longer document is a chunk of its own), and bytes looked at in one step.
CHUNK, STEP = 1 << 20, 1 << 21
#: Bytes of contexts that are sorted at once; a bucket with more is sorted in parts, each with whole names.
SORT = 1 << 20
#: Bytes of text to a bucket of names, digests or contexts: buckets grow in number, not in size.
BUCKET = 32 << 20
#: A name that occurs so often is hot: its windows travel alone, dealt by their own content.
HOT = 1 << 15
NULL_ID = -(1 << 63)
TEXT_NULL = "_maxfold_text_is_null"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _block_names(b: np.ndarray) -> np.ndarray:
    """A hash of the BLOCK bytes at each place, by doubling."""
    h = _mix(b.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    k = 1
    while k < BLOCK:
        h = h[:-k] * np.uint64(0x94D049BB133111EB + 2 * k) + h[k:]
        h ^= h >> np.uint64(32)
        k *= 2
    return _mix(h)


def samples(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, name): maximal runs of window starts that choose the same block.

    ``b`` is a chunk's bytes; documents lie at [starts, ends), in order, and windows do not cross them.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(0, len(b) - LENGTH + 1), STEP):
        piece = b[lo : lo + STEP + LENGTH - 1]
        n = len(piece) - LENGTH + 1
        valid = np.zeros(n + 1, np.int64)
        np.add.at(valid, np.clip(starts - lo, 0, n), 1)
        np.add.at(valid, np.clip(np.maximum(ends - LENGTH + 1, starts) - lo, 0, n), -1)
        valid = valid[:n].cumsum() > 0
        if not valid.any():
            continue
        names = _block_names(piece)
        m = (names & ~np.uint64(0xFFFFFF)) | np.arange(len(names), dtype=np.uint64)  # ties: the leftmost
        w = 1
        while 2 * w <= CHOICE:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if w < CHOICE:
            m = np.minimum(m[: n + 0], m[CHOICE - w : CHOICE - w + n])
        at = (m[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        at[~valid] = -1
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(cut, n))
        keep = at[cut] >= 0
        out.append((cut[keep] + lo, size[keep], names[at[cut[keep]]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_windows(contexts: list[bytes], n_windows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For the windows of distinct contexts, in order: whether an equal window has a smaller key.

    ``contexts[i]`` holds ``n_windows[i]`` windows; the j-th has key ``key[i] + j``.
    """
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    total = int(n_windows.sum())
    offset = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    where, keys = np.repeat(begin, n_windows) + offset, np.repeat(key, n_windows) + offset
    number = np.full(len(text), -1, np.int64)
    number[where] = np.arange(total)
    # letter 0 only ends contexts: text bytes are moved up by one
    letters = text.astype(np.int64) + 1
    letters[begin + size] = 0
    order = number[suffix_array(letters)]
    order = order[order >= 0]
    starts = where[order]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text),), np.uint64, padded.data, strides=(1,))
    same = np.ones(max(0, total - 1), bool)
    for o in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        v = eight[starts + o]
        same &= v[1:] == v[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same])) if total else np.zeros(0, np.int64)
    k = keys[order]
    least = np.repeat(np.minimum.reduceat(k, first), np.diff(np.append(first, total))) if total else k
    out = np.zeros(total, bool)
    out[order] = k > least
    return out


def _intervals(first: np.ndarray, flags: np.ndarray, n_windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the maximal runs of flagged windows within each context."""
    of = np.repeat(np.arange(len(n_windows)), n_windows)
    begin = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + np.repeat(first, n_windows)
    on = flags & (begin | np.concatenate([[True], ~flags[:-1]])) if len(of) else flags
    off = flags & np.concatenate([begin[1:] | ~flags[1:], [True]]) if len(of) else flags
    return of[on], pos[on], pos[off] + 1


class _Chunk:
    """One chunk row: its documents, and the windows of the active ones."""

    def __init__(self, ids, lens, blob, active):
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.bytes = np.frombuffer(blob, np.uint8)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.active = np.sort(np.asarray(active, np.int64))

    def samples(self):
        return samples(self.bytes, self.starts[self.active], self.ends[self.active])

    def named(self, names: np.ndarray, buckets: int):
        """(distinct names in the order of bucket and name, where each is in them, the bucket of each distinct one)."""
        distinct, inverse, counts = np.unique(names & ~np.uint64(31), return_inverse=True, return_counts=True)
        bucket = ((distinct >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return distinct[order], back[inverse], bucket[order], counts[order]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            raw = [row[c].as_buffer() for c in ("ids", "lens", "blob")]
            yield row, _Chunk(*raw, (row["active"].as_py() if "active" in row else None) or [])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def chunk_table(docs: DataFrame) -> DataFrame:
    """Texts as rows of about CHUNK bytes, (chunk, ids, lens, blob, rest), in a table bucketed by chunk.

    Joins by chunk then move only the other side: the text is written once and never shuffled. ``rest`` holds the other
    columns as an Arrow stream, with one more, which says where the text is null.
    """
    spark = docs.sparkSession
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("blob", pa.binary()), ("rest", pa.binary())])
    others = [c for c in docs.columns if c != "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, slices, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            ids, lens = np.array([d for d, _ in held], np.int64), np.array([len(t) for _, t in held], np.int64)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, slices[0].schema) as stream:
                for x in slices:
                    stream.write_batch(x)
            return _batch(schema, [(number, ids.tobytes(), lens.tobytes(), b"".join(t for _, t in held), sink.getvalue().to_pybytes())])

        for batch in batches:
            texts = batch.column(1)
            rest = pa.RecordBatch.from_arrays([*batch.columns[2:], texts.is_null()], names=[*others, TEXT_NULL])
            begin = 0
            for i, (d, t) in enumerate(zip(batch.column(0).to_pylist(), texts.to_pylist(), strict=True)):
                raw = (t or "").encode()
                if held and size + len(raw) > CHUNK:
                    if i > begin:
                        slices.append(rest.slice(begin, i - begin))
                    yield row()
                    number, held, slices, size, begin = number + 1, [], [], 0, i
                held.append((d, raw))
                size += len(raw)
            slices.append(rest.slice(begin))
        if held:
            yield row()

    small_arrow_batches(spark, 500)
    packed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), "text", *others).mapInArrow(pack, "chunk long, ids binary, lens binary, blob binary, rest binary")
    return written_table(packed, "chunks", "chunk")


def _names(buckets: int):
    schema = pa.schema([("nb", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c in _chunks(batches):
            _, _, names = c.samples()
            distinct, _, bucket, counts = c.named(names, buckets)
            if len(distinct):
                value = (distinct & ~np.uint64(31)) | np.ceil(np.log2(counts)).astype(np.uint64)  # the last bits: how often in the chunk
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                yield _batch(schema, [(int(bucket[a]), row["chunk"].as_py(), value[a:b].tobytes()) for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True)])

    return run


def _count_names(df: pd.DataFrame) -> pd.DataFrame:
    """Which names repeat (1) or are hot (2), in the order in which they came."""
    sizes = df["names"].map(len).to_numpy() // 8
    v = np.frombuffer(b"".join(df["names"]), np.uint64)
    _, inverse = np.unique(v & ~np.uint64(31), return_inverse=True)
    counts = np.bincount(inverse, np.exp2((v & np.uint64(31)).astype(float)))
    code = np.where(counts >= HOT, 2, (counts > 1).astype(int)).astype(np.uint8)[inverse]
    ends = np.cumsum(sizes)
    return pd.DataFrame({"chunk": df["chunk"], "nb": df["nb"], "codes": [code[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]})


RECORDS = pa.schema([("nb", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("doc", pa.binary()), ("at", pa.binary()), ("start", pa.binary()), ("n", pa.binary()), ("sub", pa.binary()), ("blob", pa.binary())])


class _Repeated:
    """The runs of a chunk whose names repeat: distinct contexts in the order of (doc_id, start), and those that come again."""

    def __init__(self, row: dict, c: _Chunk, buckets: int):
        first, size, names = c.samples()
        _, at, bucket, _ = c.named(names, buckets)
        codes = np.frombuffer(b"".join(x["codes"] for x in sorted(row["reply"].as_py(), key=lambda x: x["nb"])), np.uint8)[at]
        r = np.flatnonzero(codes)
        self.first, self.size, self.nb, self.code = first[r], size[r], bucket[at][r], codes[r]
        self.sub = (names[r] >> np.uint64(48)).astype(np.uint16)
        self.doc = np.searchsorted(c.ends, self.first, side="right")
        self.id, self.start = c.ids[self.doc], self.first - c.starts[self.doc]
        self.blob = c.bytes.tobytes()
        seen: dict[bytes, int] = {}
        self.again = []
        for i in np.lexsort((self.first, self.id)).tolist():
            if self.context(i) in seen:
                self.again.append(i)
            else:
                seen[self.context(i)] = i
        self.distinct = np.fromiter(seen.values(), np.int64, len(seen))

    def context(self, i: int) -> bytes:
        return self.blob[self.first[i] : self.first[i] + self.size[i] + LENGTH - 1]


DIGESTS = pa.schema([("nb", pa.int32()), ("chunk", pa.int64()), ("digest", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())])


def _digests(buckets: int):
    """Digests of the distinct contexts of a chunk, dealt by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c in _chunks(batches):
            f = _Repeated(row, c, buckets)
            if not len(f.distinct):
                continue
            d = np.frombuffer(b"".join(hashlib.blake2b(f.context(i), digest_size=16).digest() for i in f.distinct.tolist()), np.uint64).reshape(-1, 2)
            nb = (d[:, 0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(nb, kind="stable")
            cut = np.flatnonzero(np.diff(nb[order], prepend=-1))
            own = row["chunk"].as_py()
            out = []
            for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
                r = order[a:b]
                k = f.distinct[r]
                out.append((int(nb[r[0]]), own, d[r].tobytes(), f.id[k].tobytes(), f.start[k].astype(np.int32).tobytes() + r.astype(np.int32).tobytes()))
            yield _batch(DIGESTS, out)

    return run


def _first_contexts(df: pd.DataFrame) -> pd.DataFrame:
    """Which distinct contexts of a chunk, by number, occur whole in front of that place."""
    n = [len(x) // 8 for x in df["doc"]]
    d = np.frombuffer(b"".join(df["digest"]), np.uint64).reshape(-1, 2)
    doc = np.frombuffer(b"".join(df["doc"]), np.int64)
    start = np.concatenate([np.frombuffer(x, np.int32)[:k] for x, k in zip(df["start"], n, strict=True)])
    number = np.concatenate([np.frombuffer(x, np.int32)[k:] for x, k in zip(df["start"], n, strict=True)])
    order = np.lexsort((start, doc, d[:, 1], d[:, 0]))
    x, y, z, w = d[order, 0], d[order, 1], doc[order], start[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    later[order] = (z != z[lead]) | (w != w[lead])
    ends = np.cumsum(n)
    return pd.DataFrame({"chunk": df["chunk"], "later": [number[e - k : e][later[e - k : e]].tobytes() for e, k in zip(ends, n, strict=True)]})


def _contexts(buckets: int):
    """Contexts of repeated names that occur nowhere earlier, dealt by name; of hot names as single windows, dealt by content.

    A context that occurs earlier is decided here: all its windows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c in _chunks(batches):
            f = _Repeated(row, c, buckets)
            later = np.zeros(len(f.distinct), bool)
            for x in row["later"].as_py() or []:
                later[np.frombuffer(x, np.int32)] = True
            own = row["chunk"].as_py()
            put: dict[int, list[tuple[int, int, int, int]]] = {}
            for i in f.distinct[~later].tolist():
                if f.code[i] == 1:
                    put.setdefault(int(f.nb[i]), []).append((i, 0, int(f.size[i]), int(f.sub[i])))
                    continue
                for j in range(int(f.size[i])):
                    digest = hashlib.blake2b(f.context(i)[j : j + LENGTH], digest_size=8).digest()
                    put.setdefault(int.from_bytes(digest[:6], "little") % buckets, []).append((i, j, 1, int.from_bytes(digest[6:], "little")))

            def record(b: int, kind: int, rows: list[tuple[int, int, int, int]]):
                i, j, n, sub = np.array(rows, np.int64).T
                text = b"" if kind else b"".join(f.blob[a : a + k + LENGTH - 1] for a, k in zip((f.first[i] + j).tolist(), n.tolist(), strict=True))
                return (b, own, kind, f.id[i].tobytes(), f.doc[i].astype(np.int32).tobytes(), (f.start[i] + j).tobytes(), n.astype(np.int32).tobytes(), sub.astype(np.uint16).tobytes(), text)

            out = [record(b, 0, rows) for b, rows in put.items()]
            again = [*f.again, *f.distinct[later].tolist()]
            if again:
                out.append(record(own % buckets, 1, [(i, 0, int(f.size[i]), 0) for i in again]))
            if out:
                yield _batch(RECORDS, out)

    return run


def _compare(df: pd.DataFrame) -> pd.DataFrame:
    """The bucket of a name: its distinct contexts are suffix-sorted together. Intervals of window starts that repeat."""
    out: dict[int, list[tuple]] = {}

    def told(chunk: int, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        out.setdefault(chunk, []).append((at.astype(np.int32), a.astype(np.int64), b.astype(np.int64)))

    get = lambda name, kind, part: np.frombuffer(b"".join(part[name]), kind)
    for _, row in df[df["kind"] == 1].iterrows():
        a = np.frombuffer(row["start"], np.int64)
        told(row["chunk"], np.frombuffer(row["at"], np.int32), a, a + np.frombuffer(row["n"], np.int32))
    part = df[df["kind"] == 0]
    if len(part):
        doc, at, start, n = get("doc", np.int64, part), get("at", np.int32, part), get("start", np.int64, part), get("n", np.int32, part).astype(np.int64)
        sub = get("sub", np.uint16, part)
        chunk = np.repeat(part["chunk"].to_numpy(), [len(x) // 8 for x in part["doc"]])
        blob = b"".join(part["blob"])
        del df, part
        ends = np.cumsum(n + LENGTH - 1)
        parts = max(1, -(-len(blob) // SORT))
        order = np.lexsort((start, doc, sub % parts))
        cuts = np.searchsorted((sub % parts)[order], np.arange(parts + 1))
        found: list[tuple] = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            seen: dict[bytes, int] = {}
            again = []
            for i in order[x:y].tolist():
                ctx = blob[ends[i] - n[i] - LENGTH + 1 : ends[i]]
                if ctx in seen:
                    again.append(i)
                else:
                    seen[ctx] = i
            if not seen:
                continue
            again, first = np.array(again, np.int64), np.fromiter(seen.values(), np.int64)
            _, rank = np.unique(doc[first], return_inverse=True)
            flags = repeated_windows(list(seen), n[first], (rank.astype(np.int64) << 40) | start[first])
            of, a, b = _intervals(start[first], flags, n[first])
            found.append((np.concatenate([chunk[first[of]], chunk[again]]), np.concatenate([at[first[of]], at[again]]), np.concatenate([a, start[again]]), np.concatenate([b, start[again] + n[again]])))
        hit_chunk, hit_at, hit_a, hit_b = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(hit_chunk, kind="stable")
        hit_chunk, hit_at, hit_a, hit_b = hit_chunk[by], hit_at[by], hit_a[by], hit_b[by]
        cut = np.flatnonzero(np.diff(hit_chunk, prepend=-1))
        for x, y in zip(cut, np.append(cut[1:], len(hit_chunk)), strict=False):
            told(int(hit_chunk[x]), hit_at[x:y], hit_a[x:y], hit_b[x:y])
    rows = [(k, *(np.concatenate(x).tobytes() for x in zip(*v, strict=True))) for k, v in out.items()]
    return pd.DataFrame(rows, columns=["chunk", "at", "a", "b"])


def removed_spans(c: _Chunk, told: list[dict] | None) -> dict[int, list[tuple[int, int]]]:
    """Document in the chunk -> maximal removed runs of bytes."""
    if not told:
        return {}
    at = np.concatenate([np.frombuffer(x["at"], np.int32) for x in told]).astype(np.int64)
    a = np.concatenate([np.frombuffer(x["a"], np.int64) for x in told])
    b = np.concatenate([np.frombuffer(x["b"], np.int64) for x in told]) + LENGTH - 1
    order = np.lexsort((a, at))
    out: dict[int, list[tuple[int, int]]] = {}
    for d, x, y in zip(at[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        runs = out.setdefault(d, [])
        if runs and x <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(y, runs[-1][1]))
        else:
            runs.append((x, y))
    return out


def _kept(c: _Chunk, d: int, runs: list[tuple[int, int]]) -> bytes:
    text = c.bytes[c.starts[d] : c.ends[d]].tobytes()
    return b"".join(text[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(text)], strict=True))


RESULT = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, c in _chunks(batches):
        spans = removed_spans(c, row["told"].as_py())
        out = []
        for d in c.active.tolist():
            runs = spans.get(d, [])
            sha = hashlib.sha256(c.bytes[c.starts[d] : c.ends[d]]).digest()
            out.append((int(c.ids[d]), sha, sum(e - s for s, e in runs), len(runs), hashlib.sha256(_kept(c, d, runs)).digest()))
        if out:
            yield _batch(RESULT, out)


def _locate(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their SHA-256, the first of each distinct text of LENGTH bytes or more, chunks with what repeats).

    Only the first of equal texts is active: it is searched, and searched for.
    """
    spark: SparkSession = docs.sparkSession
    chunks = chunk_table(docs)
    texts = chunks.select("chunk", "ids", "lens", "blob")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary())])
        for row, c in _chunks(batches):
            own = row["chunk"].as_py()
            yield _batch(schema, [(own, i, int(c.ids[i]), int(c.lens[i]), hashlib.sha256(c.bytes[c.starts[i] : c.ends[i]]).digest()) for i in range(len(c.ids))])

    every = materialize(texts.mapInArrow(digest, "chunk long, idx int, doc_id long, n_bytes long, sha binary"), "dup-docs")
    total = every.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    first = materialize(every.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min(F.struct("doc_id", "chunk", "idx")).alias("f")), "dup-first")
    active = materialize(first.groupBy(F.col("f.chunk").alias("chunk")).agg(F.collect_list("f.idx").alias("active")), "dup-active")
    names = texts.join(active, "chunk").mapInArrow(_names(buckets), "nb int, chunk long, names binary")
    codes = names.groupBy("nb").applyInPandas(_count_names, "chunk long, nb int, codes binary")
    reply = materialize(codes.groupBy("chunk").agg(F.collect_list(F.struct("nb", "codes")).alias("reply")), "dup-reply")
    asked = texts.join(active.join(reply, "chunk"), "chunk")
    digests = asked.mapInArrow(_digests(buckets), "nb int, chunk long, digest binary, doc binary, start binary")
    later = digests.groupBy("nb").applyInPandas(_first_contexts, "chunk long, later binary").groupBy("chunk").agg(F.collect_list("later").alias("later"))
    later = materialize(later, "dup-later")
    asked = texts.join(active.join(reply, "chunk").join(later, "chunk", "left"), "chunk")
    records = asked.mapInArrow(_contexts(buckets), "nb int, chunk long, kind int, doc binary, at binary, start binary, n binary, sub binary, blob binary")
    told = records.groupBy("nb").applyInPandas(_compare, "chunk long, at binary, a binary, b binary")
    told = materialize(told.groupBy("chunk").agg(F.collect_list(F.struct("at", "a", "b")).alias("told")), "dup-told")
    return every, first, chunks.join(active.join(told, "chunk", "left"), "chunk", "left")


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row: what is left once repeated bytes are removed.

    Texts are UTF-8 bytes, a null text is empty. A byte is removed where a LENGTH-byte string that covers it also
    starts earlier: in a document with a smaller doc_id, or in the same one at an earlier place. Strings do not cross
    documents, and are judged on the input. ``kept_sha256`` is that of the remaining bytes, as 32 bytes.

    An exactly repeated row (same doc_id, same text) gets the result its like gets. Of different texts under one doc_id,
    equal strings at equal places may count as earlier in either. A null doc_id comes first of all and is one document
    id. Documents shorter than LENGTH lose nothing; an exact copy of LENGTH bytes or more loses all. An empty table
    gives no rows; other columns are ignored.
    """
    every, first, found = _locate(docs.select("doc_id", "text"))
    done = found.where("active is not null").drop("rest").mapInArrow(_results, "doc_id long, sha binary, n_removed long, n_spans long, kept binary")
    done = done.withColumnRenamed("doc_id", "_lead").withColumnRenamed("sha", "_sha")
    rest = every.join(first.select("sha", F.col("f.doc_id").alias("lead")), "sha", "left")
    is_lead = F.coalesce(F.col("lead") == F.col("doc_id"), F.lit(False))
    gone = F.col("n_bytes") >= LENGTH
    empty = F.lit(hashlib.sha256(b"").digest())
    same = rest.where(~is_lead).select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(gone, empty).otherwise(F.col("sha")).alias("kept"))
    led = rest.where(is_lead).join(done, (F.col("doc_id") == F.col("_lead")) & (F.col("sha") == F.col("_sha"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    return led.unionByName(same).withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))).withColumnRenamed("kept", "kept_sha256")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes removed from text and n_chars counted anew where it changes.

    Bytes go as find_repeats() says, and with them the parts of characters that a cut goes through. A document that
    loses all it had, as an exact copy does, is dropped; null and short texts stay as they are. All other columns pass
    through. Texts are not shuffled.
    """
    _, _, found = _locate(docs)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c in _chunks(batches):
            spans = removed_spans(c, row["told"].as_py())
            active = set(c.active.tolist())
            rest = pa.ipc.open_stream(row["rest"].as_buffer()).read_all()
            null = rest.column(TEXT_NULL).to_pylist()
            keep, texts, lengths = [], [], []
            for d, size in enumerate(c.lens.tolist()):
                if size >= LENGTH and d not in active:
                    continue
                text = _kept(c, d, spans.get(d, [])).decode("utf-8", "ignore")
                if d in spans and not text.strip():
                    continue
                keep.append(d)
                texts.append(None if null[d] else text)
                lengths.append(len(text) if d in spans else None)
            if keep:
                kept = rest.take(pa.array(keep))
                arrays = []
                for name in columns:
                    if name == "text":
                        arrays.append(pa.array(texts, pa.string()))
                        continue
                    x = kept.column(name).combine_chunks()
                    if name == "n_chars":
                        x = pa.compute.coalesce(pa.array(lengths, pa.int64()).cast(x.type), x)
                    arrays.append(x)
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return found.mapInArrow(run, docs.schema)


#: find_repeats() without samples or sorting: every window of LENGTH bytes of every text, grouped by its bytes.
REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, b, row_number() OVER (ORDER BY doc_id NULLS FIRST, b) AS r FROM (SELECT DISTINCT doc_id, encode(coalesce(text, '')) AS b FROM documents)),
w AS (SELECT r, i, b[i + 1:i + {LENGTH}] AS s FROM (SELECT r, b, unnest(range(greatest(octet_length(b) - {LENGTH - 1}, 0))) AS i FROM d)),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM w) WHERE k > 1),
opened AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS o FROM later),
runs AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT r, i, sum(o) OVER (PARTITION BY r ORDER BY i) AS g FROM opened) GROUP BY r, g),
bounds AS (SELECT r, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS x, a AS y FROM runs
  UNION ALL SELECT r, max(z), octet_length(any_value(b)) FROM runs JOIN d USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN x < y THEN hex(b[x + 1:y]) ELSE '' END, '' ORDER BY x, y) AS h FROM bounds JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
done AS (SELECT doc_id, b, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r))
SELECT done.doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM documents
JOIN done ON documents.doc_id IS NOT DISTINCT FROM done.doc_id AND encode(coalesce(text, '')) = done.b
"""
