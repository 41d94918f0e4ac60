"""Near-duplicates by BagMinHash signatures of weighted shingle multisets, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small_arrow_batches
from .components import connected_components, salted_join

SHINGLE, SIMILARITY = 5, 0.8
#: Registers of a signature; bands of ROWS registers. Two texts of similarity 0.8 share a band with probability 0.9998.
REGISTERS, ROWS = 64, 4
BANDS = REGISTERS // ROWS
#: Weight of the texts that one task verifies at once; components beyond it are cut into blocks of half as much. A text
#: weighs 1, and 1 more for each HEAVY distinct shingles, so a task holds 200 MB of shingles at most besides a longer text.
TILE, HEAVY = 2048, 8192
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, computed once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of five-word shingles of the lower-case text, ascending, and how often each occurs.

    Words are separated by white space. A shorter text is one shingle; one without words has none.
    """
    w = np.array([words[x] for x in (text or "").lower().split()], np.uint64)
    k = min(SHINGLE, len(w))
    if not k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = mix64(h + w[j : len(w) - k + 1 + j] + GOLD)
    return np.unique(h, return_counts=True)


def bag_signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures (len(bags), registers) of multisets; two agree in a register with their weighted Jaccard.

    The weight axis of an element is cut at 1, 2, 4, 8...; each interval has a Poisson process of its length as rate,
    whose points have a time, a register and a place on the axis, all from hashes. Points placed under the element's
    weight count, and a register keeps the earliest. The processes of an element advance in time only as far as the
    time by which all registers are expected to be filled; a bag with one still empty is done again up to later.
    """
    out = np.full((len(bags), registers), np.inf)
    todo, slack = [i for i, (h, _) in enumerate(bags) if len(h)], 7.0
    while todo:
        h = np.concatenate([bags[i][0] for i in todo])
        c = np.concatenate([bags[i][1] for i in todo]).astype(np.float64)
        bag = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        total = np.array([bags[i][1].sum() for i in todo])
        limit = registers * (np.log(registers) + slack) / total
        first = np.full(len(todo) * registers, np.inf)
        low, rate, level = 0.0, 1.0, 0
        while len(h):  # h, c, bag: elements that reach into this interval
            x, end, place, t = mix64(h + np.uint64(level * 0xD1B54A32D192ED03 % 2**64)), c, bag, np.zeros(len(h))
            while len(x):
                x = x + GOLD
                y = mix64(x)
                t = t - np.log(((y >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / rate
                alive = t < limit[place]
                x, end, place, t, y = x[alive], end[alive], place[alive], t[alive], y[alive]
                under = low + ((y >> np.uint64(6)) & np.uint64(0x3FFFF)).astype(np.float64) * (rate * 2.0**-18) < end
                np.minimum.at(first, place[under] * registers + (y[under] & np.uint64(registers - 1)).astype(np.int64), t[under])
            low, rate, level = low + rate, max(1.0, low + rate), level + 1
            reach = c > low
            h, c, bag = h[reach], c[reach], bag[reach]
        first = first.reshape(-1, registers)
        full = np.isfinite(first).all(1)
        out[np.array(todo)[full]] = first[full]
        todo, slack = [i for i, ok in zip(todo, full, strict=True) if not ok], slack * 3
    bits = out.view(np.uint64)
    return (mix64(bits) >> np.uint64(32)).astype(np.uint32)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


class Overlaps:
    """Weighted Jaccard of one multiset of ``bags`` with many others at once."""

    #: Elements of multisets looked at in one step.
    STEP = 1_000_000

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]]):
        self.n = np.array([len(h) for h, _ in bags])
        self.starts = np.cumsum(self.n) - self.n
        vocabulary, self.ids = np.unique(np.concatenate([h for h, _ in bags]), return_inverse=True)
        self.counts = np.concatenate([c for _, c in bags])
        self.total = np.add.reduceat(self.counts, self.starts)
        self.weights = np.zeros(len(vocabulary), np.int64)

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        """Similarities of bag ``i`` to ``others``; no bag may be empty."""
        mine = slice(self.starts[i], self.starts[i] + self.n[i])
        self.weights[self.ids[mine]] = self.counts[mine]
        step, common = np.cumsum(self.n[others]) // self.STEP, []
        for js in np.split(others, np.flatnonzero(np.diff(step)) + 1):
            first = np.cumsum(self.n[js]) - self.n[js]
            at = np.arange(self.n[js].sum()) + np.repeat(self.starts[js] - first, self.n[js])
            common.append(np.add.reduceat(np.minimum(self.weights[self.ids[at]], self.counts[at]), first))
        self.weights[self.ids[mine]] = 0
        common = np.concatenate(common)
        return common / (self.total[i] + self.total[others] - common)


def link_texts(sig: np.ndarray, bags: list, known: np.ndarray, side: np.ndarray | None, similarity: float) -> np.ndarray:
    """The least index of each text's class: classes are connected by pairs of at least ``similarity`` that share a band.

    Pairs are verified in the order of agreeing registers; one whose texts are already connected needs no verifying.
    ``known``: labels of texts that are connected from the start. ``side``: only pairs of texts from different sides count.
    """
    known = np.unique(known, return_inverse=True)[1]
    n = len(sig)
    bands = np.ascontiguousarray(sig).view(f"V{4 * ROWS}")  # (n, BANDS): a band's registers as one value
    bands = np.stack([np.unique(bands[:, i], return_inverse=True)[1] for i in range(BANDS)], 1).astype(np.int32)
    a, b, s = [], [], []
    for i in range(n - 1):
        ok = (bands[i + 1 :] == bands[i]).any(1) & (known[i + 1 :] != known[i])
        if side is not None:
            ok &= side[i + 1 :] != side[i]
        j = np.flatnonzero(ok) + i + 1
        a.append(np.full(len(j), i))
        b.append(j)
        s.append((sig[j] == sig[i]).mean(1))
    root = np.unique(known, return_index=True)[1][known]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    if a:
        a, b, s = map(np.concatenate, (a, b, s))
        order = np.argsort(-s, kind="stable")
        a, b = a[order], b[order]
        overlaps, step = Overlaps(bags), 256
        while len(a):
            x, y = a[:step], b[:step]
            by = np.argsort(x, kind="stable")
            for js in np.split(by, np.flatnonzero(np.diff(x[by])) + 1):
                i, other = int(x[js[0]]), y[js]
                for j in other[overlaps(i, other) >= similarity].tolist():
                    u, v = find(i), find(j)
                    root[max(u, v)] = min(u, v)
            now = np.array([find(i) for i in range(n)])
            a, b, step = a[step:], b[step:], min(2 * step, 65536)
            apart = now[a] != now[b]
            a, b = a[apart], b[apart]
    return np.array([find(i) for i in range(n)], np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, sig, weight): fp identifies the shingle multiset, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = WordHashes()
        for batch in batches:
            bags = [shingles(t.as_py(), words) for t in batch.column(1)]
            sigs = bag_signatures(bags)
            fp = [xxhash.xxh128_digest(h.tobytes() + c.tobytes()) if len(h) else None for h, c in bags]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array([1 + len(h) // HEAVY for h, _ in bags], pa.int32())], names=["doc_id", "fp", "sig", "weight"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp binary, sig binary, weight int")


def text_bags(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, h, c): shingle hashes and counts of the documents whose id is in ``nodes`` (node)."""
    words_of = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [shingles(t.as_py(), words_of) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h, _ in bags], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in bags], pa.binary())], names=["node", "h", "c"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
    return texts.join(nodes, "node", "left_semi").mapInArrow(run, "node long, h binary, c binary")


def unpack(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A multiset from its bytes."""
    return np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32).astype(np.int64)


def hub_classes(docs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(node, class): texts connected by links to the most typical texts of their buckets.

    ``members`` (node, key, n) are the rows of band buckets of n texts. A text is compared with one hub, that with which it
    shares most bands; a bucket's hub is the text in the largest buckets in sum. The work is linear in a bucket's size.
    """
    typical = members.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = members.join(typical, "node").groupBy("key").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("hub"))
    met = salted_join(members.select("node", "key"), hubs, "key", "node").where("node != hub").groupBy("node", "hub").agg(F.count("*").alias("bands"))
    pairs = materialize(met.groupBy("node").agg(F.max_by("hub", F.struct("bands", -F.col("hub"))).alias("hub")), "bag-hubs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, hub, h, c, hub_h, hub_c = (x.to_pylist() for x in batch.columns)
            ok = [i for i in range(len(node)) if overlap(unpack(h[i], c[i]), unpack(hub_h[i], hub_c[i])) >= similarity]
            yield pa.RecordBatch.from_arrays([pa.array([hub[i] for i in ok], pa.int64()), pa.array([node[i] for i in ok], pa.int64())], names=["a", "b"])

    of_hub = text_bags(docs, pairs.select(F.col("hub").alias("node"))).select(F.col("node").alias("hub"), F.col("h").alias("hub_h"), F.col("c").alias("hub_c"))
    sides = salted_join(pairs.join(text_bags(docs, pairs.select("node")), "node"), of_hub, "hub", "node")
    links = sides.select("node", "hub", "h", "c", "hub_h", "hub_c").mapInArrow(verify, "a long, b long")
    return materialize(connected_components(links), "bag-hub-classes").select("node", F.col("root").alias("class"))


def place(members: DataFrame, tile: int) -> DataFrame:
    """``members`` (node, root, class, weight) with the tiles that verify them.

    More columns: done (the component is one class already), cut (it is beyond a tile), block and others (blocks to meet).
    Classes that fill a block by themselves have blocks of their own, which never meet each other; the other texts share
    blocks, which meet all. So a large group whose texts are linked already meets only the few that are not.
    """
    block = max(1, tile // 2)
    sizes = members.groupBy("root", "class").agg(F.sum("weight").alias("w"))
    own = F.col("w") > block
    layout = sizes.groupBy("root").agg(
        F.count("*").alias("classes"),
        F.sum("w").alias("size"),
        F.collect_list(F.when(own, F.struct(F.col("class").cast("string").alias("name"), F.ceil(F.col("w") / block).alias("blocks")))).alias("owns"),
        F.ceil(F.coalesce(F.sum(F.when(~own, F.col("w"))), F.lit(0)) / block).alias("rest"),
    )
    placed = salted_join(members, layout, "root", "node").withColumn("done", F.col("classes") == 1).withColumn("cut", F.col("size") > tile)
    named = lambda name, n: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.concat_ws(":", name, j.cast("string")))
    mine = F.col("class").cast("string")
    place_of = lambda n: F.pmod(F.xxhash64("node"), n).cast("string")
    foreign = F.flatten(F.transform(F.filter("owns", lambda x: x["name"] != mine), lambda x: named(x["name"], x["blocks"])))
    shared = F.when(F.col("rest") > 0, named(F.lit("rest"), F.col("rest"))).otherwise(F.array().cast("array<string>"))
    mine_own = F.filter("owns", lambda x: x["name"] == mine)
    at = F.when(F.size(mine_own) > 0, F.concat_ws(":", mine, place_of(F.element_at(mine_own, 1)["blocks"]))).otherwise(F.concat_ws(":", F.lit("rest"), place_of(F.col("rest"))))
    whole = F.array(F.lit("all"))
    placed = placed.withColumn("block", F.when(F.col("cut"), at).otherwise(F.lit("all"))).withColumn("others", F.when(F.col("cut"), F.concat(foreign, shared)).otherwise(whole))
    return placed.drop("classes", "owns", "rest")


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id) of every row with a doc_id; class_id is the class's least doc_id.

    Two texts are linked where they share a band of their BagMinHash signatures and the weighted Jaccard of their
    multisets of five-word shingles is at least ``similarity``; classes are the connected components of the links. Texts with equal multisets are copies and are
    represented by the least doc_id. Representatives that share a band form candidate components (a star per band bucket,
    so no bucket makes all pairs); within these, pairs that share a band are verified by exact multiset overlap until
    each class is connected. That rule is the same in groups of every size.

    Texts of a component over an eighth of ``tile`` are first compared with hubs (hub_classes), so that what follows
    meets only texts that are not connected yet. A component of up to ``tile`` is then verified by one task; a larger one
    in blocks (place), each pair of blocks by a task of its own, whose links are then joined. A text without words is a
    class of its own, and one of fewer than five words is one shingle. Null texts have no words; rows without a doc_id
    take no part; repeated rows appear as often as given. An empty table gives no rows; other columns are ignored.
    """
    small_arrow_batches(docs.sparkSession)
    signed = materialize(sign(docs), "bag-signed")
    reps = materialize(signed.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("weight").alias("weight")), "bag-reps")
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(BANDS)])
    banded = reps.select("rep", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(salted_join(banded, shared, "key", "rep"), "bag-buckets")
    candidates = connected_components(buckets.select(F.col("center").alias("a"), F.col("rep").alias("b")))
    candidates = materialize(candidates.join(reps.select(F.col("rep").alias("node"), "weight"), "node"), "bag-candidates")

    large = candidates.groupBy("root").agg(F.sum("weight").alias("size")).where(F.col("size") > max(1, tile // 8)).select("root")
    members = candidates.withColumn("class", F.col("node"))
    if large.take(1):
        crowd = salted_join(candidates.select("node", "root"), large, "root", "node").select("node")
        known = hub_classes(docs, buckets.select(F.col("rep").alias("node"), "key", "n").join(crowd, "node", "left_semi"), similarity)
        members = candidates.join(known, "node", "left").withColumn("class", F.coalesce("class", "node"))
    members = materialize(place(members, tile), "bag-members")
    todo = members.where("not done")
    small = max(1, tile // 16)
    bins = max(1, -(-int(todo.agg(F.sum("weight")).first()[0] or 0) // tile))
    group = F.when(F.col("size") <= small, F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(bins)))).otherwise(
        F.concat_ws("/", "root", F.least("block", "other"), F.greatest("block", "other"))
    )
    placed = todo.withColumn("other", F.explode("others")).select("node", "root", "class", "block", "cut", group.alias("tile"))
    placed = placed.join(reps.select(F.col("rep").alias("node"), "sig"), "node")

    def verify(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        df = df.sort_values("node", kind="stable").drop_duplicates(["root", "node"])
        for root, part in df.groupby("root", sort=False):
            ids = part["node"].to_numpy()
            sig = np.stack([np.frombuffer(s, np.uint32) for s in part["sig"]])
            held = [unpack(h, c) for h, c in zip(part["h"], part["c"], strict=True)]
            blocks = part["block"].to_numpy()
            least = link_texts(sig, held, part["class"].to_numpy(), blocks if len(set(blocks)) > 1 else None, similarity)
            out.append(pd.DataFrame({"node": ids, "root": ids[least], "cut": part["cut"].to_numpy()}))
        return pd.concat(out)

    linked = placed.join(text_bags(docs, todo.select("node")), "node").groupBy("tile").applyInPandas(verify, "node long, root long, cut boolean")
    linked = materialize(linked, "bag-linked")
    classes = linked.where("not cut").select("node", "root").unionByName(members.where("done").select("node", F.col("class").alias("root")))
    cut = linked.where("cut").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if cut.take(1):
        classes = classes.unionByName(connected_components(cut.unionByName(todo.where("cut").select(F.col("node").alias("a"), F.col("class").alias("b")))))
    rep_class = reps.select("fp", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("_class"))
    return signed.select("doc_id", "fp").join(rep_class, "fp", "left").select("doc_id", F.coalesce("_class", "doc_id").alias("class_id"))


#: near_duplicates() without signatures or bands: the exact multiset overlap of all texts that share a shingle.
NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')),
  '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
sh AS (SELECT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s, count(*) AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE m::DOUBLE / (nx.n + ny.n - m)::DOUBLE >= {SIMILARITY}::DOUBLE),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT doc_id, y FROM reach JOIN link ON x = other)
SELECT documents.doc_id, class_id FROM documents JOIN (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id) AS c ON c.doc_id = documents.doc_id
"""
