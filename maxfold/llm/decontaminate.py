"""Benchmark decontamination: pigeonhole pieces find hits, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_arrow_batches

#: Edits allowed per character of a test item.
ERROR_RATE = 0.08
#: Shorter items (normalised) occur by chance inside words and with edits: they are matched exactly, at word borders.
MIN_CHARS = 16
#: Characters of benchmark text that one automaton holds; a larger benchmark is searched in parts.
PART_CHARS = 20_000_000
LEAKS = "array<struct<item_id:bigint,distance:int,end:int>>"


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """The item in error budget + 1 pieces (offset, piece): a match within the budget keeps one of them intact."""
    n = int(len(item) * rate) + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring, where the first such substring ends)."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def find_word(text: str, word: str) -> int:
    """Where ``word`` first stands in ``text`` with no letter or digit of the text running on into it; -1 if nowhere."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        joined = (at > 0 and text[at - 1].isalnum() and word[0].isalnum()) or (end < len(text) and text[end].isalnum() and word[-1].isalnum())
        if not joined:
            return at
        at = text.find(word, at + 1)
    return -1


class Matcher:
    """An automaton over the pieces of all items; one of fewer than ``min_chars`` characters is a piece by itself."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        by_piece: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.items = items
        self.short = [len(t) < min_chars for _, t in items]
        self.budget = [int(len(t) * rate) for _, t in items]
        for k, (_, text) in enumerate(items):
            for offset, piece in [(0, text)] if self.short[k] else pieces(text, rate):
                by_piece[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text): each item's nearest occurrence within its budget."""
        t = normalise(text)
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (n, where) in self.automaton.iter(t):
            for k, offset in where:
                starts[k].append(end + 1 - n - offset)
        out = []
        for k, at in starts.items():
            item_id, item = self.items[k]
            found = find_word(t, item) if self.short[k] else t.find(item)
            if found >= 0:
                out.append((item_id, 0, found + len(item)))
            if found >= 0 or self.short[k]:
                continue
            e, best = self.budget[k], None
            at.sort()
            lo = hi = at[0]
            for s in [*at[1:], None]:
                if s is not None and s <= hi + len(item):  # windows that overlap are searched as one
                    hi = s
                    continue
                a = max(0, lo - e)
                d, end = myers(item, t[a : hi + len(item) + e])
                if d <= e and (best is None or (d, a + end) < best):
                    best = (d, a + end)
                if s is not None:
                    lo = hi = s
            if best:
                out.append((item_id, *best))
        return sorted(out)


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str, *, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with one more column, the benchmark items that each text holds: array of (item_id, distance, end).

    An item occurs where a substring of the normalised text (lower case, runs of white space as one space) is within
    ``rate`` edits per character. The item is cut into budget + 1 pieces, one of which any such occurrence keeps
    intact; exact piece hits, found in one pass over the whole text, give windows in which Myers' algorithm measures
    the distance. Distance and end are those of the nearest occurrence, the first of equal ones. An item of fewer than
    ``min_chars`` characters occurs where it stands exactly, at word borders.

    One narrow pass, no shuffle. The benchmark is collected, in parts of PART_CHARS characters where it is larger, each
    of which adds a pass. Null or empty texts hold nothing. Items that are null, empty after normalising, or have no id
    take no part; repeated items are reported once per id, and different texts under one id by the nearest. Repeated
    rows each get their result; all columns of ``docs`` pass through, whatever their names (one named ``column`` is not
    accepted). An empty benchmark gives empty arrays.
    """
    if column in docs.columns:
        raise ValueError(f"the documents already have a column {column}")
    small_arrow_batches(docs.sparkSession)
    b = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    chars = b.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    parts = max(1, -(-chars // PART_CHARS))
    out = docs.withColumn(column, F.array().cast(LEAKS))
    for part in range(parts):
        mine = b.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        items = sorted({(r["item_id"], t) for r in mine.toLocalIterator() if (t := normalise(r["text"]))})
        if items:
            out = _one_part(out, column, items, rate, min_chars)
    return out


#: The matcher that a Python worker made last, by the broadcast it was made from: the tasks of a worker share it.
_made: dict[str, Matcher] = {}


def _matcher(name: str, items, rate: float, min_chars: int) -> Matcher:
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(items.value, rate, min_chars)
    return _made[name]


def _one_part(docs: DataFrame, column: str, items: list[tuple[int, str]], rate: float, min_chars: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)  # PART_CHARS characters at most
    text, leaks, made_from = docs.columns.index("text"), docs.columns.index(column), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(made_from, sent, rate, min_chars)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for t, before in zip(batch.column(text), batch.column(leaks).to_pylist(), strict=True):
                best = {x["item_id"]: (x["distance"], x["end"]) for x in before}
                for i, d, e in matcher.leaks(t.as_py()):
                    best[i] = min((d, e), best.get(i, (d, e)))
                found.append([{"item_id": i, "distance": d, "end": e} for i, (d, e) in sorted(best.items())])
            yield batch.set_column(leaks, column, pa.array(found, kind))

    return docs.mapInArrow(run, docs.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, distance, end): a row per document and benchmark item that it holds, as with_leaks() finds them."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, "_leaks", **options)
    return found.select("doc_id", F.inline("_leaks"))
