"""Chat formatting by cumulative-snapshot collapse, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: What would read as a control mark within a text: one more backslash goes in front of its name, which decoding takes off.
MARK, ESCAPED = r"<\|(\\*)im_", r"<|$1\\im_"


def escape(text: Column) -> Column:
    """``text`` without control marks: <|im_end|> becomes <|\\im_end|>, <|\\im_end|> becomes <|\\\\im_end|>."""
    return F.regexp_replace(text, MARK, ESCAPED)


def turns_with_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, h, line): each turn with its place, its conversation's length, and the rolling hash of turns 1 to k.

    The rolling hash is the exclusive or of 120 bits of each turn's MD5, which covers its place: a running window, so
    long conversations cost in proportion to their length.
    """
    known = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").repartition("conv_id").distinct()
    inside = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda c: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.md5(c.cast("binary"))))
    d = known.withColumn("k", F.row_number().over(inside).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    d = d.withColumn("_m", F.md5(F.concat(F.col("k").cast("string"), mark(F.col("role")), mark(F.col("text"))).cast("binary")))
    half = lambda at: F.bit_xor(F.conv(F.substring("_m", at, 15), 16, 10).cast("long")).over(so_far)
    role = F.regexp_replace(escape(F.coalesce("role", F.lit("user"))), r"[\r\n]", " ")
    line = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit("<|im_end|>\n"))
    return d.select("conv_id", "k", "n", F.struct(half(1).alias("a"), half(17).alias("b")).alias("h"), line.alias("line"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: (conv_id, n_turns, n_logged, rendered).

    A logged conversation that equals the first turns of a longer one is dropped by an anti-join of its last
    rolling hash against the distinct proper-prefix hashes; of equal ones the smallest conv_id stays, and n_logged
    says how many there were. Turns compare by role and text. Only conversations that stay are rendered.

    Turns are ordered by (turn, role, text), nulls first; repeated rows count once. Rows with a null conv_id take no
    part. A null role differs from an empty one but renders as "user"; a null text renders empty; control marks within a
    role or text are escaped, and line breaks in a role become spaces. An empty table gives no rows; other columns are
    ignored.
    """
    t = materialize(turns_with_prefixes(turns), "chat")
    proper = t.where("k < n").select("k", "h").distinct()
    kept = t.where("k = n").groupBy("k", "h").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged")).join(proper, ["k", "h"], "left_anti")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    rendered = t.join(kept.select("conv_id", "n_logged"), "conv_id").groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("n_logged").alias("n_logged"), F.array_join(lines, "").alias("rendered"))
    return rendered.select("conv_id", "n_turns", "n_logged", "rendered")


CHAT_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
        count(*) OVER (PARTITION BY conv_id) AS n,
        coalesce('1' || md5(role), '0') || coalesce('1' || md5(text), '0') AS e FROM t),
p AS (SELECT conv_id, k, n, string_agg(e, ',') OVER (PARTITION BY conv_id ORDER BY k) AS pre FROM o),
r AS (SELECT conv_id, string_agg('<|im_start|>' || regexp_replace(regexp_replace(coalesce(role, 'user'), '<\|(\\*)im_', '<|\1\\im_', 'g'), '[\r\n]', ' ', 'g') || chr(10)
        || regexp_replace(coalesce(text, ''), '<\|(\\*)im_', '<|\1\\im_', 'g') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered FROM o GROUP BY conv_id),
f AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS n_logged, max(n) AS n_turns FROM p WHERE k = n GROUP BY pre)
SELECT f.conv_id, n_turns, n_logged, rendered FROM f JOIN r USING (conv_id)
WHERE pre NOT IN (SELECT pre FROM p WHERE k < n)
"""
