"""The operators' SQL against the operators, on rows with copies, near copies, nulls, empty and long texts."""

import duckdb

from maxfold.llm import exactdup, neardup

from .helpers import corpus, documents
from .test_operators import near_rows


def duck_rows(sql, rows):
    duck = duckdb.connect()
    duck.sql("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", [list(r[:2]) for r in rows])
    return sorted(duck.sql(sql).fetchall(), key=str)


def test_repeats(spark):
    rows = [*corpus(), (300, "ab" * 400), (301, "ba" * 300), (302, "x" * 99), (303, "x" * 100), (304, "x" * 101)]
    got = exactdup.find_repeats(documents(spark, rows)).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_sha256"]).hex()) for r in got]
    assert sorted(got, key=str) == duck_rows(exactdup.REPEATS_SQL, rows)


def test_near_duplicates(spark):
    rows = [*near_rows(), (None, "a b c"), (1200, "one two THREE"), (1201, "one two three"), (1202, "one two")]
    got = neardup.near_duplicates(documents(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["class_id"]) for r in got], key=str) == duck_rows(neardup.NEAR_SQL, rows)
