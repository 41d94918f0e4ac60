"""Scenario files: a corpus and steps that index, query, inspect and trace it."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import shared_corpus
from .engine import Engine

OPS = ("index", "query", "inspect", "trace")


def load(text: str) -> dict:
    """Parse and check a scenario; its meta.version is 1."""
    s = tomllib.loads(text)
    if s.get("meta", {}).get("version") != 1:
        raise ValueError("a scenario needs meta.version = 1")
    for step in s.get("steps", []):
        if step.get("op") not in OPS:
            raise ValueError(f"unknown step {step.get('op')}")
    return s


def corpus(spark: SparkSession, definition: dict, shared: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): 'shared' (the demonstration corpus, unless the caller gives another), 'inline' (docs listed) or 'file' (one text a line, or id TAB text)."""
    kind = definition.get("type", "shared")
    if kind == "shared":
        return shared_corpus(spark) if shared is None else shared
    if kind == "inline":
        docs = [(i, d) if isinstance(d, str) else (d["id"], d["text"]) for i, d in enumerate(definition["docs"])]
        return spark.createDataFrame(docs, "doc_id long, text string")
    if kind == "file":
        lines = [r["value"] for r in spark.read.text(definition["path"]).toLocalIterator()]  # a demonstration corpus
        rows = [(int(x.split("\t", 1)[0]), x.split("\t", 1)[1]) if "\t" in x else (i, x) for i, x in enumerate(lines)]
        return spark.createDataFrame(rows, "doc_id long, text string")
    raise ValueError(f"unknown corpus {kind}")


def run(spark: SparkSession, text: str, *, shared: DataFrame | None = None, dry_run: bool = False, k: int = 10) -> list[tuple[str, DataFrame | None]]:
    """The result of each step, in order: (op, table or None). The last argument of a query may be its k."""
    s = load(text)
    docs, out = corpus(spark, s.get("corpus", {}), shared), []
    engines: dict[str, Engine] = {}
    for step in s.get("steps", []):
        args = [str(a) for a in step.get("args", [])]
        if dry_run:
            out.append((step["op"], None))
            continue
        name = step.get("engine_override") or s["meta"]["engine"]
        engine = engines.setdefault(name, Engine(spark, name))
        if step["op"] == "index":
            picked = docs if not args or args[0] == "all" else docs.where(docs.doc_id.isin([int(a) for a in args]))
            engine.index(picked)
            out.append(("index", None))
        elif step["op"] == "query":
            n = int(args.pop()) if len(args) > 1 and args[-1].isdigit() else k
            out.append(("query", engine.query(" ".join(args), n)))
        elif step["op"] == "inspect":
            out.append(("inspect", engine.inspect(args[0])))
        else:
            out.append(("trace", engine.trace_table(*args)))
    return out


def command(engine: Engine, line: str, next_id: int | None = None) -> DataFrame | str | None:
    """One line of an interactive session: index TEXT, query TEXT, inspect TARGET, trace [STAGE], help, quit.

    An indexed text gets the id after the largest one, unless ``next_id`` is given.
    """
    op, _, rest = line.strip().partition(" ")
    if op == "index":
        if next_id is None:
            most = engine.docs.agg(F.max("doc_id")).first()[0] if engine.docs is not None else None
            next_id = 0 if most is None else most + 1
        engine.index(engine.spark.createDataFrame([(next_id, rest)], "doc_id long, text string"))
        return None
    if op == "query":
        return engine.query(rest)
    if op == "inspect":
        return engine.inspect(rest)
    if op == "trace":
        return engine.trace_table(*rest.split())
    return "index TEXT | query TEXT | inspect TARGET | trace [STAGE] | help | quit" if op in ("help", "") else None
