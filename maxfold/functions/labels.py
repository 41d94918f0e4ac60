"""Demonstration corpus, its queries and labels, and category rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shared corpus; a text's place is its doc_id.
SHARED = (
    "The river bank was slippery after the spring flood receded.",
    "She opened a savings account at the bank downtown.",
    "The logging truck carried a full trunk of oak timber.",
    "He packed his winter clothes into the car trunk before the road trip.",
    "The surgeon operated on the nerve trunk in the patient's lower back.",
    "The hiking trail runs along the left bank of the Colorado River.",
    "Interest rates at the central bank rose sharply this quarter.",
    "The elephant wrapped its trunk around the tree to pull it down.",
    "She wore a light cotton dress on the warm summer afternoon.",
    "The physics lab measured the speed of light using interferometry.",
    "The crane operator lowered the steel beam with precision.",
    "The paper crane origami requires 25 precise folds.",
    "Venture capital firms invested heavily in financial technology startups.",
    "The geological fault line runs beneath the river delta.",
    "He pitched the tent on the flat bank beside the stream.",
    "The investment bank underwrote the government bond issuance.",
    "The trunk road connects the capital city to the northern province.",
    "Scientists detected gravitational waves using laser light pulses.",
    "A flock of cranes migrated south along the river valley.",
    "The reserve bank adjusted monetary policy after the inflation report.",
)
#: A query for each document of the shared corpus; a query's place is the id of its first result.
VERIFY = (
    "river erosion along the bank",
    "open a checking account at the bank",
    "lumber loaded on a logging truck",
    "packing luggage into the car before travel",
    "neural trunk anatomy in spinal surgery",
    "hiking trail beside a river",
    "central bank interest rate decision",
    "elephant using its trunk",
    "summer fashion lightweight clothing",
    "speed of light measurement experiment",
    "construction crane lifting steel",
    "paper folding origami bird",
    "fintech startup venture funding",
    "geological fault beneath river delta",
    "tent camping beside a stream",
    "bond underwriting investment banking",
    "arterial road connecting cities",
    "laser light pulse experiment",
    "bird migration along river valley",
    "monetary policy inflation central bank",
)
#: Demonstration queries, what is relevant to them, and its documents.
RELEVANT = (
    ("river erosion along the bank", "river / waterway / outdoor", (0, 5, 14, 13, 18)),
    ("open a checking account at the bank", "financial institution / banking", (1, 6, 15, 19, 12)),
    ("bank interest rate", "financial institution / banking", (6, 19, 15, 1, 12)),
    ("river bank hiking", "river / waterway / outdoor", (0, 5, 14, 13, 18)),
)
#: Judged queries over a corpus of 100 texts, and the category that each asks for.
JUDGED = (
    ("river erosion along the bank", 0),
    ("open a checking account at the bank", 1),
    ("central bank interest rate monetary policy", 1),
    ("hiking trail beside the river valley", 0),
    ("construction crane lifting heavy steel beam", 2),
    ("migratory crane birds wetland habitat", 3),
    ("elephant trunk muscular grasping", 4),
    ("car trunk vehicle storage compartment", 5),
    ("speed of light optics physics experiment", 6),
    ("summer lightweight fashion dress fabric", 7),
)
#: The last id of each category of that corpus; further ids are of the last one.
CATEGORY_ENDS = (19, 39, 49, 59, 64, 69, 79, 89, 94)
#: Cumulative shares of the topics of a synthetic corpus.
TOPIC_BREAKS = (0.30, 0.60, 0.73, 0.87, 1.00)


def shared_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SHARED)), "doc_id long, text string")


def verify_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(VERIFY)], "qid long, text string, expected long")


def relevance(spark: SparkSession) -> DataFrame:
    """(query, label, doc_id) of the demonstration queries."""
    return spark.createDataFrame([(q, label, d) for q, label, ids in RELEVANT for d in ids], "query string, label string, doc_id long")


def judged_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(JUDGED)], "qid long, text string, category int")


def category_of(doc_id: Column) -> Column:
    """The category of an id, by ranges of ids."""
    out = None
    for i, end in enumerate(CATEGORY_ENDS):
        out = F.when(doc_id <= end, i) if out is None else out.when(doc_id <= end, i)
    return out.otherwise(len(CATEGORY_ENDS))


def topic_of(u: Column, breaks: tuple[float, ...] = TOPIC_BREAKS) -> Column:
    """The first topic whose cumulative share exceeds ``u``, else the last."""
    out = None
    for i, b in enumerate(breaks):
        out = F.when(u < b, i) if out is None else out.when(u < b, i)
    return out.otherwise(len(breaks) - 1)


def heuristic_labels(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id): documents of a query's category are relevant; docs (doc_id, category), queries (qid, category)."""
    return queries.select("qid", "category").join(docs.select("doc_id", "category"), "category").select("qid", "doc_id")


def with_texts(results: DataFrame, docs: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Results with their text, and whether they are relevant (false without truths); a document that is gone has no text."""
    out = results.join(docs.select("doc_id", "text"), "doc_id", "left")
    if truth is None:
        return out.withColumn("relevant", F.lit(False))
    marked = truth.select("qid", "doc_id").distinct().withColumn("_t", F.lit(True))
    return out.join(marked, ["qid", "doc_id"], "left").withColumn("relevant", F.coalesce("_t", F.lit(False))).drop("_t")


def document(docs: DataFrame, doc_id: int) -> str | None:
    """One document's text, by a filter that reaches the scan."""
    row = docs.where(F.col("doc_id") == doc_id).select("text").first()
    return row["text"] if row else None
