"""A corpus made ready for training: five stages over ``documents``, each an operator of verdictflow.llm.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents that go on, the last one their tokens. ``run`` applies them in order and stores
what each keeps, so that every stage starts from files and a lost executor costs no more
than its tasks. SQL cannot express the learned, sampled and tokenized stages.

Besides doc_id, text and source, documents may have columns of any names; the first four
stages hand them on. An empty table goes through all stages, and texts may be of any length.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm import exact, jaccard, mixing, toxicity
from verdictflow.llm.common import sorted_side, stored, table
from verdictflow.llm.queries import token_digests

ORACLE_SQL = None


#: The columns that the operators read; all others go by private names inside a stage.
READ = ("doc_id", "text", "source")


def _hidden(docs: DataFrame) -> DataFrame:
    """``docs`` with columns renamed that no operator reads, so that none can clash with what one adds."""
    return docs.toDF(*[c if c in READ else f"kept {i}" for i, c in enumerate(docs.columns)])


def _shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order and under their names."""
    return rows.select(*[F.col(f"`{h}`").alias(c) for h, c in zip(_hidden(docs).columns, docs.columns, strict=True)])


def _joined(docs: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` joined with decisions by ``keys``, where null is a value like any other."""
    named = decisions.withColumnsRenamed({k: f"decided_{k}" for k in keys})
    same = reduce(and_, [docs[k].eqNullSafe(named[f"decided_{k}"]) for k in keys])
    return docs.join(named, same).drop(*[f"decided_{k}" for k in keys])


def _one_of_each(docs: DataFrame, kept: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """``columns`` of one row of ``docs`` for each value of ``keys`` in ``kept``, which has a row per row that may stay.

    Only rows that repeat a key are grouped; the smallest of them stays.
    """
    columns = [f"`{c}`" for c in columns]
    counted = stored(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), f"pipeline-{name}-kept")
    once = _joined(docs, sorted_side(counted.filter("rows = 1")), keys).select(*columns)
    # Stored by itself, so that Spark measures it: where no row repeats, no text moves.
    repeated = stored(counted.filter("rows > 1"), f"pipeline-{name}-repeated")
    rows = _joined(docs, repeated, keys).groupBy(*keys).agg(F.min(F.struct(*columns)).alias("row"))
    return once.unionByName(rows.select("row.*"))


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``node``: the id where it is one row's own, else a number above 2^62 from id and text."""
    shared = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = stored(shared.select(F.col("doc_id").alias("shared_id")), f"pipeline-{name}-shared")
    own = F.col("doc_id").isNotNull() & F.col("shared_id").isNull()
    made = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    rows = docs.join(shared, docs["doc_id"] == shared["shared_id"], "left")
    return rows.select(*[f"`{c}`" for c in docs.columns], F.when(own, F.col("doc_id")).otherwise(made).alias("node"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer does not reject."""
    rows = _hidden(docs)
    model = toxicity.learn(rows, table(spark, sf_dir, "labels"))
    return _shown(toxicity.score(rows, model, carry=tuple(rows.columns)).filter("score < 0.5"), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the largest id; a row without an id where there is no other."""
    rows = _hidden(docs)
    kept = exact.exact_groups(rows).filter("kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    hashed = rows.withColumn("sha", F.unhex(F.sha2(exact.normalised(F.col("text")), 256)))
    return _shown(_one_of_each(hashed, kept, ["doc_id", "sha"], rows.columns, "exact"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row, that with the smallest id; rows that share an id or have none come last."""
    rows = _hidden(docs)
    numbered = _numbered(rows, "near")
    found = jaccard.near_duplicates(numbered.select(F.col("node").alias("doc_id"), "text"))
    kept = found.filter("doc_id = class_id").select(F.col("doc_id").alias("node"))
    return _shown(_one_of_each(numbered, kept, ["node"], rows.columns, "near"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sources weighing 1, 2, 3 in turn; rows count one by one."""
    rows = _hidden(docs)
    numbered = _numbered(rows, "mix")
    mixed = mixing.mix(numbered.select(F.col("node").alias("doc_id"), "source", "text"), mixing.cycled_weights(rows))
    taken = mixed.select(F.col("doc_id").alias("node"), mixing.copies(mixed).alias("copies")).filter("copies > 0")
    often = _joined(numbered, sorted_side(taken.groupBy("node").agg(F.max("copies").alias("copies"))), ["node"])
    return _shown(often.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, decoded again."""
    return token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near duplicates", drop_near_copies),
    ("source mixing", mix_sources),
    ("tokenizing", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents under ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
