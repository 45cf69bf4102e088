"""Reports over scored rows.

Every grouping sums per task before it shuffles, so a verdict that most rows
share costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.fixed_values import FAILED_VERDICT


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("target_real", "predicao").agg(F.count("*").alias("rows"))


def agreement_rate(scored: DataFrame) -> DataFrame:
    """Share of verdicts equal to the known outcome, and of fallback rows."""
    hit = (F.col("predicao") == F.col("target_real")).cast("int")
    totals = scored.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(hit), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(is_fallback().cast("int")), F.lit(0)).alias("fallbacks"),
    )
    share = lambda part: F.round(F.try_divide(part, "rows"), 6)
    return totals.select(
        "*", share("hits").alias("agreement"), share("fallbacks").alias("fallback_rate")
    )


def prediction_profile(scored: DataFrame, *attributes: str) -> DataFrame:
    """Verdict counts, alone or by attributes the scoring stage carried along."""
    return scored.groupBy(*attributes, "predicao").agg(F.count("*").alias("rows"))


def is_fallback() -> Column:
    return F.col("predicao") == FAILED_VERDICT


def backlog(raw: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Keys with more raw rows than scored ones, and how many are pending.

    Replays repeat keys, so rows are counted, not matched. Both sides go through
    one grouping: a key that holds a third of all rows is summed before the
    shuffle, and no join is needed.
    """
    arrived = raw.select(key, F.lit(1).alias("arrived"), F.lit(0).alias("done"))
    done = scored.select(key, F.lit(0).alias("arrived"), F.lit(1).alias("done"))
    counts = arrived.unionAll(done).groupBy(key).agg(F.sum("arrived").alias("raw_rows"), F.sum("done").alias("scored_rows"))
    pending = F.col("raw_rows") - F.col("scored_rows")
    return counts.withColumn("pending", pending).where("pending > 0")
