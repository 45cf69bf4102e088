"""Line dedup: a line that many documents share is dropped from every one of them.

Lines are exploded to the normalised text of each, their key, and a document counts once for
each of its keys, which are counted by 128-bit hash; two keys that share a hash, which no
corpus is expected to hold, would be counted as one. Hashes in too many documents are stored
and joined with the exploded lines again, which gives the positions that a text loses. Each
text meets its positions once and is put together from those it keeps. Numbers are all that
is shuffled but for that one meeting, and every count is summed per task before it moves, so
a line or a text that a third of all rows share costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.llm.common import let, stored

MIN_CHARS = 1
MIN_DOCUMENTS = 10
SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The keys of all lines of a text: without white space at their ends, lower-cased in A-Z; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # Pure ASCII texts take the JVM's fast way to lower case.
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)))


def _hashes(value: Column, one: str, two: str) -> list[Column]:
    return [F.xxhash64(value).alias(one), F.xxhash64(F.lit(1), value).alias(two)]


def _in_many(documents: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """(h1, h2) of the keys in ``min_documents`` documents or more."""
    ids = documents.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    ids = stored(ids.filter("rows > 1").select(F.col("id").alias("shared")), "line-shared-ids")
    marked = documents.join(ids, documents["id"] == ids["shared"], "left").select("shared", "text")
    keys = marked.select("shared", F.explode(F.array_distinct(line_keys(F.col("text")))).alias("key"))
    keys = keys.filter(F.char_length("key") >= min_chars).select("shared", *_hashes(F.col("key"), "h1", "h2"))
    # Rows of an id of their own are documents; those that share one are counted by it below.
    counts = keys.groupBy("h1", "h2").agg(
        F.count(F.when(F.col("shared").isNull(), 1)).alias("alone"), F.count("shared").alias("of_shared")
    )
    counts = stored(counts.filter(F.col("alone") + F.col("of_shared") >= min_documents), "line-counts")
    doubtful = counts.filter(F.col("alone") < min_documents).select("h1", "h2", "alone")
    again = keys.filter("shared is not null").join(doubtful, ["h1", "h2"]).select("h1", "h2", "alone", "shared").distinct()
    again = again.groupBy("h1", "h2", "alone").agg(F.count(F.lit(1)).alias("ids"))
    again = again.filter(F.col("alone") + F.col("ids") >= min_documents)
    sure = counts.filter(F.col("alone") >= min_documents).select("h1", "h2")
    return stored(sure.unionByName(again.select("h1", "h2")), "line-common")


def drop_common_lines(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """One row per input row: its id, ``n_lines`` (before), ``n_dropped`` and ``kept`` (the other lines).

    Lines end at ``\\n`` alone; a null or empty text is one empty line. A key of at least
    ``min_chars`` code points that is in at least ``min_documents`` documents loses all its
    lines, wherever they are; a text all of whose lines go becomes empty. Rows that repeat
    an id are one document, each row without an id is one of its own; all of them are
    returned, with the id as it is. A key twice in one document counts once. Nothing
    depends on an order, so there are no ties. Other columns are not read, and may have any
    name. Texts may be as long as a value can be: lines are kept or dropped in one pass
    over a text's positions. An empty table gives no rows.
    """
    documents = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    common = _in_many(documents, min_chars, min_documents)
    text = F.coalesce("text", F.lit(""))
    lines = documents.select(*_hashes(text, "t1", "t2"), F.posexplode(line_keys(F.col("text"))).alias("place", "key"))
    lines = lines.filter(F.char_length("key") >= min_chars).select("t1", "t2", "place", *_hashes(F.col("key"), "h1", "h2"))
    # Texts that are equal lose the same positions, so copies meet in one set.
    lost = lines.join(common, ["h1", "h2"]).groupBy("t1", "t2").agg(F.collect_set("place").alias("lost"))
    lost = stored(lost, "line-positions")
    rows = documents.select("id", text.alias("text"), *_hashes(text, "t1", "t2")).join(lost, ["t1", "t2"], "left")

    def of_lines(all_lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("lost"))
        return F.array_join(F.transform(kept, lambda place: F.get(all_lines, place)), "\n")

    return rows.select(
        F.col("id").alias(id_column),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), of_lines)).alias("kept"),
    )
