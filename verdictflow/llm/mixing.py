"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

The budget of words is cut into equal blocks. Blocks go to sources by the highest
quotients target / (2k - 1), then from a source to its regions and from a region to its
shards, so that every shard has a whole number of blocks to give. A shard is a bounded
set of documents in a seeded order: their words form a line, cut into blocks, of which
the quota is chosen evenly from a seeded start, some several times. What a document
gives is what its part of the line has of chosen blocks, in closed form.

Of the highest quotients only those near the cut are listed, at most about three per
child, so work follows the number of children and not the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.llm.common import n_words, stored

BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
REGION_SHARDS = 1024


def apportion(children: DataFrame, parent: list[str], child: list[str], votes: str, seats: str, most: str) -> DataFrame:
    """``children`` with ``quota``: the ``seats`` of their parent dealt by highest quotients.

    No child gets more than ``most``. Ties go to the first child. The sums of rounding
    with two divisors that surely give too few and too many seats bound each quota.
    """
    own = Window.partitionBy(*parent)
    rows = children.select("*", F.count(F.lit(1)).over(own).alias("n"), F.sum(votes).over(own).alias("total"))

    def rounded(number: Column) -> Column:
        share = F.floor(F.col(votes) * number / F.col("total") + 0.5).cast("long")
        return F.when(F.col("total") > 0, F.least(F.col(most), share)).otherwise(F.lit(0).cast("long"))

    rows = rows.select("*", rounded(F.greatest(F.col(seats) - F.col("n"), F.lit(0))).alias("low"), rounded(F.col(seats) + F.col("n")).alias("high"))
    rows = rows.select("*", (F.col(seats) - F.sum("low").over(own)).alias("open"))
    asked = F.when(F.col("high") > F.col("low"), F.sequence(F.col("low") + 1, F.col("high")))
    tried = rows.select(*parent, *child, votes, "open", F.explode(asked).alias("seat"))
    order = own.orderBy((F.col(votes) / (2 * F.col("seat") - 1)).desc(), *child)
    won = tried.select("*", F.row_number().over(order).alias("place")).filter(F.col("place") <= F.col("open"))
    more = won.groupBy(*parent, *child).agg(F.count(F.lit(1)).alias("more"))
    keys = [*parent, *child]
    return rows.join(more, keys, "left").select(*children.columns, (F.col("low") + F.coalesce("more", F.lit(0))).alias("quota"))


def targets(sources: DataFrame, max_repeats: int) -> DataFrame:
    """``sources`` (source_key, source_size, weight) with ``target``: words by weight, to ``max_repeats`` times the size.

    The targets share the sum of all sizes. Filling up by level, a source is full where
    ``max_repeats`` x size is below its weight x the level; the level is the highest that
    an ordering of the sources by that ratio gives. One row per source: no data moves.
    """
    cap = max_repeats * F.col("source_size")
    everything = Window.partitionBy(F.lit(0))
    weighted = sources.select("*", F.when(F.col("weight") > 0, cap / F.col("weight")).alias("ratio"))
    before = everything.orderBy(F.col("ratio").asc_nulls_last(), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    room = weighted.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("words_left"),
        (F.sum(usable).over(everything) - F.coalesce(F.sum(usable).over(before), F.lit(0.0))).alias("weight_left"),
    )
    level = F.max(F.when(F.col("weight") > 0, F.col("words_left") / F.col("weight_left"))).over(everything)
    return room.select(*sources.columns, F.coalesce(F.least(cap.cast("double"), usable * level), F.lit(0.0)).alias("target"))


def cycled_weights(documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh ``weights`` in turn."""
    found = documents.groupBy("source").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    return found.select("source", F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights)).alias("weight"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _draw(*of: Column) -> Column:
    """A number below 2 ** 60 from text, the same on every run and engine."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in of])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    documents: DataFrame,
    weights: DataFrame,
    max_repeats: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``weights`` (source, weight) need not sum to one; a source that it lacks weighs 0 and
    gives nothing. ``taken`` counts the words the mix takes of the document, repeats
    included, at most ``max_repeats`` times its size. The result depends on the rows and
    ``seed`` only. Null texts have no words and null sources are one source. Repeated
    rows are documents of their own, interchangeable where id and size agree. Other
    columns are not read; an empty table gives no rows.
    """
    sized = documents.select("doc_id", "source", _key(F.col("source")).alias("source_key"), n_words(F.col("text")).alias("size"))
    sized = stored(sized, "mix-sizes")
    per_source = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    wanted = weights.select(_key(F.col("source")).alias("source_key"), F.col("weight").cast("double").alias("weight"))
    sources = targets(per_source.join(wanted, "source_key", "left").fillna(0.0, ["weight"]), max_repeats)

    blocks = lambda words: F.ceil(F.col(words) / block_words).cast("long")
    everything = Window.partitionBy("all")
    sources = sources.select("*", F.lit(0).alias("all"), (max_repeats * blocks("source_size")).alias("most"))
    # The targets share all words; summed as whole numbers, the order of the rows cannot matter.
    sources = sources.select("*", F.round(F.sum("source_size").over(everything) / block_words).cast("long").alias("seats"))
    sources = apportion(sources, ["all"], ["source_key"], "target", "seats", "most")
    sources = sources.select(
        "source_key", "source_size", "target", F.col("quota").alias("source_quota"),
        F.greatest(F.ceil(F.col("source_size") / shard_words).cast("long"), F.lit(1)).alias("shards"),
    )
    sources = stored(sources, "mix-sources")

    placed = sized.join(sources, "source_key").select(
        "doc_id", "source", "source_key", "size", "source_size", "target", "source_quota",
        F.pmod(_draw(F.lit(seed), F.col("doc_id")), F.col("shards")).alias("shard"),
        _draw(F.lit("order"), F.lit(seed), F.col("doc_id")).alias("draw"),
    )
    shards = placed.groupBy("source_key", "source_quota", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.select(
        "*", F.floor(F.col("shard") / REGION_SHARDS).alias("region"),
        (max_repeats * blocks("shard_size")).alias("most"), blocks("shard_size").alias("blocks"),
    )
    regions = shards.groupBy("source_key", "source_quota", "region").agg(F.sum("shard_size").alias("region_size"), F.sum("most").alias("most"))
    regions = apportion(regions, ["source_key"], ["region"], "region_size", "source_quota", "most")
    regions = regions.select("source_key", "region", F.col("quota").alias("region_quota"))
    shards = apportion(shards.join(regions, ["source_key", "region"]), ["source_key", "region"], ["shard"], "shard_size", "region_quota", "most")
    shards = stored(shards.select("source_key", "shard", "blocks", "quota"), "mix-shards")

    line = Window.partitionBy("source_key", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("*", F.coalesce(F.sum("size").over(line), F.lit(0)).alias("begin"))
    phase = _draw(F.lit("phase"), F.lit(seed), F.col("source_key"), F.col("shard")) % 997 / 997
    joined = placed.join(shards, ["source_key", "shard"]).select("*", phase.alias("phase"))
    taken = _up_to(F.col("begin") + F.col("size"), block_words) - _up_to(F.col("begin"), block_words)
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _up_to(words: Column, block_words: int) -> Column:
    """Words that the mix takes, with repeats, of the first ``words`` of a shard's line."""
    block = F.floor(words / block_words)
    rest = words - block * block_words
    extra = F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0)
    chosen = lambda j: F.floor(j * extra / F.greatest(F.col("blocks"), F.lit(1)) + F.col("phase"))
    whole = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)
    return words * whole + (chosen(block) - chosen(F.lit(0))) * block_words + (chosen(block + 1) - chosen(block)) * rest


def copies(mixed: DataFrame, seed: int = 0) -> Column:
    """How often a document goes into the mix whole: taken / size, rounded up by a seeded draw as often as its fraction."""
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0)
    draw = _draw(F.lit("copies"), F.lit(seed), F.col("doc_id")) % 1_000_003 / 1_000_003
    return (F.floor(share) + (share - F.floor(share) > draw).cast("int")).cast("int")
