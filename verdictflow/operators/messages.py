"""Messages of any shape: what the model may see, and what it may not."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.fixed_values import ABSENT_FIELD, ID_FIELD, LABEL_FIELD
from verdictflow.functions.jsontext import json_text, lower_hex, record_of
from verdictflow.schemas import RAW_SCHEMA, SCORED_SCHEMA, SCORED_TABLE_SCHEMA


def parse_messages(messages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Split each message into id, outcome and the profile shown to the model.

    Messages may have any fields, in any order, and the profile keeps both. Id and
    outcome may be of any type: they come as JSON text, a JSON null as null, and go
    into the scored message as they are; only a table casts them. A text that is no
    JSON object fails the job; ``split_malformed`` sets such texts aside first.

    Most messages have the known fields. Those read under the known schema, and are
    recognised by writing them again, with spaces or compactly: if that gives the same
    text, the known fields are all there is. Only the others take the long way.
    """
    read = read_messages(messages, carry, fail=True)
    return read.drop("reason")


def read_messages(messages: DataFrame, carry: tuple[str, ...] = (), fail: bool = False) -> DataFrame:
    """What ``parse_messages`` gives, with ``reason``: null, or why a text is no message, whose fields are null then.

    Both kinds come from one parse. With ``fail``, such a text fails the job.
    """
    value, known = F.col("value"), F.col("known")
    names_known = reduce(and_, (value.contains(f'"{name}":') for name in RAW_SCHEMA.fieldNames()))
    as_known = messages.select(*carry, "value", F.when(names_known, F.from_json("value", RAW_SCHEMA)).alias("known"))
    spaced, compact = (record_of(RAW_SCHEMA, known, spaces=spaces).eqNullSafe(value) for spaces in (True, False))
    same = known.isNotNull() & F.when(value.startswith(f'{{"{ID_FIELD}": '), spaced).otherwise(compact)
    checked = as_known.select(*carry, "value", "known", same.alias("same"))

    as_maps = lambda kind: F.when(~F.col("same"), _objects(kind))
    opened = checked.select(
        *carry, "value", "known", "same", as_maps("variant").alias("fields"), as_maps("string").alias("texts")
    )
    no_object = F.concat(F.lit("message is not a JSON object: "), F.coalesce(value, F.lit("NULL")))
    is_one = F.col("same") | _is_one("fields")
    one = F.when(is_one, F.get("fields", F.lit(0)))
    one = one.otherwise(F.raise_error(no_object)) if fail else one
    reason = F.lit(None).cast("string") if fail else F.when(~is_one, no_object)
    opened = opened.select(*carry, "known", "same", reason.alias("reason"), one.alias("fields"), F.when(is_one, F.get("texts", F.lit(0))).alias("texts"))
    opened = opened.withColumn("names", F.array_distinct(F.map_keys("fields")))
    opened = opened.withColumns({name: _last_of_each(name) for name in ("fields", "texts")})

    # Arrays side by side: a map looked up in the lambda would be made per member.
    opened = opened.withColumns({"values": F.map_values("fields"), "plain": F.map_values("texts")})
    members = F.arrays_zip("names", "values", "plain")
    shown = F.filter(members, lambda member: member["names"] != LABEL_FIELD)
    open_profile = F.concat(F.lit("{"), F.array_join(F.transform(shown, _member_text), ", "), F.lit("}"))
    split = opened.select(
        *carry,
        *[_either(known[name], members, name) for name in (ID_FIELD, LABEL_FIELD)],
        F.when(F.col("same"), record_of(RAW_SCHEMA, known, without=LABEL_FIELD)).otherwise(open_profile).alias("perfil"),
        "reason",
    )
    return split.withColumn("perfil", lower_hex(F.col("perfil")))


def _objects(kind: str) -> Column:
    """The objects of a text, null if it is malformed.

    The parser stops at the end of the first value it reads; in brackets, that is
    the end of the text.
    """
    listed = F.concat(F.lit("["), "value", F.lit("]"))
    return F.from_json(listed, f"array<map<string,{kind}>>", {"allowSingleQuotes": "false"})


def _is_one(objects: str) -> Column:
    """Whether a text was one object, and no bracket of its own ended the list."""
    closed = F.rtrim("value", F.lit(" \t\r\n")).endswith("}")
    return F.coalesce(closed & (F.size(objects) == 1) & F.get(objects, 0).isNotNull(), F.lit(False))


def _last_of_each(members: str) -> Column:
    """A repeated name keeps its first place and its last value."""
    of_name = lambda name: F.filter(F.map_entries(members), lambda e: e["key"] == name)
    last = F.transform("names", lambda name: F.element_at(of_name(name), -1)["value"])
    repeated = F.size("names") < F.size(members)
    return F.when(repeated, F.map_from_arrays("names", last)).otherwise(F.col(members))


def _member_text(member: Column) -> Column:
    """A member with its name, on one line."""
    return F.concat(json_text(member["names"]), F.lit(": "), _value_text(member))


def _value_text(member: Column) -> Column:
    """JSON text of a member's value: quoted if it was, else as it was."""
    quoted = F.schema_of_variant(member["values"]) == "STRING"
    return F.when(quoted, json_text(member["plain"])).otherwise(F.coalesce(member["plain"], F.lit("null")))


def _either(known: Column, members: Column, name: str) -> Column:
    """JSON text of a field; only an absent one gets the default, a null stays null."""
    own = F.transform(F.filter(members, lambda member: member["names"] == name), _value_text)
    text = F.when(F.size(own) == 0, F.lit(str(ABSENT_FIELD))).otherwise(F.nullif(F.get(own, F.lit(0)), F.lit("null")))
    return F.when(F.col("same"), known.cast("string")).otherwise(text).alias(name)


def message_ids(messages: DataFrame) -> DataFrame:
    """The ids of messages alone, as text without quotes; -1 for an absent one."""
    own, names = F.get_json_object("value", f"$.{ID_FIELD}"), F.json_object_keys("value")
    no_object = F.raise_error(F.concat(F.lit("message is not a JSON object: "), F.coalesce("value", F.lit("NULL")))).cast("string")
    absent = F.when(names.isNull(), no_object).when(~F.array_contains(names, ID_FIELD), F.lit(str(ABSENT_FIELD)))
    return messages.select(F.when(own.isNotNull(), own).otherwise(absent).alias(ID_FIELD))


def split_malformed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opt-in: messages that are JSON objects, and the ones that are not."""
    parsed = messages.withColumn("objects", _objects("variant"))
    one = _is_one("objects")
    return parsed.where(one).drop("objects"), parsed.where(~one).drop("objects")


def read_quarantine(messages: DataFrame) -> DataFrame:
    """Texts that were set aside, and why."""
    return messages.select(F.from_json("value", "message string, reason string", {"mode": "FAILFAST"}).alias("row")).select("row.*")


def scored_message() -> Column:
    """Message text of a scored row."""
    return lower_hex(record_of(SCORED_SCHEMA))


def read_scored(messages: DataFrame) -> DataFrame:
    """Scored messages under the table's narrower schema; other fields are ignored."""
    row = F.from_json("value", SCORED_TABLE_SCHEMA, {"mode": "FAILFAST"})
    return messages.select(row.alias("row")).select("row.*")
