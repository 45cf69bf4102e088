"""JSON message text, built from columns without leaving the JVM.

The text has one space after ``:`` and ``,``, keeps nulls and keeps non-ASCII
characters. ``to_json`` alone would drop nulls and write no spaces, and the text
is part of what the model is shown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_text(value: Column) -> Column:
    """JSON text of a string column."""
    return F.btrim(F.to_json(F.array(value)), F.lit("[]"))


def json_number(value: Column) -> Column:
    """JSON text of an integer column, or of one that holds JSON text."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_record(fields: dict[str, Column], spaces: bool = True) -> Column:
    """JSON object from field names and the JSON text of their values."""
    parts: list[Column] = []
    comma, colon = (", ", ": ") if spaces else (",", ":")
    for name, value in fields.items():
        parts += [F.lit(f'{comma if parts else "{"}"{name}"{colon}'), value]
    return F.concat(*parts, F.lit("}"))


def record_of(schema: T.StructType, row: Column | None = None, without: str | None = None, spaces: bool = True) -> Column:
    """JSON object of the string and integer fields of a schema, in its order.

    The fields are columns of their own, or fields of ``row``.
    """
    fields = {}
    for field in schema:
        if field.name != without:
            value = F.col(field.name) if row is None else row[field.name]
            as_json = json_text if isinstance(field.dataType, T.StringType) else json_number
            fields[field.name] = as_json(value)
    return json_record(fields, spaces)


def lower_hex(text: Column) -> Column:
    """Write control characters as ``\\u001f`` where Spark writes ``\\u001F``."""
    lowered = text
    for digit in "ABCDEF":
        # An even number of backslashes before it: a real escape, not quoted text.
        escape = rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}"
        lowered = F.regexp_replace(lowered, escape, rf"$1\\u00$2{digit.lower()}")
    return F.when(F.contains(text, F.lit("\\u00")), lowered).otherwise(text)
