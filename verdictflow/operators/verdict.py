"""Model replies to verdicts: every reply, error or timeout becomes one row."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictflow.fixed_values import (
    ERROR_TEXT,
    FAILED_VERDICT,
    INVALID_VERDICT_TEXT,
    VALID_VERDICTS,
)
from verdictflow.functions.once import once

VERDICT_SCHEMA = "predicao int, justificativa string"


def verdict_of(reply: str | Exception) -> tuple[int, str]:
    """Verdict and reason of one reply, or of the error raised instead of it.

    ``true`` and ``1.0`` equal 1 and count as it; the text ``"1"`` does not.
    """
    try:
        if isinstance(reply, Exception):
            raise reply
        answer = json.loads(json.loads(reply)["response"])
        choice, reason = answer.get("predicao"), str(answer.get("justificativa", ""))
        if choice in VALID_VERDICTS:
            return int(choice), _storable(reason)
        return FAILED_VERDICT, _storable(INVALID_VERDICT_TEXT.format(choice))
    except Exception as error:
        return FAILED_VERDICT, _storable(ERROR_TEXT.format(type(error).__name__, error))


def _storable(text: str) -> str:
    """A reply may hold half of a surrogate pair, which UTF-8 cannot."""
    return text.encode("utf-8", "replace").decode("utf-8")


def verdict_columns(replies: list[str | Exception]) -> list[pa.Array]:
    verdicts = [verdict_of(r) for r in replies]
    return [
        pa.array([choice for choice, _ in verdicts], pa.int32()),
        pa.array([reason for _, reason in verdicts], pa.string()),
    ]


# No reply ends with this; see _object.
_END = "3f6f0f7a-4d0c-4a75-9f0e-end-of-text"


def _listed(text: Column) -> Column:
    """A text before the mark, as a parsed list.

    The parser stops at the end of the first value; listed before a mark that has to be
    the next value, the text cannot go on after its object.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{_END}"]')))


def _object(listed: Column) -> Column:
    """The JSON object that the text was, else null."""
    whole = F.try_variant_get(listed, "$[1]", "string") == _END
    first = F.try_variant_get(listed, "$[0]", "variant")
    return F.when(whole & F.schema_of_variant(first).startswith("OBJECT"), first)


def _read(reply: Column) -> Column:
    """A reply and what it says, as text and kind of each field; envelope and answer are parsed once each."""

    def envelope(x: Column) -> Column:
        found = _object(x["listed"])
        return F.struct(x["reply"], found.isNotNull().alias("enveloped"), F.try_variant_get(found, "$.response", "variant").alias("response"))

    def response(x: Column) -> Column:
        said = F.when(F.schema_of_variant(x["response"]) == "STRING", F.try_variant_get(x["response"], "$", "string"))
        return F.struct(x["reply"], (x["enveloped"] & x["response"].isNull()).alias("empty"), _listed(said).alias("listed"))

    def answer(x: Column) -> Column:
        found = _object(x["listed"])
        fields = [F.try_variant_get(found, f"$.{name}", "variant") for name in ("predicao", "justificativa")]
        return F.struct(x["reply"], x["empty"], found.isNotNull().alias("answered"), *[f.alias(n) for f, n in zip(fields, ("one", "two"), strict=True)])

    def texts(x: Column) -> Column:
        kinds = [F.coalesce(F.schema_of_variant(x[n]), F.lit("ABSENT")).alias(f"{k}_kind") for n, k in (("one", "choice"), ("two", "reason"))]
        shown = [F.try_variant_get(x[n], "$", "string").alias(k) for n, k in (("one", "choice"), ("two", "reason"))]
        return F.struct(x["reply"], x["empty"], x["answered"], *kinds, *shown)

    parsed = once(reply, lambda r: F.struct(r.alias("reply"), _listed(r).alias("listed")))
    for then in (envelope, response, answer, texts):
        parsed = once(parsed, then)
    return parsed


def _told(x: Column) -> Column:
    """The verdict of what was read, where Spark writes it as Python would; else the reply itself."""
    # Half a surrogate pair is stored Python's way.
    plain = F.coalesce(~F.contains(F.lower(x["reply"]), F.lit("\\ud")), F.lit(False))
    simple = x["choice_kind"].isin("ABSENT", "VOID", "STRING", "BIGINT", "BOOLEAN") & x["reason_kind"].isin("ABSENT", "VOID", "STRING")
    native = plain & (x["empty"] | (x["answered"] & simple))
    number = F.when(x["choice_kind"] == "BIGINT", F.when(x["choice"].isin(*map(str, VALID_VERDICTS)), x["choice"].cast("int")))
    number = F.coalesce(number, F.when((x["choice_kind"] == "BOOLEAN") & (x["choice"] == "true"), 1), F.lit(FAILED_VERDICT))
    shown = F.when(x["choice_kind"] == "BOOLEAN", F.initcap(x["choice"])).otherwise(F.coalesce(x["choice"], F.lit("None")))
    why = F.coalesce(x["reason"], F.when(x["reason_kind"] == "ABSENT", "").otherwise("None"))
    text = F.when(number != FAILED_VERDICT, why).otherwise(F.concat(F.lit(INVALID_VERDICT_TEXT.format("")), shown))
    text = F.when(x["empty"], ERROR_TEXT.format("KeyError", "'response'")).otherwise(text)
    return F.struct(
        F.when(native, number).alias("predicao"), F.when(native, text).alias("justificativa"), F.when(~native, x["reply"]).alias("reply"), native.alias("known")
    )


def _completed(told: pa.Array) -> pa.Array:
    """The verdicts that columns gave, with Python's for the replies that they left open."""
    known, choices, reasons = (told.field(name) for name in ("known", "predicao", "justificativa"))
    if not pc.all(known, min_count=0).as_py():
        left = verdict_columns(told.field("reply").filter(pc.invert(known)).to_pylist())
        choices, reasons = (pc.replace_with_mask(c, pc.invert(known), x) for c, x in zip((choices, reasons), left, strict=True))
    return pa.StructArray.from_arrays([choices, reasons], ["predicao", "justificativa"])


def verdict(reply: Column) -> Column:
    """``struct<predicao, justificativa>`` of a reply column.

    Replies as they should be, with a verdict outside the set or without a response, are
    judged by columns, which parse envelope and answer once each. The texts of other errors
    are Python's own, and so is the way it writes numbers with fractions, lists and objects:
    of those replies, the text crosses to it; of the others, the finished verdict.
    """
    return F.arrow_udf(_completed, VERDICT_SCHEMA)(once(_read(reply), _told))
