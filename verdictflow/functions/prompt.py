"""What the model is sent, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictflow.fixed_values import PROMPT
from verdictflow.functions.jsontext import json_record, json_text


def prompt(profile: Column) -> Column:
    return F.concat(F.lit(PROMPT), profile)


def request(profile: Column, model_name: str | None) -> Column:
    """The request record for the prompt of a profile.

    The fixed part of the prompt is quoted once, here, and not again per row.
    """
    fixed = json.dumps(PROMPT, ensure_ascii=False).removesuffix('"')
    prompt_text = F.concat(F.lit(fixed), F.substr(json_text(profile), F.lit(2)))
    return json_record(
        {
            "model": F.lit(json.dumps(model_name, ensure_ascii=False)),
            "prompt": prompt_text,
            "format": F.lit('"json"'),
            "stream": F.lit("false"),
        }
    )
