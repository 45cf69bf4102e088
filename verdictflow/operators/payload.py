"""Coded file rows to readable messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.fixed_values import ACCOUNT_STATUS, CREDIT_HISTORY, LABEL_FIELD, LOAN_PURPOSE
from verdictflow.functions.decode import decode, whole_number
from verdictflow.functions.jsontext import lower_hex, record_of
from verdictflow.schemas import RAW_SCHEMA


def decode_applications(coded: DataFrame, id_column: str) -> DataFrame:
    """Pick the six used fields by position, decode them, put the id in front.

    The outcome is the last field, however many lie between.
    """
    status, months, history, purpose, amount, *_, outcome = (
        coded[c] for c in coded.columns if c != id_column
    )
    return coded.select(
        coded[id_column].cast("bigint").alias("id_cliente"),
        decode(status, ACCOUNT_STATUS).alias("status_conta_corrente"),
        whole_number(months, "duracao_credito_meses").alias("duracao_credito_meses"),
        decode(history, CREDIT_HISTORY).alias("historico_credito"),
        decode(purpose, LOAN_PURPOSE).alias("proposito_emprestimo"),
        whole_number(amount, "valor_credito_solicitado").alias("valor_credito_solicitado"),
        whole_number(outcome, "target_real").alias("target_real"),
    )


def raw_message() -> Column:
    """Message text of a decoded application."""
    return lower_hex(record_of(RAW_SCHEMA))


def profile() -> Column:
    """Message text of a decoded application without its outcome."""
    return lower_hex(record_of(RAW_SCHEMA, without=LABEL_FIELD))
