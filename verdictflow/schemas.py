"""Schemas of the file, the two message streams and the table.

Ids are BIGINT: a row number over a large replay passes 2**31 rows.
"""

from pyspark.sql import types as T

_FILE_NUMBERS = {1, 4, 7, 10, 12, 15, 17, 20}

APPLICATION_FILE_SCHEMA = T.StructType(
    [
        T.StructField(f"_c{i}", T.IntegerType() if i in _FILE_NUMBERS else T.StringType())
        for i in range(21)
    ]
)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("id_cliente", T.LongType()),
        T.StructField("status_conta_corrente", T.StringType()),
        T.StructField("duracao_credito_meses", T.IntegerType()),
        T.StructField("historico_credito", T.StringType()),
        T.StructField("proposito_emprestimo", T.StringType()),
        T.StructField("valor_credito_solicitado", T.IntegerType()),
        T.StructField("target_real", T.IntegerType()),
    ]
)

SCORED_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("id_cliente", T.LongType()),
        T.StructField("target_real", T.IntegerType()),
        T.StructField("predicao", T.IntegerType()),
        T.StructField("justificativa", T.StringType()),
    ]
)

SCORED_SCHEMA = T.StructType([*SCORED_TABLE_SCHEMA, T.StructField("modelo", T.StringType())])
