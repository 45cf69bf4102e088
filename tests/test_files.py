import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.operators import row_id
from verdictflow.operators.payload import decode_applications, profile, raw_message
from verdictflow.operators.row_id import number_rows, unique_row_ids
from verdictflow.plans.applications import coded_applications
from verdictflow.plans.steps import file_applications, replay
from verdictflow.schemas import APPLICATION_FILE_SCHEMA, RAW_SCHEMA
from verdictflow.sources.files import scan_applications, scan_or_reject
from verdictflow.sources.topics import FileTopic

FIRST = "A11 6 A34 A43 1169 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201 1"
SECOND = "A14 12 A30 A48 5951 A61 A73 2 A92 A101 2 A121 22 A143 A152 1 A173 1 A191 A201 2"


def write(folder, name, *lines):
    path = folder / name
    path.write_text("".join(line + "\n" for line in lines))
    return str(path)


def test_first_row_as_message(spark, tmp_path):
    rows = file_applications(spark, write(tmp_path, "a", FIRST, SECOND))
    assert rows.schema.fieldNames() == RAW_SCHEMA.fieldNames()
    first, second = (r[0] for r in rows.select(raw_message()).collect())
    assert first == (
        '{"id_cliente": 0, "status_conta_corrente": "< 0 DM (Saldo Negativo)", "duracao_credito_meses": 6, '
        '"historico_credito": "Conta crítica / Outros bancos", "proposito_emprestimo": "Rádio/Televisão", '
        '"valor_credito_solicitado": 1169, "target_real": 1}'
    )
    assert second == (
        '{"id_cliente": 1, "status_conta_corrente": "Sem conta corrente", "duracao_credito_meses": 12, '
        '"historico_credito": "Sem créditos", "proposito_emprestimo": "A48", '
        '"valor_credito_solicitado": 5951, "target_real": 2}'
    )
    assert rows.select(profile()).first()[0] == first.replace(', "target_real": 1', "")


def test_types_and_names(spark, tmp_path):
    scan = scan_applications(spark, write(tmp_path, "a", FIRST))
    assert scan.schema == APPLICATION_FILE_SCHEMA
    assert Counter(kind for _, kind in scan.dtypes) == {"string": 13, "int": 8}


def test_outcome_is_the_last_field_however_many_there_are(spark):
    rows = spark.createDataFrame([(9, "A11", 1, "A30", "A40", 5, "x", 2)], "id int, a string, b int, c string, d string, e int, f string, g int")
    row = decode_applications(rows, "id").first()
    assert (row.id_cliente, row.valor_credito_solicitado, row.target_real) == (9, 5, 2)


@pytest.mark.parametrize("bad", [FIRST.replace(" 6 ", " x "), FIRST.replace(" 1169 ", " 1.5 ")])
def test_value_that_does_not_fit_fails_the_job(spark, tmp_path, bad):
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        file_applications(spark, write(tmp_path, "a", FIRST, bad)).collect()


def test_missing_value_fails_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="no whole number in duracao_credito_meses"):
        file_applications(spark, write(tmp_path, "a", FIRST.replace(" 6 ", "  "))).collect()


def test_fractions_are_cut_off_under_a_schema_that_allows_them(spark, tmp_path):
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name == "_c4" else f for f in APPLICATION_FILE_SCHEMA])
    scan = scan_applications(spark, write(tmp_path, "a", FIRST.replace("1169", "1169.9")), schema)
    assert decode_applications(number_rows(scan), "row_id").first().valor_credito_solicitado == 1169


def test_replay_counts_and_repeats(spark, tmp_path):
    path, raw = write(tmp_path, "a", FIRST, SECOND), FileTopic(str(tmp_path / "raw"))
    assert [replay(spark, path, raw) for _ in range(2)] == [2, 2]
    messages = [r.value for r in raw.read(spark).collect()]
    assert len(messages) == 4 and len(set(messages)) == 2


def test_replay_without_a_file_sends_nothing(spark, tmp_path):
    raw = FileTopic(str(tmp_path / "raw"))
    assert replay(spark, str(tmp_path / "none"), raw) is None
    assert not os.path.exists(raw.path)


@pytest.fixture
def small_splits(spark):
    """Splits of about 1000 bytes, so that small files have many."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, ["1000", "100"]):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def numbered_files(spark, tmp_path, sizes):
    """Files of numbered lines, counted through in path order."""
    lines = iter(range(10**6))
    for i, size in enumerate(sizes):
        write(tmp_path, f"part-{i:03}", *(str(next(lines)) for _ in range(size)))
    return spark.read.schema("n bigint").csv(str(tmp_path))


def test_row_numbers_are_dense_and_in_file_order(spark, tmp_path, small_splits):
    scan = numbered_files(spark, tmp_path, [5, 2000, 0, 1, 700, 1500, 3])
    assert scan.rdd.getNumPartitions() > 10
    numbered = number_rows(scan)
    assert numbered.columns == ["row_id", "n"]
    assert numbered.count() == 4209
    assert numbered.where("row_id <> n").count() == 0


def test_blank_lines_are_no_rows(spark, tmp_path):
    rows = file_applications(spark, write(tmp_path, "a", FIRST, "", SECOND, "", ""))
    assert [r.id_cliente for r in rows.collect()] == [0, 1]


def test_empty_file(spark, tmp_path):
    assert file_applications(spark, write(tmp_path, "a")).collect() == []


def test_row_numbers_above_a_filter(spark, tmp_path, small_splits):
    numbered = number_rows(numbered_files(spark, tmp_path, [900, 300])).where("n % 7 = 0")
    assert [r.row_id for r in numbered.orderBy("n").collect()] == list(range(0, 1200, 7))


def test_other_splits_in_the_second_pass_fail_the_job(spark, tmp_path, small_splits):
    numbered = number_rows(numbered_files(spark, tmp_path, [2000]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    with pytest.raises(Exception, match="splits changed between the two passes"):
        numbered.collect()


def test_row_numbers_move_no_rows(spark, tmp_path):
    plan = number_rows(numbered_files(spark, tmp_path, [50]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan and "Sort" not in plan


def test_too_many_splits_are_refused(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(row_id, "MAX_SPLITS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        number_rows(numbered_files(spark, tmp_path, [2000]))


def test_the_number_of_splits_is_fixed_for_both_passes(spark, tmp_path):
    number_rows(numbered_files(spark, tmp_path, [50]))
    assert int(spark.conf.get("spark.sql.files.minPartitionNum")) == spark.sparkContext.defaultParallelism


def test_unique_numbers(spark, tmp_path, small_splits):
    ids = unique_row_ids(numbered_files(spark, tmp_path, [2000]))
    assert ids.select(F.countDistinct("row_id")).first()[0] == 2000


@pytest.mark.skipif("APPLICATIONS_FILE" not in os.environ, reason="names the public file of 1,000 applications")
def test_facts_of_the_public_file(spark):
    rows = file_applications(spark, os.environ["APPLICATIONS_FILE"])
    assert rows.groupBy("target_real").count().orderBy("target_real").collect() == [(1, 700), (2, 300)]
    months, amount = F.col("duracao_credito_meses"), F.col("valor_credito_solicitado")
    bounds = rows.select(F.min(months), F.max(months), F.min(amount), F.max(amount)).first()
    assert tuple(bounds) == (4, 72, 250, 18424)
    undecoded = rows.where("proposito_emprestimo = 'A48'").orderBy("id_cliente")
    assert [r.id_cliente for r in undecoded.collect()] == [157, 203, 215, 244, 463, 473, 579, 782, 856]
    statuses = {r.status_conta_corrente: r["count"] for r in rows.groupBy("status_conta_corrente").count().collect()}
    assert sorted(statuses.values()) == [63, 269, 274, 394]


# --- Lines that do not fit -------------------------------------------------------


def test_every_line_is_a_row_or_is_rejected_with_the_reason(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("m", T.LongType())])
    (tmp_path / "one.data").write_text("x 1 2\ny 1\nz q 3\n\nw 3000000000 5\n")
    (tmp_path / "two.data").write_text("v  9\nu 1 2 3\nt 4 1.5\ns -1 9000000000\n")
    good, rejected = scan_or_reject(spark, str(tmp_path), schema)
    assert sorted(tuple(r) for r in good.collect()) == [(0, "x", 1, 2), (4, "v", None, 9), (7, "s", -1, 9000000000)]
    found = sorted((r.row_id, r.file.rpartition("/")[2], r.line, r.reason) for r in rejected.collect())
    assert found == [
        (1, "one.data", "y 1", "not 3 fields"),
        (2, "one.data", "z q 3", "no int in n: q"),
        (3, "one.data", "w 3000000000 5", "no int in n: 3000000000"),
        (5, "two.data", "u 1 2 3", "not 3 fields"),
        (6, "two.data", "t 4 1.5", "no bigint in m: 1.5"),
    ]


def test_a_file_without_faults_scans_alike(spark, sf_dir, tmp_path):
    coded = coded_applications(spark, sf_dir).withColumn("_c4", F.col("_c4").cast("int")).drop("o_orderkey")
    coded.write.csv(str(tmp_path / "f"), sep=" ")
    good, rejected = scan_or_reject(spark, str(tmp_path / "f"))
    strict = scan_applications(spark, str(tmp_path / "f"))
    assert rejected.isEmpty() and good.drop("row_id").exceptAll(strict).isEmpty() and good.count() == strict.count()
