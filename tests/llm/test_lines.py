"""Line dedup against a plain version, over the cases a table may hold."""

import random
from collections import Counter, defaultdict

from verdictflow.llm import lines

SPACE = " \t\n\x0b\f\r"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_chars=1, min_documents=10):
    """(id, lines, dropped, kept) of each row; a row without an id is a document of its own."""
    documents = defaultdict(set)
    for n, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            documents[lowered(line.strip(SPACE))].add(("row", n) if i is None else i)
    common = {key for key, ids in documents.items() if len(key) >= min_chars and len(ids) >= min_documents}
    found = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [line for line in own if lowered(line.strip(SPACE)) not in common]
        found.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(found)


def check(spark, rows, **limits):
    given = spark.createDataFrame([(i, t, "h1", 7) for i, t in rows], "doc_id long, text string, lost string, place int")
    found = lines.drop_common_lines(given.repartition(3), **limits)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert Counter(map(tuple, found.collect())) == plain(rows, **limits)


def test_shared_lines_go_whatever_their_case_and_ends(spark):
    rows = [(i, f"own {i}\n  Shared LINE\t\n\nÀ {i % 2}\nshared line\x0b") for i in range(12)]
    check(spark, [*rows, (90, "shared line"), (91, "shared  line"), (92, "\n\n"), (93, ""), (94, None), (95, " shared line"), (96, "ÀB"), (97, "Àb\r\n")])


def test_nine_documents_are_not_enough(spark):
    check(spark, [(i, "nine\nand ten" if i < 9 else "and TEN ") for i in range(10)])


def test_a_document_counts_once_by_its_id(spark):
    often = [(1, "again\n" * 30)]
    repeated = [(7, "of one id\nx")] * 15 + [(8, "of one id")] * 3
    mixed = [(7, "mixed")] * 12 + [(i, "mixed") for i in range(20, 29)]
    check(spark, often + repeated + mixed)
    check(spark, [(7, "ten after all")] * 4 + [(i, "ten after all") for i in range(20, 29)])
    check(spark, [(None, "no ids\nat all")] * 10 + [(None, None)] * 11)


def test_limits_are_parameters(spark):
    rows = [(i, "ab\nabc\n") for i in range(3)]
    check(spark, rows, min_chars=3, min_documents=3)
    check(spark, rows, min_chars=0, min_documents=3)
    check(spark, rows, min_documents=4)


def test_long_texts_and_copies(spark):
    rng = random.Random(5)
    pool = [f"line {i}" for i in range(3000)]
    long = "\n".join(rng.choice(pool) for _ in range(60_000))
    check(spark, [(0, long), *[(i, "\n".join(pool[:5])) for i in range(1, 40)], *[(i, rng.choice(pool)) for i in range(40, 90)]])


def test_random_tables(spark):
    rng = random.Random(11)
    letters = ["a", "A", " ", "\t", "é", "\n", "\n", "b", "\r", "İ"]
    rows = [(rng.choice([None, *range(25)]), "".join(rng.choice(letters) for _ in range(rng.randrange(12)))) for _ in range(150)]
    check(spark, rows, min_documents=5)


def test_an_empty_table(spark):
    assert lines.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_and_no_sort_of_texts(spark):
    given = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = lines.drop_common_lines(given)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
