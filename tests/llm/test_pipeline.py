"""The pipeline stage by stage, against plain versions of what each decides."""

from collections import Counter

import pytest
from brute import near, sha, words
from pyspark.sql import functions as F

import corpus_pipeline
from verdictflow.llm import mixing, toxicity
from verdictflow.llm.common import table
from verdictflow.llm.queries import tokenizer


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before the first stage and after each."""
    docs = table(spark, sf_dir, "documents")
    # Rows that the given tables lack, with a column that an operator also uses.
    extra = [(9001, None, "en", None, 0), (9002, "", None, "src1", 0), (None, "no id", "en", "src2", 5), (9003, "NO ID", "en", "src2", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    found = [docs.persist()]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], sf_dir).persist())
    yield found
    for df in found:
        df.unpersist()


def test_stages_keep_the_columns(stages):
    assert all(df.dtypes == stages[0].dtypes for df in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near duplicates", "source mixing", "tokenizing"]


def test_toxic_documents_go(spark, sf_dir, stages):
    model = toxicity.learn(stages[0], table(spark, sf_dir, "labels"))
    expected = [(i, t) for i, t in rows_of(stages[0]) if model.probability(toxicity.scan(t or "", model)[0]) < 0.5]
    assert Counter(rows_of(stages[1])) == Counter(expected) and len(expected) < stages[0].count()


def test_one_of_equal_texts_stays(stages):
    groups = {}
    for i, t in rows_of(stages[1]):
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in t or ""), []).append(i)
    kept = [max((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert Counter(i for i, _ in rows_of(stages[2])) == Counter(kept)


def test_one_of_each_near_class_stays(stages):
    expected = [i for i, label, _ in near(rows_of(stages[2])) if i == label]
    assert Counter(i for i, _ in rows_of(stages[3])) == Counter(expected)


def test_rows_without_or_with_the_same_id_are_decided_one_by_one(spark, sf_dir):
    base = [f"w{i}" for i in range(300)]
    near_text, other, third = (" ".join([*base[:k], "x", *base[k:]]) for k in (290, 280, 270))
    alone = " ".join(f"v{i}" for i in range(300))
    rows = [(1, "one text"), (None, "ONE text"), (None, "lone"), (None, "lone"), (2, "twice"), (2, "twice"), (2, "TWICE")]
    rows += [(3, " ".join(base)), (3, alone), (None, near_text), (None, other), (4, third), (None, alone + " y"), (None, alone + " z"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], table(spark, sf_dir, "documents").schema)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir).persist()
    firsts = [(1, "one text"), (None, "lone"), (2, "TWICE")]
    assert Counter(rows_of(exact)) == Counter([*firsts, *rows[7:14], (None, None)])
    near_rows = Counter(rows_of(corpus_pipeline.drop_near_copies(spark, exact, sf_dir)))
    assert all(n == 1 for n in near_rows.values()) and near_rows.keys() >= {*firsts, (4, third), (None, None)}
    assert sum(len(words(t)) >= 300 for _, t in near_rows) == 2
    same = spark.createDataFrame([(5, "a " * 160, "en", "s", 0), (5, "b " * 160, "en", "s", 0), (None, "c " * 160, "en", "s", 0)], docs.schema)
    assert len(rows_of(corpus_pipeline.mix_sources(spark, same, sf_dir))) == 3
    exact.unpersist()


def test_documents_come_as_often_as_the_mix_takes_them(stages):
    mixed = mixing.mix(stages[3], mixing.cycled_weights(stages[3]))
    taken = {r.doc_id: (r.taken, r["size"], r.copies) for r in mixed.withColumn("copies", mixing.copies(mixed)).collect()}
    got = Counter(i for i, _ in rows_of(stages[4]))
    assert got == Counter({i: c for i, (_, _, c) in taken.items() if c})
    for t, size, c in taken.values():
        assert 0 <= c <= 3 and (abs(c - t / size) < 1 if size else c == 0)
    size = {i: len(words(t)) for i, t in rows_of(stages[3])}
    assert sum(size[i] * n for i, n in got.items()) == pytest.approx(sum(t for t, _, _ in taken.values()), rel=0.25)


def test_tokens_decode_to_the_texts(stages):
    import tiktoken

    ranks, pattern = tokenizer()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((i, len(known.encode_ordinary(t or "")), sha(t or "")) for i, t in rows_of(stages[4]))
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages[5].collect()) == expected


def test_columns_of_any_name_and_a_very_long_text_go_through(spark, sf_dir):
    names = ["sha", "score", "node", "copies", "copy", "rows", "row", "shared_id", "a.b", "decided_node", "passages"]
    given = table(spark, sf_dir, "documents").filter("doc_id < 150")
    long = spark.createDataFrame([(70_000, "word " * 500_000, "en", "s", 0)], given.schema)
    given = given.unionByName(long)
    docs = given.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    bare = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept, docs = docs, stage(spark, docs, sf_dir).persist()
        bare = stage(spark, bare, sf_dir).persist()
        assert docs.dtypes == kept.dtypes
        assert Counter(rows_of(docs)) == Counter(rows_of(bare))
        assert docs.select(*[F.count_if(F.col(f"`{n}`") != F.concat(F.lit(f"{n} "), "doc_id")) for n in names]).first() == (0,) * len(names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_no_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_run_is_all_stages(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() > 0
    assert corpus_pipeline.QUERIES == {"pipeline": corpus_pipeline.run} and corpus_pipeline.ORACLE_SQL is None
