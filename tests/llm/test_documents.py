"""Operators over documents, against plain versions, with the cases that tables hold."""

import os
import random
import sys
from collections import defaultdict

import numpy as np
import pytest
from brute import base_spans, near, repeat_words, sha, substrings, words
from pyspark.sql import functions as F

from verdictflow.llm import bpe, exact, jaccard, mixing, pii, quality, substrings as repeats, toxicity
from verdictflow.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, source string, size long, kept string, score string, n_words int"


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{int(rng.expovariate(8 / vocabulary))}" for _ in range(n))


@pytest.fixture(scope="module")
def rows(rng):
    """Nulls, empty and very long texts, copies, near copies, shared passages, junk."""
    passage, long = prose(rng, 30), prose(rng, 40_000)
    base = prose(rng, 300).split()
    texts = [None, "", " \t\n\x0b\f\r ", "one", "a b c d e f", "A B c d e f", long, long + " x", long]
    texts += [" ".join(prose(rng, 40).split() + passage.split() + prose(rng, 40).split()) for _ in range(8)]
    for _ in range(50):
        changed = list(base)
        changed[rng.randrange(300)] = "changed"
        texts.append(" ".join(changed))
    texts += ["ha " * 200, "no line\n" * 50 + "end", "Üb er é ß \x1c x" * 20, passage, passage + "\n" + passage, "\x00 nul"]
    texts += [prose(rng, rng.randrange(1, 400)) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, passage), (None, None), (3, "one"), (9, texts[9])]


@pytest.fixture(scope="module")
def documents(spark, rows):
    data = [(i, t, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 5}", -1, "x", "y", 7) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pii_equals_regular_expressions(spark, rng):
    parts = ["a.b+c@x-y.co.uk", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999"]
    parts += ["+", "+49", "0001.02.3.255", "12--34", ".", " ", "-", "é", "\n", "iban DE89 3704 0044 0532 0130 00", "account: 12345678", "http://x.org/a?b=1.", "://", "9" * 30]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ".", "-"]) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "1" * 5000 + "@", "a." * 3000]
    found = pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    base = found.select("doc_id", pii.listed(pii.of_kinds(F.col("spans"), *pii.BASE_KINDS))).collect()
    assert {r[0]: r[1] for r in base} == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t or "")) for i, t in enumerate(texts)}


def test_pii_adds_addresses_and_accounts(spark):
    text = "mail http://x.org/a, IBAN DE89 3704 0044 0532 0130 00 or account no. 12345678; iban DE89 3704 0044 0532 0130 01"
    (row,) = pii.pii_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.kind, text[s.start : s.end]) for s in row.spans] == [("url", "http://x.org/a"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]


def test_statistics(documents, rows):
    found = sorted((tuple(r)[1:6] for r in quality.text_statistics(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    expected = []
    for _, text in rows:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        expected.append((len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat_words(w)))
    assert found == sorted(expected)


def test_rules_are_learned_and_ordered(spark, rng):
    good = [(i, prose(rng, 80), 1) for i in range(300)]
    loud = [(300 + i, prose(rng, 80).upper(), 0) for i in range(150)]
    marked = [(450 + i, prose(rng, 80).replace(" ", "### "), 0) for i in range(150)]
    short = [(600, "few words", 1), (601, None, 0), (602, "x " * 100, 1)]
    everything = spark.createDataFrame(good + loud + marked + short, "doc_id long, text string, quality int")
    found = quality.quality(everything.select("doc_id", "text"), everything.filter("doc_id % 2 = 0").select("doc_id", "quality"))
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in loud + marked + short)


def test_cuts_lie_between_the_classes(spark):
    rng = random.Random(3)
    good = [(i, prose(rng, 80), 1) for i in range(300)]
    marked = [(300 + i, prose(rng, 80).replace(" ", "### "), 0) for i in range(150)]
    single = [(500 + i, prose(rng, 80) + f" {mark}", None) for i, mark in enumerate("$&#")]
    everything = spark.createDataFrame(good + marked + single, "doc_id long, text string, quality int")
    found = quality.quality(everything.select("doc_id", "text"), everything.select("doc_id", "quality"))
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert all(kept[i] for i, _, _ in good + single) and not any(kept[i] for i, _, _ in marked)


def test_quality_without_labels(documents, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.quality(documents, labels)
    assert found.filter("kept = base_failed").isEmpty() and found.filter("rule is not null").isEmpty()
    assert quality.quality(nothing, labels).isEmpty()


def test_exact_groups(documents, rows, nothing):
    found = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(documents, bucket_keys=8).collect())
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    expected = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = max((x for x in own if x is not None), default=None)
        expected.append((str(i), str(keep), len(own), i == keep, sha(norm(t))))
    assert found == sorted(expected)
    assert exact.exact_groups(nothing).isEmpty()


def test_colliding_keys_become_chains(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "A", "b", "c"])], "doc_id long, text string")
    found = exact.exact_groups(rows, key=lambda text: F.lit(5).cast("long"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in found.collect()} == {(0, 2, False), (1, 3, False), (2, 2, True), (3, 3, True), (4, 4, True)}
    assert {r.chain for r in found.filter("group_size > 1").collect()} != {None} and found.filter("group_size > 1").select("chain").distinct().count() == 2


def test_directory_doubles_until_buckets_fit():
    counts = {s: 10 for s in range(8)} | {7: 100}
    slots = exact.split_directory(counts, 3, 40)
    assert {b[0] for b in slots.values()} == {1, 2, 3} or {b[0] for b in slots.values()} <= {1, 2, 3}
    for s, (local, prefix) in slots.items():
        assert s >> (3 - local) == prefix
        total = sum(n for t, n in counts.items() if t >> (3 - local) == prefix)
        assert total <= 40 or local == 3
    assert exact.split_directory({}, 3, 40) == {s: (0, 0) for s in range(8)}


def test_substrings_equal_all_windows(documents, rows, nothing):
    found = repeats.remove_repeats(documents).collect()
    expected = substrings(rows)
    assert len(found) == len(rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted((str(i), *expected[i, t]) for i, t in rows)
    assert repeats.remove_repeats(nothing).isEmpty()


def test_hot_anchors_take_the_other_way_to_the_same_result(documents, rows, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_COUNT", 2)
    assert repeats.hot_anchors(documents, 13)
    expected = substrings(rows)
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(documents).collect()} == {(i, *expected[i, t][1:]) for i, t in rows}


def test_near_duplicates_equal_all_pairs(documents, rows, nothing):
    found = sorted((tuple(r) for r in jaccard.near_duplicates(documents).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert found == near(rows)
    assert jaccard.near_duplicates(nothing).isEmpty()


def test_near_duplicates_in_split_buckets_and_tiles(documents, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 5000)
    found = sorted((tuple(r) for r in jaccard.near_duplicates(documents, limit=3).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert found == near(rows)


def test_runs_grow_with_recall():
    assert jaccard.n_runs(0.8, 0.9999, 2.5, 4) > jaccard.n_runs(0.8, 0.99, 2.5, 4) >= 2


def test_mix_meets_targets(spark, documents, rows, nothing):
    weights = mixing.cycled_weights(documents)
    assert [tuple(r) for r in weights.orderBy(F.col("source").asc_nulls_last()).collect()] == [("s1", 1.0), ("s2", 2.0), ("s3", 3.0), ("s4", 1.0), (None, 2.0)]
    found = mixing.mix(documents, weights, shard_words=3000)
    got = found.collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    sources = {r["source"]: r for r in got}
    total = sum(r["size"] for r in got)
    assert sum(r["target"] for r in sources.values()) == pytest.approx(total)
    for source, row in sources.items():
        own = [r for r in got if r["source"] == source]
        assert row["source_size"] == sum(r["size"] for r in own) and row["target"] <= 3 * row["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - row["target"]) <= 200 + 0.02 * row["target"]
    again = mixing.mix(documents.repartition(7), weights, shard_words=3000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(nothing, weights).isEmpty()


def test_excess_over_three_times_is_shared_again(spark):
    sized = [("a", 10, 1.0), ("b", 1000, 2.0), ("c", 500, 3.0), ("d", 0, 1.0)]
    found = mixing.targets(spark.createDataFrame(sized, "source_key string, source_size long, weight double"), 3)
    got = {r.source_key: r.target for r in found.collect()}
    assert got == {"a": pytest.approx(30), "d": 0, "b": pytest.approx(1480 * 2 / 5), "c": pytest.approx(1480 * 3 / 5)}


def test_seats_equal_highest_quotients(spark, rng):
    data = [("p", f"c{i:02}", float(rng.randrange(1, 500)), 37, 1000) for i in range(15)]
    children = spark.createDataFrame(data, "parent string, child string, votes double, seats long, most long")
    got = {r.child: r.quota for r in mixing.apportion(children, ["parent"], ["child"], "votes", "seats", "most").collect()}
    quotients = sorted(((-v / (2 * k - 1), c) for _, c, v, _, _ in data for k in range(1, 38)))[:37]
    assert got == {c: sum(x == c for _, x in quotients) for _, c, _, _, _ in data}


def test_bpe_equals_tiktoken(documents, rows, nothing):
    import tiktoken

    ranks, pattern = tokenizer()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    more = [(900, "<|endoftext|> don't  stop\n\n  12345 äöü 你好 🙂🙂" * 3), (901, "a" * 1500 + " " * 300 + "!?" * 200), (902, "abc" * 300)]
    every = rows + more
    spark = documents.sparkSession
    frame = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = bpe.round_trip(frame, ranks, pattern).collect()
    expected = [(str(i), b"".join(t.to_bytes(4, "little") for t in known.encode_ordinary(text or "")), (text or "").encode()) for i, text in every]
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in found) == sorted(expected)
    encoded = bpe.encode(frame, ranks, pattern)
    assert sorted(bytes(r.decoded) for r in bpe.decode(encoded, ranks, pattern).collect()) == sorted(e[2] for e in expected)
    assert bpe.round_trip(nothing, ranks, pattern).isEmpty()


@pytest.mark.parametrize("letters", ["ACGT", "abcdefghijklmnopqrstuvwxyz"])
def test_bpe_of_many_long_words(spark, letters):
    import tiktoken

    ranks, pattern = tokenizer()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(7)
    text = "\n".join("".join(draw.choices(letters, k=60)) for _ in range(20_000))
    (found,) = bpe.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), ranks, pattern).collect()
    assert bytes(found.ids) == b"".join(t.to_bytes(4, "little") for t in known.encode_ordinary(text))
    assert bytes(found.decoded) == text.encode()


def test_bpe_refuses_foreign_ids(spark):
    ranks, pattern = tokenizer()
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id long, ids binary"), ranks, pattern).collect()


def test_segments_are_maximal(rng):
    from brute import segments

    for _ in range(150):
        scores = [rng.choice([-0.5, -0.5, -0.5, 1.0, 2.25, 0.75]) for _ in range(rng.randrange(0, 25))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(hits, -0.5)] == segments(scores)


def test_toxicity_is_learned_and_held_out(spark, rng):
    insults = [f"bad{i}" for i in range(12)]
    data = []
    for i in range(600):
        text = prose(rng, 120).split()
        if i % 6 == 0:
            at = rng.randrange(100)
            text[at:at] = [x for w in rng.choices(insults, k=6) for x in (w, "w1")]
        data.append((i, " ".join(text), int(i % 6 == 0)))
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None), (7, 3)], "doc_id long, toxic int"))
    model = toxicity.learn(frame.select("doc_id", "text"), labels)
    found = toxicity.score(frame, model, carry=("toxic",)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert 60 < sum(r.held for r in found) < 180
    assert all((r.score >= 0.5) == bool(r.toxic) for r in found)
    hit = next(r for r in found if r.toxic)
    text = data[hit.doc_id][1]
    assert all(text[p.start : p.end].startswith("bad") for p in hit.passages) and hit.passages


def test_evidence_below_significance_counts():
    model = toxicity.Model(lexicon={"bad": 4.0, "worse": 5.0}, other=-0.1, location=-2.0)
    texts = ["word " * 999, "word " * 998 + "bad ", "word " * 998 + "worse ", "word " * 9 + "worse "]
    evidence, passages = zip(*(toxicity.scan(t, model) for t in texts), strict=True)
    assert list(evidence) == sorted(set(evidence)) and evidence[1] < 0 < evidence[2] < 3 < evidence[3]
    assert [len(p) for p in passages] == [0, 0, 0, 1] and toxicity.scan("", model) == (0.0, [])


def test_toxicity_of_odd_tables(spark, documents, rows, nothing):
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.learn(documents, labels)
    found = toxicity.score(documents, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score < 0.5 and not r.passages for r in found)
    assert toxicity.learn(nothing, labels.limit(0)).lexicon == {} and toxicity.score(nothing, model).isEmpty()
    assert sys.getsizeof(model) < 10_000


def test_one_very_long_text_comes_back(spark):
    import tiktoken

    ranks, pattern = tokenizer()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    text = " ".join(rng.choice(["alpha", "Bet9", "gamma\n", "é" * 3, "x" * 70, "12345"]) + str(rng.randrange(50_000)) for _ in range(900_000))[:10_000_000]
    assert len(text) > 9_000_000
    texts = {1: text, 2: "short", 3: "", 4: text[:3_000_000]}
    found = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in bpe.round_trip(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), ranks, pattern).collect()}
    for i, t in texts.items():
        assert found[i][1] == t.encode()
        assert found[i][0] == np.array(known.encode_ordinary(t), "<u4").tobytes()


@pytest.mark.parametrize("seed", range(20))
def test_learned_cuts_spare_the_good(spark, seed):
    rng = random.Random(seed)
    good = [(i, prose(rng, 80)) for i in range(300)]
    bad = [(300 + i, prose(rng, 80).upper()) for i in range(150)] + [(450 + i, prose(rng, 80).replace(" ", "### ")) for i in range(150)]
    stats = quality.text_statistics(spark.createDataFrame(good + bad, "doc_id long, text string").coalesce(2))
    rows = stats.select("doc_id", *[F.expr(e).alias(s) for s, e in quality.STATISTICS.items()]).persist()
    prune = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    labelled = rows.filter("doc_id % 2 = 0").select((F.col("doc_id") >= 300).cast("int").alias("bad"), prune.alias("prune"), *quality.STATISTICS)
    rules = quality.learn_rules(labelled.persist())
    dropped = {r.doc_id for r in rows.filter(quality.rule_number(rules).isNotNull()).select("doc_id").collect()}
    assert dropped == set(range(300, 600)), rules


def test_an_id_with_two_texts_has_links_by_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (7, "alone in here it is"), (2, a + " x")]
    found = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, 1, 1), (1, 1, 2), (2, 1, 2), (2, 1, 2), (3, 1, 1), (7, 7, 0)]


def test_recall_on_a_given_table(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    documents = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(documents).collect()}
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in documents.collect() for w in [words(r.text)]}
    holders = defaultdict(list)
    queries = [i for i in sets if i % 100 == 0]
    wanted = set().union(*(sets[i] for i in queries))
    for i, own in sets.items():
        for s in own & wanted:
            holders[s].append(i)
    links = missed = 0
    for i in queries:
        near_ones = {j for s in sets[i] for j in holders[s] if j != i}
        linked = [j for j in near_ones if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        links += len(linked)
        missed += abs(len(linked) - found[i][1])
        assert all(found[j][0] == found[i][0] for j in linked)
    assert links > 20 and missed <= 0.001 * links


def test_pii_of_nulls_repeats_clashes_and_long_texts(spark):
    filler = "lorem ipsum 12 a@b " * 20_000
    long = filler + "mail me@x.org, 10.0.0.1 and 4111 1111 1111 1111 or +1 (555) 010-9999 " + filler
    rows = [(None, "a@b.c"), (1, None), (1, "x 1.2.3.4"), (1, "x 1.2.3.4"), (2, ""), (3, long)]
    given = spark.createDataFrame([(i, t, "mine", 5) for i, t in rows], "doc_id long, text string, spans string, kind int")
    found = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS]) for r in pii.pii_spans(given).collect()]
    expected = [(i, base_spans(t or "")) for i, t in rows]
    assert sorted(found, key=str) == sorted(expected, key=str) and len(dict(expected)[3]) == 4
    assert pii.pii_spans(given.limit(0)).collect() == []
