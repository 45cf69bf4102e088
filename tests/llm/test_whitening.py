"""Whitening against whole-number sums and numpy over all rows at once."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.llm import whitening
from verdictflow.llm.common import table
from verdictflow.llm.queries import QUERIES


def vectors(rng, n, d):
    return [[rng.gauss(0, 0.1 * (1 + k % 3)) + 0.2 * (k == 1) for k in range(d)] for _ in range(n)]


def plain(rows):
    """n, deviations, whitened components, shares and trace, from exact sums."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    sums = [sum(row[k] for row in x) for k in range(d)]
    off = [[n * row[k] - sums[k] for k in range(d)] for row in x]
    v = np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(d)] for i in range(d)])
    values, parts = np.linalg.eigh(v)
    order = np.argsort(-values)
    values, parts = values[order], parts[:, order]
    z = np.array([[o / n for o in row] for row in off]) @ parts / np.sqrt(np.maximum(values, 1e-300))
    return good, n, [sum(o * o for o in row) for row in off], z, values / values.sum()


def check(spark, rows, components=8):
    given = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<float>, z string, component int")
    found = whitening.whiten(given.repartition(3), components=components).collect()
    good, n, deviations, z, explained = plain(rows)
    most = min(components, z.shape[1])
    assert len(found) == len(good) * most and {r.n for r in found} == {n}
    of = {i: k for k, (i, _) in enumerate(good)}
    signs = {}
    for r in found:
        k, c = of[r.vec_id], r.component - 1
        assert int(r.deviation) == deviations[k]
        assert r.explained == pytest.approx(explained[c], rel=1e-9)
        if abs(z[k, c]) > 0.1:
            signs.setdefault(c, set()).add(np.sign(z[k, c]) == np.sign(r.whitened))
        assert abs(r.whitened) == pytest.approx(abs(z[k, c]), abs=1e-7)
        assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_equals_exact_sums(spark):
    rng = random.Random(3)
    check(spark, list(enumerate(vectors(rng, 300, 12))))
    check(spark, list(enumerate(vectors(rng, 60, 3))))


def test_what_is_not_usable_is_dropped(spark):
    rng = random.Random(4)
    good = list(enumerate(vectors(rng, 80, 5)))
    bad = [(100, None), (101, []), (102, [0.1, None, 0.1, 0.1, 0.1]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]), (105, [0.0, -math.inf, 0.0, 0.0, 0.0])]
    check(spark, good + bad)


def test_wide_entries_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** (12 * (k == 0)) for k in range(3)]) for i in range(40)]
    check(spark, rows, components=1)


def test_squares_are_exact_past_64_bits():
    y = whitening.centred(np.array([[2**40, -(2**40)], [3, 2**41]], dtype=np.int64), [1, -1])
    assert y.dtype == object
    expected = {(i, j): sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in y.tolist()) for i in range(2) for j in range(i, 2)}
    assert {(i, j): s for i, j, s in whitening.pair_squares(y)} == expected


def test_polarisation_gives_the_covariances():
    rng = np.random.default_rng(1)
    y = rng.integers(-900, 900, (500, 6))
    squares = {(i, j): s for i, j, s in whitening.pair_squares(y)}
    for i in range(6):
        for j in range(i + 1, 6):
            assert squares[i, j] - squares[i, i] - squares[j, j] == 2 * int((y[:, i] * y[:, j]).sum())


def test_rank_null_ids_and_repeats(spark):
    flat = [(i, [0.1 * i, 0.2 * i, 0.5]) for i in range(20)]
    given = spark.createDataFrame([*flat, (None, [0.3, 0.1, 0.5]), (3, [0.3, 0.6, 0.5]), (3, [0.3, 0.6, 0.5])], "vec_id long, embedding array<float>")
    found = whitening.whiten(given)
    assert {r.component for r in found.collect()} == {1, 2} and found.filter("vec_id = 3").count() == 6
    assert found.filter("vec_id is null").count() == 2


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitening.whiten(given)
    assert found.collect() == [] and found.columns[:3] == ["vec_id", "component", "n"]


def test_two_lengths_are_refused(spark):
    given = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5])], "vec_id long, embedding array<float>").repartition(2)
    with pytest.raises(Exception, match="cannot be whitened together"):
        whitening.whiten(given).collect()


def test_all_of_a_given_table(spark, sf_dir):
    found = QUERIES["op12_whitening"](spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").count()
    assert found.count() == 8 * rows and dict(found.dtypes)["deviation"] == "bigint"
    # Whitened: no two components vary together, each has variance 1.
    wide = found.groupBy("vec_id").pivot("component", list(range(1, 9))).agg(F.first("whitened"))
    z = np.array([r[1:] for r in wide.collect()])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(8)).max() < 1e-9
