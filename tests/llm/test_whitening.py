"""Whitening against numpy's eigenvectors of the covariance, on odd vectors and at several partition counts."""

import math
import random

import numpy as np
import pytest

from quoin.llm import whitening

SF = "/root/testdata/sf0.001"


def _plain(rows, components=8):
    """(id, component) -> (n, deviation, whitened, explained) by eigenvectors, with Python's integers."""
    rows = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(rows), len(rows[0][1])
    sums = [sum(x[k] for _, x in rows) for k in range(d)]
    dev = [[n * x[k] - sums[k] for k in range(d)] for _, x in rows]
    y = np.array(dev, float) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    w = y @ q[:, :components] / np.sqrt(e[:components])
    return [(rows[i][0], k + 1, n, sum(v * v for v in dev[i]), w[i, k], e[k] / e.sum()) for i in range(n) for k in range(min(components, d))]


def _check(got, want, components=8):
    got = sorted(got, key=lambda r: (r[0], r[1], r[4]))
    want = sorted(want, key=lambda r: (r[0], r[1], r[4]))
    assert len(got) == len(want)
    for k in range(1, components + 1):
        a, b = [r for r in got if r[1] == k], [r for r in want if r[1] == k]
        sign = np.sign(sum(x[4] * y[4] for x, y in zip(a, b, strict=True)))
        assert [x[:4] for x in a] == [x[:4] for x in b] or sign < 0
        assert sorted(x[:4] for x in a) == sorted(x[:4] for x in b)
        assert np.allclose(sorted((x[0], sign * x[4]) for x in a), sorted((x[0], x[4]) for x in b), atol=1e-7)
        assert all(abs(x[5] / y[5] - 1) < 1e-9 for x, y in zip(a, b, strict=True)) and all(x[6] < 1e-9 for x in a)


@pytest.mark.parametrize("parts", [1, 40])
def test_whole_table_equals_eigenvectors(spark, parts):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = [tuple(r) for r in whitening.whiten(df.repartition(parts)).collect()]
    _check(got, _plain([(r.vec_id, r.embedding) for r in df.collect()]))


def test_odd_vectors_are_left_out_and_repeats_count(spark):
    r = random.Random(3)
    rows = [(i % 90, [r.gauss(0, 1 + k) for k in range(10)]) for i in range(100)]
    odd = [(200, None), (201, []), (202, [1.0, None] + [0.0] * 8), (203, [float("nan")] * 10), (204, [float("inf")] + [0.0] * 9), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, "n") for x in rows + rows[:5] + odd], "vec_id long, embedding array<float>, n string").withColumnRenamed("vec_id", "id").withColumnRenamed("embedding", "vec")
    rows = [(r.id, r.vec) for r in df.collect()]
    got = [tuple(x) for x in whitening.whiten(df, "id", "vec").collect()]
    _check(got, _plain([x for x in rows if x[1] is None or len(x[1]) == 10]))


def test_equal_vectors_empty_tables_and_huge_entries(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(None, [0.5, 1.5])] * 3, schema)).collect()
    assert len(same) == 6 and all(x.whitened is None and x.identity_error is None and x.deviation == 0 and x.explained == 0.0 and x.n == 3 for x in same)
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [0.0, 1.0])], schema)).collect()
    assert all(x.deviation is None and abs(abs(x.whitened) - 1) < 1e-9 for x in huge if x.component == 1)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(4)], schema)).collect()
    assert {x.component: round(x.explained, 9) for x in line} == {1: 1.0, 2: 0.0, 3: 0.0} and all((x.whitened is None) == (x.component > 1) for x in line)


def test_deviations_stay_exact(spark):
    y = np.array([[2**31, -(2**31), 5], [2**31, 2**30, 1], [2**32, 0, 0]], np.int64)
    assert whitening._squares(y) == [2 * 2**62 + 25 if 2 * 2**62 + 25 < 2**63 else None, 2**62 + 2**60 + 1, None]
