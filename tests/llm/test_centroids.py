"""Centroids against plain Python, the curve, and the boxes."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from mediatimeline.llm import centroids
from tests.llm import data


def plain(rows, k, rounds, dims):
    """(id, cluster, distance, inertia of the cluster, inertia, digest) of every kept row, in exact whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    digest = [None if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest() for i, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (digest[r] is None, digest[r] or "", kept[r][1]))[:k]
    at = [kept[r][1] for r in first]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for c in range(len(at)):
            own = [v for (_, v), m in zip(kept, mine) if m == c]
            if own:
                at[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    per = [sum(d for d, m in last if m == c) for c in range(len(at))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]

    def held(n):
        return n if n < 2**63 else None

    return [(i, m, held(d), held(per[m]), held(sum(per)), names[m]) for (i, _), (d, m) in zip(kept, last)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       *[T.StructField(n, T.IntegerType()) for n in ("id", "v", "key", "place", "rows", "n", "cluster", "digest")]])


def table(spark, rows):
    return spark.createDataFrame([(i, v, *[1] * 8) for i, v in rows], SCHEMA)


def odd_vectors():
    pick = random.Random(5)
    groups = [[pick.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [x + pick.gauss(0, 0.05) for x in groups[i % 5]]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [0.5, 0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5, 0.5]), (500, None), (501, []),
             (502, [1.0, 2.0, 3.0]), (503, [1.0, None, 0.0, 0.0]), (504, [math.nan, 0.0, 0.0, 0.0]), (505, [math.inf, 0.0, 0.0, 0.0]),
             (506, [0.0, -0.0, 1e-12, -1e-12])]
    return rows + [(1000 + i, [0.25, 0.25, -0.75, 0.5]) for i in range(400)]  # a common vector


@pytest.mark.parametrize("k,block_rows", [(8, 16), (3, 1000)])
def test_plain(spark, k, block_rows):
    rows = odd_vectors()
    got = centroids.centroid_clusters(table(spark, rows), k, 4, 4, block_rows=block_rows)
    assert data.pairs(got.collect(), *COLUMNS) == data.pairs([dict(zip(COLUMNS, r)) for r in plain(rows, k, 4, 4)], *COLUMNS)


def test_boxes_rule_out(spark):
    """Of groups far apart, most blocks are compared with few centroids."""
    rows = centroids.centroid_clusters(table(spark, odd_vectors()), 8, 4, 4, block_rows=16).collect()
    assert sum(r.compared for r in rows) < 5 * len(rows)


def test_large_numbers(spark):
    rows = [(i, [float(10 ** (i % 16)), -float(3 ** (i % 30)), 1e15 / (i + 1), 2.0**51]) for i in range(60)] + [(99, [2.0**53, 0.0, 0.0, 0.0])]
    got = centroids.centroid_clusters(table(spark, rows), 5, 3, 4, block_rows=7)
    assert data.pairs(got.collect(), *COLUMNS) == data.pairs([dict(zip(COLUMNS, r)) for r in plain(rows, 5, 3, 4)], *COLUMNS)


def test_few_and_none(spark):
    rows = [(1, [0.1] * 4), (2, [0.1] * 4), (3, [0.9] * 4)]
    got = centroids.centroid_clusters(table(spark, rows), 8, 3, 4).collect()
    assert data.pairs(got, *COLUMNS) == data.pairs([dict(zip(COLUMNS, r)) for r in plain(rows, 8, 3, 4)], *COLUMNS)
    for none in ([], [(1, None), (2, [])]):
        empty = centroids.centroid_clusters(table(spark, none), 8, 3, 4)
        assert empty.columns[:6] == COLUMNS and empty.collect() == []


def test_size_is_checked(spark):
    with pytest.raises(ValueError, match="sent to every task"):
        centroids.centroid_clusters(table(spark, []), 1 << 15, 1, 64)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = centroids.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    ordered = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=1, max_size=12),
       st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=1, max_size=6))
def test_nearest_is_exact(vectors, points):
    values, at = np.array(vectors), np.array(points)
    for scale in (1, 1 << 40):
        best, distance, _ = centroids.nearest(values * scale, values.min(axis=0) * scale, values.max(axis=0) * scale, at * scale)
        want = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(points)) for v in vectors]
        assert [(int(d) // scale**2, int(c)) for d, c in zip(distance, best)] == want
