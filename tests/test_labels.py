"""Connected parts of fields: flood fill, winding objects, strips and seams, components by joins."""

import random
import time

import numpy as np
import pytest

from cellweave.operators import large, objects


def flooded(on):
    """Parts in the order of their first cells, as sets."""
    left, out = {tuple(c) for c in np.argwhere(on)}, []
    while left:
        front = [min(left)]
        part = set(front)
        left -= part
        while front:
            y, x = front.pop()
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            part |= near
            front += near
        out.append(part)
    return out


def serpentine(n):
    on = np.zeros((n, n), bool)
    on[::2] = True
    on[1::4, -1] = True
    on[3::4, 0] = True
    return on


@pytest.mark.parametrize("share", [0.0, 0.2, 0.4, 0.6, 1.0])
def test_labels_equal_flood_fill(share):
    for seed in range(5):
        on = np.random.default_rng(seed).random((23, 17)) < share
        names = objects.label(on)
        parts = flooded(on)
        assert names.max(initial=0) == len(parts) and ((names > 0) == on).all()
        assert {frozenset(map(tuple, np.argwhere(names == k))) for k in range(1, len(parts) + 1)} == {frozenset(p) for p in parts}
        last = [max(y * 17 + x for y, x in np.argwhere(names == k)) for k in range(1, len(parts) + 1)]
        assert last == sorted(last)


def test_a_long_winding_object_takes_seconds():
    began = time.time()
    assert objects.label(serpentine(2000)).max() == 1
    assert time.time() - began < 20


def table(spark, fields):
    rows = [(t, int(y), int(x), bool(on[y, x])) for t, on in fields.items() for y, x in np.ndindex(on.shape)]
    return spark.createDataFrame([*rows, *rows[:3], (1, None, 0, True), (1, 0, 0, None)], "k int, y int, x int, on boolean").selectExpr("make_timestamp_ntz(2000, 1, 1 + k, 0, 0, 0) as time", "y", "x", "on")


@pytest.mark.parametrize("height", [1, 3, 8, 100])
def test_strips_equal_whole_fields(spark, height):
    fields = {k: np.random.default_rng(k).random((19, 13)) < (0.35, 0.5, 0.0, 1.0)[k % 4] for k in range(4)} | {4: serpentine(21)}
    got = {}
    for r in objects.labels_of_fields(table(spark, fields), height).collect():
        for x in range(r.first, r.after):
            assert got.setdefault((r.time.day - 1, r.y, x), r.label) == r.label
    for k, on in fields.items():
        for n, part in enumerate(flooded(on), 1):
            assert {got.pop((k, y, x)) for y, x in part} == {n}
    assert not got


def test_components_equal_flood_fill(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(200)] + [(3000 - k, 2999 - k) for k in range(100)] + [(5, 5), (5, None)]
    parent = {}

    def find(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in pairs:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in large.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: find(k) for k in parent}
    assert large.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
