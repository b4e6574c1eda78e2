import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from quarry.llm.packing import pack_windows, sum_of_squares


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_containers_hold(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    bins = sum_of_squares(sizes, 50)
    assert len(bins) == len(sizes) and (not len(sizes) or np.bincount(bins, weights=sizes).max() <= 50)


def slow(sizes, capacity):
    """Sum-of-squares by trying every container."""
    gaps, out = [], []
    for s in sizes:
        def total(g):
            n = defaultdict(int)
            for x in g:
                n[x] += x > 0
            n[capacity] = 0
            return sum(v * v for v in n.values())
        options = [(total(gaps + [capacity - s]), 1, 0, None)]
        options += [(total(gaps[:i] + [g - s] + gaps[i + 1 :]), 0, g, i) for i, g in enumerate(gaps) if g >= s]
        _, new, _, i = min(options, key=lambda o: o[:3])
        if new:
            gaps.append(capacity - s)
        else:
            gaps[i] -= s
        out.append(len(gaps))
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_places_by_squares(sizes):
    """As many containers as the plain rule, tried container by container, gives."""
    got = sum_of_squares(np.array(sizes, dtype=np.int64), 12)
    assert (got.max() + 1 if len(got) else 0) == slow(sizes, 12)


def test_little_room_unused():
    sizes = np.random.default_rng(1).integers(1, 400, 20_000)
    assert sum_of_squares(sizes, 1000).max() + 1 <= 1.01 * math.ceil(sizes.sum() / 1000)


def test_operator(spark):
    n = {1: 0, 2: None, 3: 7, 4: 10, 5: 11, 6: 35, 7: 30, **{i: 1 + i % 9 for i in range(8, 300)}}
    df = spark.createDataFrame(list(n.items()), "doc_id long, n_tokens int").selectExpr("*", "'x' AS bin_id")
    windows = spark.createDataFrame([("s", 10), ("b", 40), ("bad", 0), ("none", None)], "window_name string, capacity int")
    got = pack_windows(df, windows, shard_items=100).collect()
    for w, c in (("s", 10), ("b", 40)):
        fill, of = defaultdict(int), defaultdict(list)
        for r in got:
            if r["window_name"] == w:
                fill[r["bin_id"]] += r["token_end"] - r["token_begin"]
                of[r["doc_id"]].append((r["piece_no"], r["token_begin"], r["token_end"]))
        assert max(fill.values()) <= c and of.keys() == n.keys()
        for d, pieces in of.items():
            pieces.sort()
            assert [p for p, _, _ in pieces] == list(range(1, len(pieces) + 1))
            assert pieces[0][1] == 0 and pieces[-1][2] == (n[d] or 0) and all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
            assert len(pieces) == max(1, math.ceil((n[d] or 0) / c))
    assert pack_windows(df.limit(0), windows).count() == 0
