"""Exact search and hard negatives against brute force, edge rows of both."""

from __future__ import annotations

import numpy as np
import pytest

from marketweek.llm import integers, negatives, topk

VECTORS = "vec_id long, embedding array<float>, label int, score string, v int, dim string, block string, q string"


def rows_of(x: np.ndarray, labels=None, ids=None):
    ids = range(len(x)) if ids is None else ids
    labels = [k % 4 for k in range(len(x))] if labels is None else labels
    return [(int(i), [float(c) for c in e], lab, "s", 1, "d", "b", "q") for i, e, lab in zip(ids, x, labels)]


def brute_top(rows, k=20, every=20, scale=64):
    good = {(r[0], tuple(int(np.floor(scale * np.float64(np.float32(c)))) for c in r[1])) for r in rows if r[0] is not None and usable(r[1])}
    out = []
    for i, q in good:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def brute_negatives(rows):
    good = {
        (r[0], r[2], tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in r[1]))
        for r in rows if r[0] is not None and r[2] is not None and usable(r[1])
    }
    out = []
    for i, label, a in good:
        if i % 100 == 0:
            scored = sorted(
                (-sum(x * y for x, y in zip(a, c)), j, other) for j, other, c in good if j != i and len(c) == len(a)
            )
            for p, j, _ in [s for s in scored if s[2] == label][:5]:
                fits = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
                out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(fits)]
    return sorted(out)


def usable(e):
    return e is not None and all(c is not None and np.isfinite(c) for c in e)


def found(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


TOP = ("query_id", "rank", "vec_id", "score")
MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(420, 6)) / 2
    x[100:240] = x[100]  # a third of all rows are copies
    rows = rows_of(x)
    rows += rows[:3]  # repeated rows
    rows += [
        (1000, None, 1, "s", 1, "d", "b", "q"), (1020, [0.0] * 6, 1, "s", 1, "d", "b", "q"),
        (1040, [float("nan")] + [0.0] * 5, 1, "s", 1, "d", "b", "q"), (1060, [float("inf")] * 6, 1, "s", 1, "d", "b", "q"),
        (1080, [None] * 6, 1, "s", 1, "d", "b", "q"), (None, [1.0] * 6, 1, "s", 1, "d", "b", "q"),
        (1100, [1.0, 2.0], 1, "s", 1, "d", "b", "q"), (1101, [1.0, 3.0], 1, "s", 1, "d", "b", "q"),
        (1102, [2.0, 2.0], 2, "s", 1, "d", "b", "q"), (1200, [], None, "s", 1, "d", "b", "q"),
        (1201, [], 3, "s", 1, "d", "b", "q"), (20, [0.5] * 6, 2, "s", 1, "d", "b", "q"),
        (-100, [0.25] * 6, 1, "s", 1, "d", "b", "q"),
    ]
    return rows


def test_top_products_equal_brute_force(spark, odd_rows, monkeypatch):
    # Small sections, annuli and slices, so that bounds and borders matter.
    monkeypatch.setattr(topk, "MIN_SECTION", 40)
    monkeypatch.setattr(topk, "SLICE", 8)
    df = spark.createDataFrame(odd_rows, VECTORS).repartition(5)
    out = topk.top_products(df)
    assert out.columns == list(TOP)
    assert found(out, *TOP) == brute_top(odd_rows)
    assert topk.top_products(df.limit(0)).count() == 0


def test_bounds_cut_what_cannot_matter(spark, monkeypatch):
    """Vectors in distant clusters: queries visit few sections, results stay exact."""
    monkeypatch.setattr(topk, "MIN_SECTION", 50)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 4
    x = np.repeat(centres, 60, axis=0) + rng.normal(size=(720, 8)) / 50
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = rows_of(x)
    seen = []
    monkeypatch.setattr(topk, "visited", lambda index, dealt, pivots, k, f=topk.visited: (seen.append((index.count(), dealt.count())), f(index, dealt, pivots, k))[1])
    assert found(topk.top_products(spark.createDataFrame(rows, VECTORS).repartition(4)), *TOP) == brute_top(rows)
    n_sections, dealt = seen[0]
    assert n_sections > 10 and dealt < 36 * n_sections / 3


def test_bound_is_never_below_a_score():
    rng = np.random.default_rng(7)
    x, q, p = (rng.integers(-40, 40, size=(n, 5)) for n in (300, 50, 1))
    d, near = topk.distances(x, p)[:, 0], topk.distances(q, p)
    reach = topk.bounds(np.repeat(near, 300, 1), topk.squares(q), d, d, topk.squares(x))
    assert (reach >= q @ x.T).all()


@pytest.mark.parametrize("size", [1, 40, 10**7, 10**12, 2**62])
def test_products_at_any_size(size):
    rng = np.random.default_rng(8)
    a, b = (rng.integers(-size, size + 1, size=(n, 5)) for n in (7, 11))
    want = a.astype(object) @ b.T.astype(object)
    assert (integers.products(a, b).astype(object) == want).all()
    assert (negatives.Packed(a, b).scores(a).astype(object) == want).all()


def test_packed_fields_share_a_multiplication():
    a = np.full((2, 64), -200)
    packed = negatives.Packed(np.vstack([a, a + 400]), np.vstack([a, a + 400, a + 100]))
    assert packed.doubles and packed.fields == 2 and packed.wide.shape == (64, 3)
    far = negatives.Packed(np.vstack([a, -a]) * 10**6, np.vstack([a, -a]) * 10**6)
    assert not far.doubles and far.fields > 10


def test_huge_components(spark):
    rows = rows_of(np.array([[3e38, 1.0], [3e38, -3e38], [1e30, 2.0], [-1e25, 5.0], [7.0, 0.5]]), ids=range(0, 500, 100), labels=[1, 1, 2, 2, 1])
    df = spark.createDataFrame(rows, VECTORS)
    out = topk.top_products(df).collect()
    assert len(out) == 20 and max(r.score for r in out) == 2**63 - 1
    assert negatives.hard_negatives(df).count() >= 0


def test_firsts_break_ties_by_column():
    score = np.array([[5, 7, 7, 5, 7], [0, 0, 0, 0, 0]])
    allowed = np.array([[1, 0, 1, 1, 1], [0, 0, 0, 0, 1]], bool)
    row, col = integers.firsts(score, allowed, 3)
    assert row.tolist() == [0, 0, 0, 1] and col.tolist() == [2, 4, 0, 4]
    row, col = integers.firsts(score.astype(object) * 10**30, allowed, 3)
    assert row.tolist() == [0, 0, 0, 1] and col.tolist() == [2, 4, 0, 4]


def test_negatives_equal_brute_force(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(negatives, "MIN_BLOCK", 60)
    monkeypatch.setattr(negatives, "SLICE", 2)
    df = spark.createDataFrame(odd_rows, VECTORS).repartition(5)
    out = negatives.hard_negatives(df)
    assert out.columns == list(MINED)
    got = found(out, *MINED)
    assert got == brute_negatives(odd_rows) and len(got) > 50
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_negatives_where_one_label_is_hot(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8)) + 1
    rows = rows_of(x, labels=[0 if k % 3 else 1 + k % 5 for k in range(900)])
    assert found(negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)), *MINED) == brute_negatives(rows)
