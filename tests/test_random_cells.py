"""Random cells against a plain Python model of the missing-value rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lattica import NA, NM, Series
from lattica import reducers as R

SEEDS = range(4)


def draw(rng, n):
    return [("abcd"[rng.randrange(4)], rng.choices([rng.randint(-9, 9), NA, NM], (60, 25, 3))[0]) for _ in range(n)]


def groups(pairs):
    out = {}
    for k, c in pairs:
        out.setdefault(k, []).append(c)
    return dict(sorted(out.items()))


def is_value(c):
    return c is not NA and c is not NM


@pytest.mark.parametrize("seed", SEEDS)
def test_reducers(spark, seed):
    pairs = draw(random.Random(seed), 60)
    s = Series.of(spark, pairs, "string", "int")

    def guarded(f):
        return lambda cs: NM if NM in cs else f([c for c in cs if is_value(c)])

    def first_n(n):
        def run(cs):
            seen = [c for c in cs if c is not NA][:n]
            return NM if NM in seen else seen if len(seen) == n else NA

        return run

    model = {
        R.Count: guarded(len),
        R.Sum: guarded(sum),
        R.Max: guarded(lambda v: max(v) if v else NA),
        R.Unique: guarded(lambda v: sorted(set(v))),
        R.First: lambda cs: next((c for c in cs if c is not NA), NA),
        R.Last: lambda cs: next((c for c in reversed(cs) if c is not NA), NA),
        (lambda: R.FirstN(3)): first_n(3),
        (lambda: R.ForAll(lambda v: v < 8)): lambda cs: NM not in cs and all(c < 8 for c in cs if is_value(c)),
        (lambda: R.Exists(lambda v: v > 7)): lambda cs: any(c > 7 for c in cs if is_value(c)),
    }
    for make, f in model.items():
        assert s.reduce_by_key(make()).to_list() == [(k, f(cs)) for k, cs in groups(pairs).items()]


@pytest.mark.parametrize("seed", SEEDS)
def test_pairs(spark, seed):
    rng = random.Random(100 + seed)
    left, right = draw(rng, 25), draw(rng, 25)
    a, b = Series.of(spark, left, "string", "int"), Series.of(spark, right, "string", "int")
    l, r = groups(left), groups(right)  # noqa: E741

    def zipped(x, y):
        return x + y if is_value(x) and is_value(y) else NA if NA in (x, y) else NM

    def or_else(x, y):
        return x if is_value(x) else y if is_value(y) else NM if NM in (x, y) else NA

    assert a.zip_map(b, lambda x, y: x + y).to_list() == [(k, zipped(x, y)) for k in l if k in r for x in l[k] for y in r[k]]
    merged = [(k, (l.get(k, []) + [NA] * 99)[i], (r.get(k, []) + [NA] * 99)[i]) for k in sorted(l | r) for i in range(max(len(l.get(k, [])), len(r.get(k, []))))]
    assert a.or_else(b).to_list() == [(k, or_else(x, y)) for k, x, y in merged]
    assert a.roll_forward().size() == 25
    assert a.cell_map(lambda c: c.map(lambda v: F.abs(v))).cells() == [abs(c) if is_value(c) else c for _, c in left]
