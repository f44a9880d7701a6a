"""Folds of whole groups stay even however uneven the groups are."""

import random
from collections import Counter

import pytest

from terrapix.operators.folds import balanced_group_folds


def groups(seed, n=800):
    """Groups of very different sizes, mostly of one class each."""
    rng = random.Random(seed)
    rows, row = [], 0
    for g in range(n):
        cls = rng.choices("abc", [5, 3, 2])[0]
        for _ in range(max(1, int(rng.paretovariate(1.1)) if g % 5 else rng.randrange(20, 60))):
            rows.append((row, g, cls if rng.random() < 0.9 else "a"))
            row += 1
    cap = len(rows) // 150  # no group is a large part of a fold
    size = Counter()
    return [r for r in rows if not size.update([r[1]]) and size[r[1]] <= cap]


@pytest.mark.parametrize("seed", range(3))
def test_folds_are_even_and_groups_whole(spark, seed):
    rows = groups(seed)
    df = spark.createDataFrame(rows, "id long, g long, c string")
    fold = {r.g: r.fold for r in balanced_group_folds(df, "g", "c", 5).collect()}
    assert set(fold) == {g for _, g, _ in rows}
    total = Counter(fold[g] for _, g, _ in rows)
    assert set(total) == set(range(5)) and max(total.values()) <= 1.2 * min(total.values())
    share = {c: sum(x == c for *_, x in rows) / len(rows) for c in "abc"}
    for f in range(5):
        own = [c for _, g, c in rows if fold[g] == f]
        assert all(abs(own.count(c) / len(own) - share[c]) < 0.05 for c in "abc")


def test_folds_do_not_depend_on_partitions_and_nulls_are_a_class(spark):
    rows = [(k, k % 9, None if k % 9 == 4 else "ab"[k % 2]) for k in range(60)] + [(99, None, "a")]
    one = balanced_group_folds(spark.createDataFrame(rows, "id long, g long, c string").where("g is not null"), "g", "c", 3)
    two = balanced_group_folds(spark.createDataFrame(rows[::-1], "id long, g long, c string").where("g is not null").repartition(7), "g", "c", 3)
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 9
