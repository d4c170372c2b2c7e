"""Ranking, caps with back-fill and greedy duplicate removal against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from gazette.operators.ranking import greedy_dedup, ranked, select_for_digest

DAY = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord long, name string, source string, score double, published timestamp")


def plain_select(rows, limit, cap):
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][2], -rows[k][3].timestamp(), k))
    taken, over, count = [], [], {}
    for k in order:
        count[rows[k][1]] = count.get(rows[k][1], 0) + 1
        (taken if cap is None or count[rows[k][1]] <= cap else over).append(k)
    chosen = (taken + over)[: limit if limit and limit > 0 else None]
    return [rows[k][0] for k in sorted(chosen, key=lambda k: (-rows[k][2], -rows[k][3].timestamp()))]


def selected(spark, rows, limit, cap):
    return [r.name for r in select_for_digest(frame(spark, rows), limit, cap).orderBy("position").collect()]


@pytest.mark.parametrize(
    ("rows", "limit", "cap", "expected"),
    [
        ([("low", "a", 0.5), ("top", "b", 0.9), ("mid", "c", 0.7)], None, None, ["top", "mid", "low"]),
        ([("a1", "a", 0.9), ("a2", "a", 0.88), ("a3", "a", 0.86), ("b1", "b", 0.8)], 3, 2, ["a1", "a2", "b1"]),
        ([("a1", "a", 0.9), ("a2", "a", 0.88), ("a3", "a", 0.86)], 3, 1, ["a1", "a2", "a3"]),
        ([("a1", "a", 0.9), ("a2", "a", 0.88), ("b1", "b", 0.8)], 2, None, ["a1", "a2"]),
        ([("a1", "a", 0.9)], 5, 9, ["a1"]),
        ([], 5, 2, []),
    ],
)
def test_cases(spark, rows, limit, cap, expected):
    assert selected(spark, [(*r, DAY) for r in rows], limit, cap) == expected


def test_ties_put_capped_picks_first(spark):
    rows = [("a1", "a", 0.8, DAY), ("a2", "a", 0.8, DAY), ("b1", "b", 0.8, DAY)]
    assert selected(spark, rows, 3, 1) == ["a1", "b1", "a2"]


def test_random_selections(spark):
    r = random.Random(5)
    for _ in range(16):
        rows = [(f"n{k}", r.choice("abc"), r.randint(0, 4) / 4, DAY + timedelta(hours=r.randint(0, 3))) for k in range(r.randint(1, 14))]
        limit, cap = r.choice([1, 3, 5, 20, None]), r.choice([None, 1, 2])
        assert selected(spark, rows, limit, cap) == plain_select(rows, limit, cap)


def test_ranks_are_a_permutation(spark):
    r = random.Random(6)
    rows = [(f"n{k}", "s", r.randint(0, 3) / 4, DAY + timedelta(hours=r.randint(0, 60))) for k in range(200)]
    got = [x.name for x in ranked(frame(spark, rows)).orderBy("rank").collect()]
    assert got == plain_select(rows, None, None)


def plain_greedy(rows):
    links, keys, out = set(), set(), []
    for k, (link, key) in enumerate(rows):
        if link in links or key and key in keys:
            continue
        links.add(link)
        keys |= {key} - {""}
        out.append(k)
    return out


def deduped(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord long, link string, title_key string")
    return sorted(r.ord for r in greedy_dedup(df).collect())


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("l1", "X"), ("l2", "X"), ("l2", "Y")], [0, 2]),
        ([("l1", "X"), ("l1", "Y"), ("l2", "Y")], [0, 2]),
        ([("l1", ""), ("l2", ""), ("l3", "")], [0, 1, 2]),
        ([], []),
    ],
)
def test_greedy_cases(spark, rows, expected):
    assert deduped(spark, rows) == expected


def test_greedy_random(spark):
    r = random.Random(7)
    for n in (20, 60, 200):
        rows = [(f"l{r.randint(0, n // 2)}", r.choice(["", *[f"k{x}" for x in range(n // 2)]])) for _ in range(n)]
        assert deduped(spark, rows) == plain_greedy(rows)


def test_greedy_chains_fold(spark, monkeypatch):
    """300 chains of 40 rows, each row waiting for the one before, and one that is too large to be folded."""
    from gazette.operators import ranking

    rounds = []
    plain = ranking._round
    monkeypatch.setattr(ranking, "_round", lambda left, path: rounds.append(1) or plain(left, path))
    rows = [(f"l{c}-{k // 2}", f"k{c}-{(k + 1) // 2}") for k in range(40) for c in range(300)]
    assert deduped(spark, rows) == plain_greedy(rows) and len(rounds) < 5
    df = spark.createDataFrame([(k, f"l{k // 2}", f"k{(k + 1) // 2}") for k in range(12)], "ord long, link string, title_key string")
    assert sorted(r.ord for r in ranking.greedy_dedup(df, folded=3).collect()) == list(range(0, 12, 2))


def test_contributed_counts(spark):
    from gazette.operators import health

    fetched = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, ord long")
    got = health.contributed(fetched, fetched.where("ord = 1"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, "ok"), ("b", 0, 1, "ok")]
