"""Components, and one document of each group, with ids that are missing or repeated."""

import random

import pytest

from spanwarden.llm import components, neardup
from spanwarden.llm.common import cut_counted


def brute(n, edges):
    parent = list(range(n))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("limit", [0, 100_000])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BROADCAST_NODES", limit)
    random.seed(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(random.randrange(200, 300), random.randrange(200, 300)) for _ in range(60)] + [(5, 5), (301, 300)]
    df = spark.createDataFrame(edges + edges[:5], "a long, b long")
    want = brute(302, edges)
    touched = {x for a, b in edges for x in (a, b) if a != b}
    assert {r["node"]: r["component"] for r in components.components(df, "a", "b").collect()} == {x: want[x] for x in touched}


def test_one_of_each_judges_rows_by_their_own_texts(spark):
    random.seed(9)
    text = lambda: " ".join(random.choices([f"w{i}" for i in range(500)], k=60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a), (5, b), (7, a), (None, a), (None, c), (None, c), (3, b + " x"), (8, None), (8, ""), (8, ""), (9, d), (9, d), (9, d)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _row int")
    left = neardup.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted((str(i), t or "") for i, t in [(5, a), (3, b + " x"), (None, c), (8, None), (8, ""), (8, ""), (9, d)])


@pytest.mark.parametrize("nodes", [0, 100_000])
@pytest.mark.parametrize("edges", [0, 10, 500_000])
def test_components_in_one_task_and_by_stars(spark, monkeypatch, nodes, edges):
    monkeypatch.setattr(components, "BROADCAST_NODES", nodes)
    monkeypatch.setattr(components, "TASK_EDGES", edges)
    random.seed(4)
    zigzag = [0, 9, 1, 8, 2, 7, 3, 6, 4, 5]
    for pairs in ([], [(3, 3)], [*zip(zigzag, zigzag[1:])], [(19, k) for k in range(19)] + [(25, 22), (22, 25)], [(random.randrange(90), random.randrange(90)) for _ in range(70)]):
        want = brute(90, pairs)
        rows = components.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()
        assert sorted((r["node"], r["component"]) for r in rows) == sorted({(x, want[x]) for a, b in pairs for x in (a, b) if a != b})


def test_rows_are_counted_as_they_are_cut(spark):
    df = spark.range(1000).filter("id % 3 = 0").repartition(7)
    for rows, n in ((df, 334), (df.filter("id < 0"), 0), (df.filter("false"), 0), (df.groupBy("id").count().filter("count > 1"), 0)):
        out, counted = cut_counted(rows)
        assert counted == out.count() == n


def test_near_duplicates_take_few_queries_of_the_driver(spark):
    """Each query costs the driver plans, threads and broadcasts, whatever its rows."""
    random.seed(6)
    base = [[f"w{random.randrange(900)}" for _ in range(80)] for _ in range(12)]
    rows = [(i, " ".join(base[i % 12][: 80 - i // 24] + [f"x{i}"] * (i // 30))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sc = spark.sparkContext
    sc.setJobGroup("near", "near duplicates")
    left = neardup.one_of_each(df).collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("near")
    assert 12 <= len(left) < 120
    assert len(jobs) <= 100, len(jobs)
