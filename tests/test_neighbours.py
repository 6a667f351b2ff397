import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from labelwright.operators import distance, knn


def words(rng, n, vocabulary):
    """Words of a skewed vocabulary: few are in most rows."""
    return " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(n))


def brute(queries, base, k, both_empty=0.0):
    out = []
    sets = lambda t: set((t or "").lower().split())
    for q, text in queries:
        d = sorted(((1 - len(sets(text) & sets(t)) / len(sets(text) | sets(t))) if sets(text) | sets(t) else both_empty, i) for i, t in base)
        out += [(q, r + 1, round(x, 12), i) for r, (x, i) in enumerate(d[:k])]
    return sorted(out, key=repr)


def frames(spark, queries, base):
    return spark.createDataFrame(queries, "row_id long, text string"), spark.createDataFrame([(i, t, i % 3) for i, t in base], "row_id long, text string, label long")


def found(df, base, k, **more):
    return sorted(((r.query_id, r["rank"], round(r.distance, 12), r.base_id) for r in knn.knn_neighbours(df, base, k, **more).collect()), key=repr)


@pytest.mark.parametrize("listed", [0, 1, 64, 10**9])
def test_index_and_tiles_give_the_same(spark, monkeypatch, listed):
    monkeypatch.setattr(knn, "LISTED", listed)  # from always the index to never, but for rows without tokens
    rng = random.Random(listed + 1)
    base = [(3 * i, words(rng, rng.randint(0, 12), 300)) for i in range(250)] + [(1000, ""), (1001, None), (1002, "rare alone")]
    queries = [(i, words(rng, rng.randint(1, 12), 300)) for i in range(30)] + [(100, ""), (101, None), (102, "nobody has these"), (103, "rare nobody"), (104, base[7][1]), (105, "w0")]
    df, b = frames(spark, queries, base)
    for k in (1, 4):
        assert found(df, b, k) == brute(queries, base, k)
    assert found(df, b, 2, tokens="ascii") == brute(queries, base, 2, 1.0)


def test_no_answers(spark):
    df, base = frames(spark, [(1, "a"), (2, "b")], [(1, "a"), (2, "c")])
    assert found(df, base, 0) == [] and found(df, base, 3) == []
    assert found(df.limit(0), base, 1) == [] and found(df, base.limit(0), 1) == []
    assert found(df, base, 2) == brute([(1, "a"), (2, "b")], [(1, "a"), (2, "c")], 2)


def test_candidates_dont_grow_as_the_base(spark):
    """Messages about something: of ten times the base a query compares far fewer than ten times the rows."""
    rng = random.Random(4)
    topic = lambda: " ".join(f"t{rng.randrange(40_000)}" for _ in range(9)) + f" w{rng.randrange(8)}"
    made = [topic() for _ in range(2_000)]
    queries = [(i, made[i] + " more") for i in range(0, 200, 5)]
    seen = []
    for n in (200, 2_000):
        df, base = frames(spark, queries, list(enumerate(made[:n])))
        ways = knn.knn_ways(df, base, 1).collect()
        assert all(r.within < 0.2 for r in ways)
        assert n == 200 or all(r.indexed for r in ways)
        seen.append(sum(r.listed for r in ways) / len(ways))
    assert seen[1] < 3 * seen[0] and seen[1] < 10
    assert rows(knn.knn_neighbours(df, base, 1).select("base_id")) == sorted([(i,) for i, _ in queries], key=repr)


def test_index_first_gives_the_same(spark, monkeypatch):
    """Few pairs go by tiles alone; here an index goes first, for all queries or for those of short lists."""
    monkeypatch.setattr(knn, "FEW_PAIRS", -1)
    monkeypatch.setattr(knn, "_pays", lambda *a: True)
    rng = random.Random(8)
    base = [(3 * i, words(rng, rng.randint(0, 12), 300)) for i in range(250)] + [(1000, ""), (1001, None), (1002, "rare alone")]
    queries = [(i, words(rng, rng.randint(1, 12), 300)) for i in range(20)] + [(100, ""), (102, "nobody has these"), (103, "rare nobody"), (104, base[7][1]), (105, "w0")]
    df, b = frames(spark, queries, base)
    for listed in (0, 16):
        monkeypatch.setattr(knn, "LISTED", listed)
        assert found(df, b, 3) == brute(queries, base, 3)


def test_lists_of_many_rows_go_by_tiles(spark):
    """A row from a list moves two whole sets, so a query takes no more of them when the base grows."""
    base = [(i, f"g{i // 40}") for i in range(4_000)]
    queries = [(i, f"g{i} more") for i in range(5)]
    df, b = frames(spark, queries, base)
    assert not any(r.indexed for r in knn.knn_ways(df, b, 1).collect())
    assert found(df, b, 1) == brute(queries, base, 1)


def test_blocks_arent_repeated(spark, monkeypatch):
    """Each block is kept once whatever the number of partitions, and a task hands on k rows a query."""
    rng = random.Random(9)
    base = [(i, words(rng, 8, 300)) for i in range(300)]
    monkeypatch.setattr(knn, "QUERY_BLOCK", 10)
    monkeypatch.setattr(knn, "BASE_BLOCK", 10)
    df, b = frames(spark, base[:40], base)
    plan = knn.knn_neighbours(df, b, 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "explode" not in plan.lower()
    assert found(df, b, 2) == brute(base[:40], base, 2)


def test_few_base_rows_need_no_order_of_the_queries(spark, monkeypatch):
    """Queries meet a base of one block where they were read: nothing is dealt by size, and the answers are those of the ordered way."""
    rng = random.Random(10)
    base = [(i, words(rng, rng.randint(0, 9), 200)) for i in range(60)] + [(90, ""), (91, None)]
    queries = [(i, words(rng, rng.randint(0, 9), 200)) for i in range(50)] + [(70, "nobody has these"), (71, None)]
    df, b = frames(spark, queries, base)
    with monkeypatch.context() as m:
        m.setattr(type(df), "repartitionByRange", None)
        few = found(df.repartition(3), b.repartition(4), 3)
    assert few == brute(queries, base, 3)
    monkeypatch.setattr(knn, "FEW_ROWS", 0)
    assert found(df, b, 3) == few


def test_a_task_is_told_a_block_once(spark):
    """Of blocks that meet in many tiles, each range's are sent to its Python process once, and every pair is still met."""
    df, _ = frames(spark, [(i, f"a w{i} w{i % 7}") for i in range(60)], [(0, "a")])
    every = distance.token_sets(df).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long")}).coalesce(1)
    pairs = distance.tiles(distance.blocks(every, 10), distance.blocks(every, 20))
    sent = pairs.agg(F.count("*"), F.count("q_hashes"), F.count("b_hashes")).first()
    assert tuple(sent) == (18, 6, 3)  # one range of either side
    assert distance.pairwise_distances(df).count() == 60 * 59 // 2
