import itertools
import math
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from labelwright.operators import bayes, cluster, distance, evaluate, knn, wordlist
from labelwright.plans import evaluations, queries

TEXTS = ["le chat noir dort", "le chien noir court", "un chat blanc", "", "   ", "chat chat chien", "rien de commun ici", "le chat noir dort bien", "zzz", "court le chien"]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, (0, 2, 4)[i % 3], t) for i, t in enumerate(TEXTS)], "row_id long, label int, text string").cache()


def jaccard(a, b, empty):
    a, b = set(a.split()), set(b.split())
    return empty if not a | b else (len(a | b) - len(a & b)) / len(a | b)


def test_distances(spark, base):
    got = {(r.i, r.j): r.distance for r in distance.pairwise_distances(base, "ws", dense=True).collect()}
    assert got == {(i, j): jaccard(TEXTS[i], TEXTS[j], 0.0) for i, j in itertools.combinations(range(len(TEXTS)), 2)}
    sparse = {(r.i, r.j): r.distance for r in distance.pairwise_distances(base, "ascii").collect()}
    assert sparse == {k: jaccard(TEXTS[k[0]], TEXTS[k[1]], 1.0) for k in got if jaccard(TEXTS[k[0]], TEXTS[k[1]], 1.0) < 1}


def test_neighbours_and_votes(spark, base):
    got = knn.knn_neighbours(base, base, 3).orderBy("query_id", "rank").collect()
    for q, own in itertools.groupby(got, lambda r: r.query_id):
        want = sorted((jaccard(TEXTS[q], t, 0.0), i) for i, t in enumerate(TEXTS))[:3]
        assert [(r.distance, r.base_id) for r in own] == want
    assert knn.knn_neighbours(base, base, 0).count() == 0 == knn.knn_neighbours(base, base, len(TEXTS) + 1).count()
    assert knn.knn_neighbours(base, base.limit(0), 1).count() == 0
    n = spark.createDataFrame([(1, i + 1, 0.5, i, lab) for i, lab in enumerate((4, 0, 0, 4, 2))], "query_id long, rank int, distance double, base_id long, label int")
    assert knn.vote(n).first().estimated == 4
    w = spark.createDataFrame([(1, 1, 0.0, 0, 4), (1, 2, 0.5, 1, 0), (1, 3, 0.5, 2, 0)], n.schema)
    assert knn.vote(w, "weighted").first().estimated == 4 and knn.vote(w).first().estimated == 0


def test_blocks_dont_matter(spark, base, monkeypatch):
    want = rows(knn.knn_neighbours(base, base, 3))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    monkeypatch.setattr(knn, "BASE_BLOCK", 3)
    assert rows(knn.knn_neighbours(base.repartition(3), base.repartition(2), 3)) == want


@pytest.mark.parametrize(("pos", "neg", "weight", "out"), [(3, 2, 0.6, 2), (1, 0, 1.0, 4), (0, 0, 0.5, 2), (1, 3, 0.5, 0), (1, 1, 0.5, 2), (0, 1, 1.0, 0)])
def test_polarity(spark, pos, neg, weight, out):
    assert spark.range(1).select(wordlist.polarity_label(F.lit(pos), F.lit(neg), weight).alias("x")).first().x == out


def test_wordlist(spark):
    words = spark.createDataFrame([("good", "pos"), ("bad", "neg"), ("good", "neg"), ("two words", "pos")], "word string, polarity string")
    df = spark.createDataFrame([(1, "Good, GOOD bad!"), (2, "nothing"), (3, None), (4, "two words")], "row_id long, text string")
    assert rows(wordlist.polarity_counts(df, words).select("row_id", "pos", "neg")) == [(1, 2, 1), (2, 0, 0), (3, 0, 0), (4, 0, 0)]
    assert rows(wordlist.annotate_wordlist(df, words).select("row_id", "rating")) == [(1, 2), (2, 2), (3, 2), (4, 2)]


def bayes_by_hand(train, texts, alpha, presence):
    def tokens(t):
        u = [w.lower() for w in t.split() if len(w) >= 4]
        x = u + [f"{a} {b}" for a, b in itertools.pairwise(u)]
        return sorted(set(x)) if presence else x

    priors, counts = Counter(y for y, _ in train), {}
    for y, t in train:
        counts.setdefault(y, Counter()).update(tokens(t))
    vocab = set().union(*counts.values())
    out = []
    for t in texts:
        score = {y: math.log(priors[y] / len(train)) + sum(math.log((counts[y][w] + alpha) / (sum(counts[y].values()) + alpha * len(vocab))) for w in tokens(t) if w in vocab) for y in priors}
        out.append(score)
    return out


@pytest.mark.parametrize(("alpha", "repr_"), [(1.0, "frequency"), (0.5, "presence")])
def test_bayes(spark, base, alpha, repr_):
    model = bayes.train_bayes(base, alpha, repr_)
    want = bayes_by_hand([((0, 2, 4)[i % 3], t) for i, t in enumerate(TEXTS)], TEXTS, alpha, repr_ == "presence")
    got = {(r.row_id, r.label): r.score for r in bayes.bayes_scores(base, model).collect()}
    assert got.keys() == {(i, y) for i in range(len(TEXTS)) for y in (0, 2, 4)}
    assert all(abs(got[i, y] - want[i][y]) < 1e-9 for i, y in got)
    best = dict(rows(bayes.bayes_argmax(bayes.bayes_scores(base, model))))
    assert all(best[i] == max(w, key=lambda y: (round(w[y], 9), -y)) for i, w in enumerate(want))


def test_bayes_takes_any_labels(spark):
    df = spark.createDataFrame([(1, "good things", 1), (2, "awful things", 3), (3, "nothing", 3), (4, "lost", None)], "row_id long, text string, label int")
    model = bayes.train_bayes(df)
    assert {r.label for r in bayes.bayes_scores(df, model).collect()} == {1, 3}
    assert dict(rows(bayes.classify_bayes(df, model).select("row_id", "estimated"))) == {1: 1, 2: 3, 3: 3, 4: 3}
    assert bayes.bayes_scores(df, bayes.train_bayes(df.limit(0))).count() == 0


def test_bayes_counts_add_up(spark, base, tmp_path):
    halves = [base.filter(f"row_id % 2 = {k}") for k in (0, 1)]
    whole = bayes.bayes_scores(base, bayes.train_bayes(base, "lidstone"))
    one, two = map(bayes.count_bayes, halves)
    same = lambda df: [(i, k, round(x, 9)) for i, k, x in rows(df)]
    assert same(bayes.bayes_scores(base, bayes.bayes_model(one + two, "lidstone"))) == same(whole)
    for k, counts in enumerate((one, two, one)):  # the first batch comes twice and counts once
        counts.append(str(tmp_path / "kept"), str(k % 2))
    assert same(bayes.bayes_scores(base, bayes.bayes_model(bayes.BayesCounts.load(spark, str(tmp_path / "kept")), "lidstone"))) == same(whole)
    with pytest.raises(ValueError, match="add up"):
        one + bayes.count_bayes(base, "presence")


def test_bayes_saved(spark, base, tmp_path):
    model = bayes.train_bayes(base)
    model.save(str(tmp_path / "m"))
    assert rows(bayes.bayes_scores(base, bayes.BayesModel.load(spark, str(tmp_path / "m")))) == rows(bayes.bayes_scores(base, model))


def test_split_and_matrix(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.when(F.col("id") < 5, 0).when(F.col("id") < 900, 2).otherwise(4)).alias("label"), F.lit("x").alias("text"))
    done = evaluate.stratified_split(df, seed=3)
    assert dict(rows(done.filter("is_train").groupBy("label").count())) == {0: 3, 2: 596, 4: 66} and done.count() == 1000
    assert rows(evaluate.stratified_split(df.repartition(7), seed=3)) == rows(done) != rows(evaluate.stratified_split(df, seed=4))
    assert evaluate.stratified_split(df.limit(0)).count() == 0
    pred = spark.createDataFrame([(0, 0), (0, 4), (2, 7), (4, 4), (4, 4)], "real int, estimated int")
    cells = {(r.real, r.estimated): r.n for r in evaluate.confusion_totals(pred).collect()}
    assert cells[0, 4] == 1 and cells[4, 4] == 2 and cells[None, 4] == 3 and cells[None, None] == 4 and len(cells) == 16
    assert evaluate.accuracy(pred).first().accuracy == 0.75


def brute_merges(d, method):
    groups = [[i] for i in range(len(d))]

    def far(a, b):
        own = d[np.ix_(a, b)]
        if method == "average":
            return own.mean()
        if method == "complete":
            return own.max()
        sq = lambda x, y: (d[np.ix_(x, y)] ** 2).mean()
        return math.sqrt(max(0.0, 2 * len(a) * len(b) / (len(a) + len(b)) * (sq(a, b) - sq(a, a) / 2 - sq(b, b) / 2)))

    out = []
    while len(groups) > 1:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: far(groups[p[0]], groups[p[1]]))
        out.append((far(groups[i], groups[j]), frozenset(groups[i] + groups[j])))
        groups[i] += groups.pop(j)
    return sorted(out, key=lambda x: (x[0], len(x[1])))


@pytest.mark.parametrize("method", cluster.METHODS)
def test_linkage(spark, method):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.choice(40, rng.integers(9, 17), replace=False)) for _ in range(12)]
    df = spark.createDataFrame([(i * 3, t, int(i % 3) * 2) for i, t in enumerate(texts)], "row_id long, text string, label int")
    merges = cluster.linkage(df, method)
    got = merges.orderBy("step").collect()
    d = np.array([[jaccard(a, b, 1.0) for b in texts] for a in texts])
    np.fill_diagonal(d, 0)
    want = brute_merges(d, method)
    assert np.allclose([r.dissimilarity for r in got], [h for h, _ in want])
    members = {i: frozenset([i]) for i in range(12)}
    for r in got:
        members[r.new_cluster] = members[r.cluster1] | members[r.cluster2]
        assert r.size == len(members[r.new_cluster])
    assert len({round(h, 9) for h, _ in want}) == 11 and [members[r.new_cluster] for r in got] == [m for _, m in want]
    used = [c for r in got for c in (r.cluster1, r.cluster2)]
    assert sorted(used) == list(range(22)) and [r.new_cluster for r in got] == list(range(12, 23)) and got[-1].size == 12
    assert all(c < r.new_cluster for r in got for c in (r.cluster1, r.cluster2))
    parts = cluster.cut(merges, df, 3)
    assert parts.select("cluster").distinct().count() == 3 and parts.count() == 12
    with pytest.raises(ValueError):
        cluster.cut(merges, df, 13)


@pytest.mark.parametrize("method", ["average", "complete"])
def test_trees_are_the_same_in_rounds_and_units(spark, method):
    """Components apart, ties everywhere, rows without tokens: merged in one task, or by rounds of joins until components are small."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'xyz'[i % 3]}{x}" for x in rng.choice(6, 3, replace=False)) for i in range(36)] + ["", "alone", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    want = rows(cluster.linkage(df, method).select("step", "cluster1", "cluster2", "new_cluster", F.round("dissimilarity", 9), "size"))
    for pairs in (20, 60):
        assert rows(cluster.linkage(df, method, unit_pairs=pairs).select("step", "cluster1", "cluster2", "new_cluster", F.round("dissimilarity", 9), "size")) == want
    d = np.array([[jaccard(a or "", b or "", 1.0) for b in texts] for a in texts])
    np.fill_diagonal(d, 0)
    members = {i: [i] for i in range(len(texts))}
    for _, x, y, new, h, size in sorted(want):
        own = d[np.ix_(members[x], members[y])]
        assert abs((own.mean() if method == "average" else own.max()) - h) < 1e-8
        members[new] = members.pop(x) + members.pop(y)
        assert len(members[new]) == size
    assert len(members) == 1 and [r[4] for r in sorted(want)] == sorted(r[4] for r in want)


def test_no_most_rows(spark):
    n = 2_600
    df = spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("g"), (F.col("id") % 900).cast("string")).alias("text"))
    merges = cluster.linkage(df)
    assert merges.count() == n - 1 and merges.filter("dissimilarity = 0").count() == n - 900 and merges.filter("dissimilarity = 1").count() == 899
    assert merges.agg(F.max("size")).first()[0] == n and cluster.cut(merges, df, 900).select("cluster").distinct().count() == 900
    with pytest.raises(ValueError, match="Ward"):
        cluster.linkage(df, "ward")
    assert cluster.linkage(df.limit(1)).count() == cluster.linkage(df.limit(0)).count() == 0


def test_cluster_labels(spark):
    df = spark.createDataFrame([(1, 4), (2, 4), (3, 0), (4, 0), (5, 2)], "row_id long, label int")
    member = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 9)], "row_id long, cluster long")
    assert rows(cluster.cluster_labels(df, member)) == [(1, 4), (4, 0), (9, 2)]


def test_evaluations(spark, base):
    words = spark.createDataFrame([("chat", "pos"), ("chien", "neg")], "word string, polarity string")
    n = evaluate.stratified_split(base).filter("NOT is_train").count()
    assert evaluations.evaluate_wordlist(base, words).count() == evaluations.evaluate_knn(base, 2).count() == evaluations.evaluate_bayes(base).count() == n
    assert evaluations.evaluate_cluster(base, 2).count() == n


def test_rows_outside_the_tree_vote(spark):
    texts = ["red apple", "blue sky"]
    data = [(i, texts[i % 2], 0 if i % 2 else 4) for i in range(40)]
    df = spark.createDataFrame(data, "row_id long, text string, label int")
    fitted = {r.row_id for r in df.orderBy(F.md5(F.concat(F.col("row_id").cast("string"), F.lit("|fit"))), "row_id").limit(4).collect()}
    assert {i % 2 for i in fitted} == {0, 1}
    # The fitted rows' own labels are the wrong ones; the many outside outvote them.
    base = df.withColumn("label", F.when(F.col("row_id").isin(fitted), 2).otherwise(F.col("label")))
    asked = spark.createDataFrame([(100, "red apple"), (101, "blue sky")], "row_id long, text string")
    got = cluster.classify_cluster(asked, base, 2, fit_rows=4)
    assert rows(got.select("row_id", "estimated")) == [(100, 4), (101, 0)]


def test_registered_evaluation_has_the_stated_bound(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(queries.evaluations, "evaluate_cluster", lambda df, k, **more: asked.update(more))
    monkeypatch.setattr(queries, "labelled", lambda spark, sf_dir: None)
    monkeypatch.setattr(queries.evaluate, "confusion_matrix", lambda df: df)
    queries.QUERIES["evaluate_cluster"](spark, "")
    assert asked.get("fit_rows", cluster.FIT_ROWS) == cluster.FIT_ROWS == 2_000


def test_columns_of_the_results_names(spark, base):
    """A table that already has the columns a labeller adds gets them replaced."""
    words = spark.createDataFrame([("chat", "pos"), ("chien", "neg")], "word string, polarity string")
    odd = base.withColumns({"pos": F.lit("x"), "neg": F.lit("y"), "estimated": F.lit("z")})
    for got in (wordlist.classify_wordlist(odd, words), knn.classify_knn(odd, base, 2), bayes.classify_bayes(odd, bayes.train_bayes(base)), cluster.classify_cluster(odd, base, 2)):
        assert got.columns.count("estimated") == 1 and got.select("estimated").filter("estimated IN (0, 2, 4)").count() == base.count()


def test_likelihoods_arent_dealt_by_label(spark, base):
    """Three labels make three groups: counts stay where they are and meet a row a label."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bayes.train_bayes(base).likelihood._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "BroadcastHashJoin" in joins[0]


def test_a_fitted_tree_is_one_unit():
    """All pairs of the rows that a labeller's tree is fitted on are merged in one task, without rounds of joins."""
    assert cluster.UNIT_PAIRS >= cluster.FIT_ROWS * (cluster.FIT_ROWS - 1) // 2


@pytest.mark.parametrize("method", ["average", "complete"])
def test_dense_trees_are_the_same_by_a_matrix(spark, method, monkeypatch):
    """Rows of which most share a token are merged by rows of a matrix, ties, strangers and rows without tokens among them."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.choice(14, rng.integers(2, 6), replace=False)) for _ in range(70)] + ["", "alone", None]
    df = spark.createDataFrame([(i * 5 % 89, t) for i, t in enumerate(texts)], "row_id long, text string")
    columns = ["step", "cluster1", "cluster2", "new_cluster", F.round("dissimilarity", 9), "size"]
    want = rows(cluster.linkage(df, method).select(*columns))
    for name in ("_round", "_components"):
        monkeypatch.setattr(cluster, name, None)
    assert rows(cluster.linkage(df, method, unit_pairs=600).select(*columns)) == want


@pytest.mark.parametrize("method, large, listed", [("average", 2, 1), ("complete", 16, 4)])
def test_dense_trees_are_merged_without_a_stored_matrix(spark, method, large, listed, monkeypatch):
    """Whatever is kept of clusters between rounds, the tree is the same, and no table of all pairs is written."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.choice(13, rng.integers(2, 6), replace=False)) for _ in range(36)] + ["", "alone", None]
    df = spark.createDataFrame([(i * 5 % 89, t) for i, t in enumerate(texts)], "row_id long, text string")
    columns = ["step", "cluster1", "cluster2", "new_cluster", F.round("dissimilarity", 9), "size"]
    want = rows(cluster.linkage(df, method).select(*columns))
    for name, value in (("LARGE", large), ("LEAST_NEXT", listed), ("MOST_NEXT", listed), ("ASKED", 90)):
        monkeypatch.setattr(cluster.matrix, name, value)
    written = []
    keep = cluster.matrix.stored
    monkeypatch.setattr(cluster.matrix, "stored", lambda df, *a, **b: written.append((found := keep(df, *a, **b))) or found)
    assert rows(cluster.linkage(df, method, unit_pairs=20).select(*columns)) == want
    assert max(t.count() for t in written) <= len(texts)  # no row a pair
    assert sum(len(r.cells) for t in written if "cells" in t.columns for r in t.collect()) < 8 * 20 * 20  # cells of the last clusters only


def test_trees_are_of_the_whole_base(spark, monkeypatch):
    """A base above ``FIT_ROWS`` rows isn't sampled for the tree, unless a caller asks for it."""
    base = spark.range(cluster.FIT_ROWS + 1).select(F.col("id").alias("row_id"), F.lit("a").alias("text"), F.lit(0).alias("label"))
    seen = []
    monkeypatch.setattr(cluster, "linkage", lambda df, *more: seen.append(df.count()) or df)
    monkeypatch.setattr(cluster, "classify_by_tree", lambda df, base, tree, *more: df)
    cluster.classify_cluster(base, base)
    assert seen == [cluster.FIT_ROWS + 1]
    cluster.fit_tree(base, fit_rows=5)
    assert seen[1:] == [5]
