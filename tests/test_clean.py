import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from labelwright.operators import clean


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


@pytest.mark.parametrize(
    ("rule", "text", "out"),
    [
        (3, "hello @bob world", "helloworld"),
        (3, "@a @b c", "@b c"),
        (3, "@bob\n", ""),
        (2, "see http://x.y now", "see now"),
        (2, "www.a", ""),
        (4, 'wow! "q"; a:b*', "wow q ab"),
        (1, "RT hi", None),
        (1, "xRT hi", "xRT hi"),
        (0, "ok :) and :(", None),
        (0, ":( x :D", None),
        (0, ":) only", ":) only"),
        (0, ":)\n:(", ":)\n:("),
    ],
)
def test_each_rule(spark, rule, text, out):
    got = clean.apply_rules(frame(spark, [text]), [clean.default_rules()[rule]]).collect()
    assert [r.text for r in got] == ([] if out is None else [out])


def test_chain_audit_counts(spark):
    df = frame(spark, ["RT :) :(", "RT @a b!", "@a b!", "fine", None, "x http://y @z !"])
    rules = clean.default_rules()
    assert rows(clean.apply_rules(df, rules)) == [(2, "b"), (3, "fine"), (5, "x")]
    counts = dict(rows(clean.rule_counts(df, rules)))
    assert counts == {"mixed emotions deletion": 1, "retweet deletion": 1, "url trim": 1, "user trim": 2, "punctuation trim": 2}
    audit = rows(clean.rule_audit(df, rules).select("row_id", "rule_no", "action", "after"))
    assert (0, 0, "delete", None) in audit and (2, 4, "trim", "b") in audit and len(audit) == 7


@pytest.mark.parametrize(
    ("pattern", "to", "text", "out"),
    [
        (r"(\w+) (\w+)", "$2 $1", "one two", "two one"),
        (r"(?<y>\d+)-(?<m>\d+)", "${m}/$y", "2024-05", "05/2024"),
        (r"(\d)", "${1}0", "a1", "a10"),
        (r"(\d)", "$1a", "a1", "a"),
        (r"(\d)", "$$1 $ \\", "a1", "a$1 $ \\"),
        (r"(\d)", "$2$x", "a1b", "ab"),
        (r"[(]\((?:x)(y)\Q(\E", "<$1>", "((xy(", "<y>"),
        ("(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)", "${1}0$10", "abcdefghij", "a0j"),
    ],
)
def test_groups_in_replacements(spark, pattern, to, text, out):
    assert clean.apply_rules(frame(spark, [text]), [clean.replace("r", pattern, to)]).first().text == out


def test_replace_takes_plain_text(spark):
    assert clean.apply_rules(frame(spark, ["a1b"]), [clean.replace("digit", "[0-9]", r"$\1", plain=True)]).first().text == r"a$\1b"


def test_a_replacement_by_itself_is_counted(spark):
    df = frame(spark, ["a1", "b"])
    assert rows(clean.rule_counts(df, [clean.replace("same", "[0-9]", "$0")])) == [("same replacement", 1)]
    assert clean.rule_counts(df, []).count() == 0


def test_one_pass_gives_all(spark, tmp_path):
    texts = ["RT :) :(", "RT @a b!", "@a b!", "fine", None, "x http://y @z !", "fine!", "fine"]
    frame(spark, texts).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    rules = clean.default_rules()
    done = clean.clean_pass(df, rules)
    assert rows(done.rows) == rows(clean.clean(df, rules))
    assert rows(done.audit) == rows(clean.rule_audit(df, rules)) and rows(done.counts) == rows(clean.rule_counts(df, rules))
    assert done.duplicates.first().n == clean.dup_count(clean.apply_rules(df, rules)).first().n == 2
    for one in (done.rows, done.audit, done.counts, done.duplicates):  # none of them reads the source again
        assert str(tmp_path / "in") not in one._jdf.queryExecution().toString()
    assert clean.clean_pass(df, rules, audit=False).audit is None
    assert rows(clean.clean_pass(df.limit(0), rules).counts) == sorted((n, 0) for n, _ in rows(done.counts))


def test_first_rows_are_found_by_hashing(spark):
    df = frame(spark, ["a", "b", "a"]).repartition(3)
    plan = clean.dedup_keep_first(df)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_order_is_stable():
    a, b, c = clean.trim("a", "x"), clean.delete("b", "y"), clean.replace("c", "z", "")
    assert clean.order_rules([a, c, b]) == [b, c, a] and clean.trim("n", "x") == clean.trim("m", "x")


def test_keep_first_and_clash_of_names(spark):
    df = spark.createDataFrame([(2, "a", 1), (1, "a", 2), (3, "b", 3), (4, None, 4), (5, None, 5)], "row_id long, text string, r long")
    assert rows(clean.dedup_keep_first(df)) == [(1, "a", 2), (3, "b", 3), (4, None, 4)]
    assert clean.dup_count(df).first().n == 2
    assert clean.dup_count(df.limit(0)).first().n == 0
    once = clean.dedup_keep_first(df)
    assert rows(clean.dedup_keep_first(once)) == rows(once)


def test_rating(spark):
    df = spark.createDataFrame([("4",), ("x",), (None,)], "r string")
    assert [x.rating for x in clean.assign_rating(df, "r").collect()] == [4, 2, 2]
    assert [x.rating for x in clean.assign_rating(df).collect()] == [2, 2, 2]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=":)(D RTab@.\n", max_size=12), max_size=20))
def test_partitions_dont_matter(spark, texts):
    df = frame(spark, texts or [""])
    one, many = (rows(clean.clean(df.repartition(n))) for n in (1, 5))
    assert one == many
    assert all(not any(c in t for c in '!?".;,:*') for _, _, t in one)


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a!", 5)], "row_id long, text string, `odd name` int")
    assert clean.apply_rules(df, clean.default_rules()).columns == df.columns
    assert clean.apply_rules(df.withColumn("text", F.lit(None).cast("string")), clean.default_rules()).count() == 0
