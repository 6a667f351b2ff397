import pytest
from pyspark.sql import functions as F

from labelwright.functions import text as T

MIXED = "  Été foo bar\x0bBaz\x85q  l'avion 💪 #Tag "


@pytest.mark.parametrize(
    ("f", "text", "out"),
    [
        (T.tokens_ws, MIXED, ["été", "foo", "bar", "baz", "q", "l'avion", "💪", "#tag"]),
        (T.tokens_alnum, MIXED, ["été", "foo", "bar", "baz", "q", "l", "avion", "tag"]),
        (T.tokens_ascii, MIXED, ["t", "foo", "bar", "baz", "q", "l", "avion", "tag"]),
        (T.tokens_ws, "A a b", ["a", "b"]),
        (T.tokens_alnum, "A a", ["a", "a"]),
        (T.tokens_space, "a  b1 ", ["a", "", "b1", ""]),
        (T.tokens_ws, None, []),
        (lambda c: T.ngrams(c, "bi"), "un chat très noir", ["chat très", "très noir"]),
        (lambda c: T.ngrams(c, "uni"), "un chat très noir", ["chat", "très", "noir"]),
        (lambda c: T.ngrams(c, "unibi"), "chat", ["chat"]),
        (lambda c: T.ngrams(c, "bi"), "", []),
        (lambda c: T.representation(T.ngrams(c, "uni"), "presence"), "chat chat", ["chat"]),
    ],
)
def test_tokens(spark, f, text, out):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(f(F.col("text")).alias("t")).first().t == out


def test_label_names(spark):
    df = spark.createDataFrame([(4,), (2,), (0,), (7,), (None,)], "l int")
    assert [r.n for r in df.select(T.label_name(F.col("l")).alias("n")).collect()] == ["POSITIF", "NEUTRE", "NÉGATIF", "INCONNU", "INCONNU"]


def test_unknown_modes():
    with pytest.raises(ValueError):
        T.representation(None, "x")
