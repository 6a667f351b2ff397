from conftest import rows
from pyspark.sql import functions as F

from labelwright.operators import profile
from labelwright.operators.edits import apply_label_edits
from labelwright.sources import files


def test_read_labelled(spark, tmp_path):
    (tmp_path / "x.csv").write_text('rating,message\n4,"hello, ""you"""\n"2",quoted rating\n 0,space\n-1,minus\nnone\n0,\n2,a,b\n', encoding="utf-8")
    got = [(r.label, r.text) for r in files.read_labelled(spark, str(tmp_path / "x.csv")).orderBy("row_id").collect()]
    assert got == [(4, 'hello, ""you'), (-1, "minus"), (0, ""), (2, "a,b")]


def test_raw_csv_and_decoding(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('a,b\n"one\ntwo",x\n,"é ""q"""\n'.encode())
    got = files.read_raw_csv(spark, str(tmp_path / "x.csv")).drop("row_id")
    assert rows(got) == [("", 'é "q"'), ("one\ntwo", "x")]
    df = spark.createDataFrame([("é".encode().decode("latin-1"),), ("é",), ("a",)], "t string")
    assert [tuple(r.d) for r in df.select(files.decode_text(F.col("t")).alias("d")).collect()] == [("é", "UTF-8"), ("é", "ISO-8859-1"), ("a", "UTF-8")]
    every = "".join(chr(b) for b in range(0x80, 0x100))
    got = spark.createDataFrame([(every,)], "t string").select(files.decode_text(F.col("t")).alias("d")).first().d
    assert got.encoding == "windows-1252" and [x for x in got.text if x > "\xff"] == [x for b in range(0x80, 0xA0) for x in bytes([b]).decode("cp1252", "ignore")] and got.text[0x20:] == every[0x20:]


def test_words(spark, tmp_path):
    (tmp_path / "w").write_text(" Good\ngood\n\nFine \n")
    (tmp_path / "c").write_text("aaa, aaa\nB c,")
    assert rows(files.read_words(spark, str(tmp_path / "w"), "pos")) == [("fine", "pos"), ("good", "pos")]
    assert [r.word for r in files.read_words_csv(spark, str(tmp_path / "c"), "neg").collect()] == ["aaa", "aaa", "B c"]


def test_written_rows_come_back(spark, tmp_path):
    given = [(4, "a, b"), (0, "plain"), (2, 'say "hi", "you"'), (2, '"quoted"'), (0, '"'), (0, "")]
    files.write_labelled(spark.createDataFrame(given, "rating int, message string"), str(tmp_path / "out"))
    back = files.read_labelled(spark, str(tmp_path / "out"), escaped=True)
    assert sorted((r.label, r.text) for r in back.collect()) == sorted(given)


def test_line_ends_of_both_kinds(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'rating,message\r\n4,"bonjour"\r\n0,tant pis\n2,a\rb\r\n')
    got = [(r.row_id, r.label, r.text) for r in files.read_labelled(spark, str(tmp_path / "x.csv")).orderBy("row_id").collect()]
    assert got == [(0, 4, "bonjour"), (1, 0, "tant pis"), (2, 2, "a\rb")]


def test_edits(spark):
    df = spark.createDataFrame([(1, 2, "a"), (2, 2, "b"), (None, 2, "c")], "row_id long, label int, text string")
    edits = spark.createDataFrame([(1, 1, "label", "4"), (2, 1, "label", "0"), (3, 2, "text", "new"), (4, 9, "label", "4")], "edit_seq long, row_id long, column string, value string")
    assert rows(apply_label_edits(df, edits)) == [(1, 0, "a"), (2, 2, "new")]


def test_sniffing(spark):
    df = spark.createDataFrame([("1", "4", "short", "a rather longer message"), ("2", '"0"', "x", "and another one")], ["id", "p", "q", "r"])
    assert tuple(profile.sniff_columns(df).first()) == (3, 1)
    assert profile.match_headers(["Rating", "x", "TWEET", "data"]) == (3, 0)
    long = spark.createDataFrame([("x" * 300, "y" * 400)], ["a", "b"])
    assert tuple(profile.sniff_columns(long).first()) == (1, None)
    assert tuple(profile.sniff_columns(df.select(F.col("r").alias("message"), F.col("p").alias("rating"))).first()) == (0, 1)
