import shutil
import subprocess
import sys
from pathlib import Path

from conftest import rows

from labelwright.plans import jobs
from labelwright.plans.chains import label_by_seed
from labelwright.sources.files import read_labelled
from labelwright.streaming.messages import clean_stream, label_stream
from labelwright.tables import shared_dir

ROOT = Path(__file__).resolve().parents[1]


def test_clean_then_label(spark, tmp_path):
    lines = ["rating,message"] + [f'{(0, 2, 4)[i % 3]},"message number {i} {("awful", "plain", "lovely")[i % 3]} day, @user!"' for i in range(12)] + ['4,"RT gone"']
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    jobs.run_clean(spark, str(tmp_path / "raw.csv"), str(tmp_path / "clean"))
    got = read_labelled(spark, str(tmp_path / "clean"))
    assert sorted((r.label, r.text) for r in got.collect()) == sorted(((0, 2, 4)[i % 3], f"message number {i} {('awful', 'plain', 'lovely')[i % 3]} day") for i in range(12))
    for method in ("bayes", "knn"):
        jobs.run_label(spark, method, str(tmp_path / "clean"), str(tmp_path / "clean"), str(tmp_path / method))
        labels = read_labelled(spark, str(tmp_path / method))
        assert labels.count() == 12 and all((r.label, n) in ((0, "awful"), (2, "plain"), (4, "lovely")) for r in labels.collect() for n in r.text.split() if n in ("awful", "plain", "lovely"))


def test_chain_and_report(spark, tmp_path):
    """Messages with listed words label those without; a cleaning job tells what it did, and leaves no tables behind."""
    lines = ["rating,message"] + [f'2,"{"lovely" if i % 2 else "awful"} {"sunny" if i % 2 else "rainy"} {"today " + str(i) if i < 8 else ""}!"' for i in range(10)] + ['2,"sunny later"', '2,"rainy later"', '2,"RT gone"']
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "pos").write_text("lovely\n")
    (tmp_path / "neg").write_text("awful\n")
    shared = Path(shared_dir(spark))
    before = set(shared.iterdir()) if shared.exists() else set()
    jobs.main(["clean", str(tmp_path / "raw.csv"), str(tmp_path / "clean"), "--report", str(tmp_path / "report")])
    assert dict(rows(spark.read.parquet(str(tmp_path / "report" / "counts"))))["retweet deletion"] == 1
    assert spark.read.parquet(str(tmp_path / "report" / "audit")).filter("action = 'delete'").count() == 1
    for method in ("knn", "bayes", "cluster"):
        jobs.main(["chain", method, str(tmp_path / "clean"), str(tmp_path / method), "--words", str(tmp_path / "pos"), str(tmp_path / "neg")])
        got = {r.text.strip(): r.label for r in read_labelled(spark, str(tmp_path / method), escaped=True).collect()}
        assert len(got) == 12 and (method == "cluster" or got["sunny later"] == 4 and got["rainy later"] == 0)
    assert {p.name.partition("-")[0] for p in set(shared.iterdir()) - before} <= {"ranges"}  # this test's own reading
    none = spark.createDataFrame([("nothing", "pos")], "word string, polarity string")
    assert label_by_seed(spark.createDataFrame([(1, "a")], "row_id long, text string"), none).first().estimated is None


def test_cells_are_decoded(spark, tmp_path):
    """Each cell by itself: UTF-8, windows-1252 and ISO-8859-1 in one file."""
    cells = ["été".encode(), "“été” €".encode("cp1252"), "été fini".encode("latin-1")]
    (tmp_path / "raw.csv").write_bytes(b"rating,message\n" + b"".join(b"4," + c + b"\n" for c in cells))
    jobs.run_clean(spark, str(tmp_path / "raw.csv"), str(tmp_path / "clean"))
    assert sorted(r.text for r in read_labelled(spark, str(tmp_path / "clean")).collect()) == sorted(["été", "“été” €", "été fini"])


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "good @you day"), (2, "bad!"), (3, "RT x")], "row_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, text string").parquet(str(tmp_path / "in"))
    words = spark.createDataFrame([("goodday", "pos"), ("bad", "neg")], "word string, polarity string")
    query = label_stream(clean_stream(stream), words, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("row_id", "estimated")) == [(1, 4), (2, 0)]


def test_entry_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "labelwright", tmp_path / "labelwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'evaluate_bayes' in q and set(s) <= set(q) and not any(x.startswith('op1') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": ""})


def test_entry_without_tokenizer_files():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'evaluate_bayes' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
