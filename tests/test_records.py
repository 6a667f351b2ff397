import csv
import io
import random

import numpy as np
import pytest

from conftest import rows
from labelwright.sources import files, ranges, records


def some_csv(rng, n):
    """A file and its records, by the writer of the standard library: cells with quotes, separators and line feeds."""
    made = [["id", "text", "end"]] + [[str(k), "".join(rng.choice('ab ,"\n\n,"é') for _ in range(rng.randint(0, 30))), rng.choice(["", "x", 'q"', "\n"])] for k in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows(made)
    return out.getvalue(), made


@pytest.fixture
def small_ranges(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "64"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_cells():
    assert records.cells("a,b,") == ["a", "b", ""]
    assert records.cells('"a ""b"", c"d,e"f') == ['a "b", cd', 'e"f']
    assert records.cells('x,"never closed, so on') == ["x", "never closed, so on"]
    rng = random.Random(1)
    for _ in range(300):
        text, made = some_csv(rng, 3)
        assert [records.cells(x) for x in ["id,text,end"]] == [made[0]]
        for row in made[1:]:
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(row)
            assert records.cells(out.getvalue()) == row


def test_states_are_those_of_a_walk():
    rng = np.random.default_rng(1)
    for _ in range(200):
        zero, one = rng.random(20) < 0.5, rng.random(20) < 0.5
        for first in (0, 1):
            want = [first]
            for z, o in zip(zero, one, strict=True):
                want.append(int(not (o if want[-1] else z)))
            assert records._states(zero, one, first).tolist() == want


def test_one_file_in_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    for k in range(3):
        text, made = some_csv(rng, 60)
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8", newline="")
        path = str(tmp_path / f"{k}.csv")
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = files.read_raw_csv(spark, path)
        assert rows(got) == sorted(((i, *r) for i, r in enumerate(made[1:])), key=repr)
    whole = files._whole_csv(spark, path, True, ",", "UTF-8").na.fill("")
    assert rows(whole) == rows(got.drop("row_id"))


def test_numbers_dont_depend_on_the_split(spark, tmp_path):
    rng = random.Random(9)
    want = []
    for k in range(4):
        text, made = some_csv(rng, 25)
        (tmp_path / f"part-{k}.csv").write_text(text, encoding="utf-8", newline="")
        want += made[1:]
    want = sorted(((i, *r) for i, r in enumerate(want)), key=repr)
    for size in ("100", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert rows(files.read_raw_csv(spark, str(tmp_path))) == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_more_ranges_than_are_broadcast(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(ranges, "BROADCAST_RANGES", 0)
    text, made = some_csv(random.Random(3), 60)
    (tmp_path / "x.csv").write_text(text, encoding="utf-8", newline="")
    assert rows(files.read_raw_csv(spark, str(tmp_path / "x.csv"))) == sorted(((i, *r) for i, r in enumerate(made[1:])), key=repr)


def test_odd_files(spark, tmp_path):
    def read(data, **more):
        (tmp_path / "y.csv").write_bytes(data)
        return [tuple(r) for r in files.read_raw_csv(spark, str(tmp_path / "y.csv"), **more).orderBy("row_id").collect()]

    assert read(b'a,b\n\n1,5" pipe\n\r\n2,"x') == [(0, "1", '5" pipe'), (1, "2", "x")]
    assert read(b"1;caf\xe9\n2;b", header=False, sep=";", encoding="ISO-8859-1") == [(0, "1", "café"), (1, "2", "b")]
    assert read(b"a,b\n") == []
    with pytest.raises(Exception, match="cells"):
        read(b"a,b\n1,2\n3,4,5\n")


def test_labelled_lines_are_numbered(spark, tmp_path, small_ranges):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("label,text\n" + "".join(f'{i % 3},"row {k} {i} ""q"""\r\n' + ("no label\n" if i % 4 == 0 else "") for i in range(30)))
    got = rows(files.read_labelled(spark, str(tmp_path)))
    assert got == sorted(((30 * k + i, i % 3, f'row {k} {i} ""q') for k in range(3) for i in range(30)), key=repr)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert rows(files.read_labelled(spark, str(tmp_path))) == got


def test_changed_ranges_fail(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\ntwo\n")
    lines = ranges.read_lines(spark, str(tmp_path))
    other = spark.createDataFrame([("elsewhere", 0, 1)], "_file string, _start long, _range long")
    with pytest.raises(Exception, match="split otherwise"):
        ranges.told(lines, other).collect()
