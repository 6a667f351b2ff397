from pathlib import Path

import pytest
from conftest import rows

from labelwright.operators import edits

SCHEMA = "row_id long, label int, text string"


def changes(spark, given):
    return spark.createDataFrame(given, edits.EDITS)


def test_last_edit_nulls_and_values_that_dont_fit(spark):
    df = spark.createDataFrame([(k, 2, f"t{k}") for k in range(6)] + [(None, 2, "x")], SCHEMA)
    given = [(1, 0, "label", "4"), (2, 0, "label", "0"), (3, 1, "label", "good"), (1, 1, "label", "4"), (4, 2, "label", None), (5, 2, "text", None), (6, 3, "text", "a"), (6, 3, "text", "b"), (7, 4, "rating", "1"), (8, 99, "label", "4"), (9, None, "label", "4")]
    got = rows(edits.apply_label_edits(df, changes(spark, given)))
    assert got == [(0, 0, "t0"), (1, 4, "t1"), (2, None, None), (3, 2, "b"), (4, 2, "t4"), (5, 2, "t5")]
    assert {r.edit_seq for r in edits.rejected_edits(df, changes(spark, given)).collect()} == {3, 7, 9}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    edits.write_editable(spark.createDataFrame([(k, 2, f"t{k}") for k in range(50)], SCHEMA), path, part_rows=10)
    files = lambda: {p.parent.name: p.name for p in Path(path, "rows").rglob("*.parquet")}
    before = files()
    given = changes(spark, [(1, 3, "label", "4"), (2, 3, "label", "0"), (3, 27, "text", "new"), (4, 777, "label", "4"), (5, 8, "label", "no number")])
    assert edits.applied_up_to(spark, path) is None
    assert edits.edit_stored(spark, path, given) == 2 and edits.applied_up_to(spark, path) == 5
    after = files()
    assert {k for k in before if before[k] != after[k]} == {"part=0", "part=2"} and set(before) == set(after)
    want = [(k, 0 if k == 3 else 2, "new" if k == 27 else f"t{k}") for k in range(50)]
    assert rows(edits.read_editable(spark, path)) == sorted(want, key=repr)
    assert edits.edit_stored(spark, path, given) == 0 and files() == after
    assert edits.edit_stored(spark, path, changes(spark, [(6, 3, "label", None), (2, 5, "label", "4")])) == 1  # the second came too late
    assert rows(edits.read_editable(spark, path).filter("row_id in (3, 5)")) == [(3, None, "t3"), (5, 2, "t5")]


def test_a_broken_run_is_run_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    edits.write_editable(spark.createDataFrame([(k, 2, f"t{k}") for k in range(20)], SCHEMA), path, part_rows=10)
    given = changes(spark, [(1, 3, "label", "4")])
    made = spark.createDataFrame
    with pytest.raises(RuntimeError), monkeypatch.context() as m:  # the rows are written, the mark isn't
        m.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError()))
        edits.edit_stored(spark, path, given)
    assert made and edits.applied_up_to(spark, path) is None
    assert edits.edit_stored(spark, path, given) == 1
    assert edits.read_editable(spark, path).filter("row_id = 3").first().label == 4


def test_no_edits_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    edits.write_editable(spark.createDataFrame([(1, 2, "a")], SCHEMA), path)
    assert edits.edit_stored(spark, path, changes(spark, [])) == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert edits.apply_label_edits(empty, changes(spark, [(1, 1, "label", "4")])).count() == 0
