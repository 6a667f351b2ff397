import itertools
import random
import struct

import public_tokenizers
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_llm import SCHEMA, TONGUES, groups_by_hand, speech

import corpus_pipeline as P
from labelwright.llm import mixing, tokenize
from labelwright.llm.common import cut

SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    out = [(i, speech(rng, t, rng.randrange(40, 120)), t, f"s{i % 4}", 0) for i, t in enumerate(list(TONGUES) * 40)]
    shared = speech(rng, "xx", 40)
    for i in range(0, 60, 9):
        out[i] = (i, out[i][1] + " " + shared, *out[i][2:])
    out += [(200 + i, out[i][1], *out[i][2:]) for i in range(10)] + [(300, None, "xx", "s1", 0), (301, "1 2 3", "xx", "s1", 0), (302, "", None, None, 0)]
    return spark.createDataFrame([(a, b, c, d, len(b or "")) for a, b, c, d, _ in out], SCHEMA).cache()


def test_stages(spark, docs):
    start = {r.doc_id: r.text for r in docs.collect()}
    known = P.language(spark, docs, "")
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} == set(start) - {300, 301, 302}
    single = P.near_duplicates(spark, known, "")
    ids = sorted(r.doc_id for r in known.collect())
    assert {r.doc_id for r in single.collect()} == {i for i, _, _, k in groups_by_hand(ids, [start[i] for i in ids], 80) if k}
    clean = P.repeated_passages(spark, single, "")
    texts = {r.doc_id: r for r in clean.collect()}
    windows = lambda t: {tuple(w[i : i + 35]) for w in [t.split()] for i in range(len(w) - 34)}
    assert clean.columns == docs.columns and all(r.n_chars == len(r.text) for r in texts.values())
    assert not any(windows(a.text) & windows(b.text) for a, b in itertools.combinations(texts.values(), 2))
    changed = {i for i in texts if texts[i].text != start[i]}
    assert changed == {i for i in range(0, 60, 9)}
    mixed = P.mixture(spark, clean, "")
    plan = {r.doc_id: r.copies for r in mixing.mixing_plan(clean).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(plan.values())
    coder = tokenize.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    total = sum((len(coder.encode(r.text, add_special_tokens=False).ids) + 1) * plan[r.doc_id] for r in texts.values())
    packed = P.packed(spark, mixed, "").collect()
    assert sum(r.length for r in packed) == total and all(len(struct.unpack(f"<{r.length}I", r.ids)) == r.length for r in packed)


def test_one_row_of_each_group(spark):
    rng = random.Random(8)
    long, unnamed, unique, short = (speech(rng, "xx", n) for n in (60, 50, 45, 12))
    data = [(4, long), (4, long), (None, long), (None, unnamed), (None, unnamed), (2, short), (7, short), (7, unique), (5, None), (None, ""), (None, "")]
    df = spark.createDataFrame([(a, b, "xx", "s", len(b or "")) for a, b in data], SCHEMA)
    for own in (df, cut(df.repartition(3), "documents")):
        assert rows(P.near_duplicates(spark, own, "").select("doc_id", "text")) == sorted([(4, long), (None, unnamed), (2, short), (7, unique), (5, None), (None, ""), (None, "")], key=repr)
    assert P._named(cut(df.repartition(3))).select("_row").distinct().count() == len(data)
    single = P.near_duplicates(spark, df, "")
    assert single.columns == df.columns
    want = [(4, long), (None, unnamed), (2, short), (7, unique), (5, None), (None, ""), (None, "")]
    assert rows(single.select("doc_id", "text")) == sorted(want, key=repr)
    assert rows(P.repeated_passages(spark, single, "").select("doc_id", "text")) == sorted(want, key=repr)


def test_columns_of_any_names(spark):
    """A document's own columns that are named as the stages' own, or with a dot, come through every stage as they were."""
    rng = random.Random(10)
    extra = {"_language": "clash", "_row": "r", "_doc": "d", "row": "w", "kept": "k", "component_id": "c", "a.b": "dot", "_size": "s", "n_removed": "n"}
    data = [(i, speech(rng, t, 40), t, "s", 0) for i, t in enumerate(list(TONGUES) * 30)] + [(None, speech(rng, "xx", 40), "xx", "s", 0), (3, speech(rng, "yy", 40), None, None, None)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({k: F.lit(v) for k, v in extra.items() if "." not in k}).withColumn("a.b", F.lit("dot"))
    for name, stage in P.STAGES[:-1]:
        df = cut(stage(spark, df, ""), name)
        assert df.columns == [*SCHEMA_NAMES, *extra][: len(df.columns)] or set(df.columns) == {*SCHEMA_NAMES, *extra}, name
        assert all(tuple(r[k] for k in extra) == tuple(extra.values()) for r in df.collect()), name
        assert df.count() >= 90, name
    assert P.packed(spark, df, "").count() > 90


def test_run_and_empty(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert rows(P.run(spark, str(tmp_path / "none"))) == []
