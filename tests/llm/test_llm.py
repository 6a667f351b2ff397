import hashlib
import itertools
import math
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelwright.llm import components, fitting, langid, media, minhash, mixing, packing, quotes, substring, tokencodes, tokenize, topk, toxicity
from labelwright.llm.common import cut

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", "   \n", "a", "A b\tc", "É é 日本語 <|endoftext|> it's", "x " * 3000]


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def corpus(n=120, seed=3):
    """Texts with copies, near copies, shared passages and every edge case."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 90))) for _ in range(n)]
    passage = " ".join(word() for _ in range(45))
    for i in range(0, n, 6):
        texts[i] += " " + passage
    for i in range(1, n, 5):
        own = texts[i - 1].split()
        for _ in range(rng.randrange(0, 4)):
            if own:
                own[rng.randrange(len(own))] = word()
        texts[i] = " ".join(own).upper() if i % 2 else " ".join(own)
    return texts + EDGE + [texts[0], texts[0]]


# --- 1 -----------------------------------------------------------------------------------------------------------------------


def shingle_sets(texts):
    split = [t.encode().lower().split() if t else [] for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in split]


def groups_by_hand(ids, texts, percent):
    sets, top = shingle_sets(texts), {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, a), (j, b) in itertools.combinations(list(zip(ids, sets, strict=True)), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            p, q = sorted((find(i), find(j)))
            top[q] = p
    return [(i, len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    texts = corpus()
    got = rows(minhash.near_duplicates(docs_of(spark, texts).withColumn("sketch", F.lit(1)), percent))
    assert got == sorted(groups_by_hand(range(len(texts)), texts, percent), key=repr)


def test_near_duplicates_in_tiles(spark, monkeypatch):
    """A large group of near copies of which most aren't alike, in one tile and in many."""
    rng = random.Random(1)
    start = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(90):
        own = list(start)
        for at in rng.sample(range(100), rng.randrange(0, 6)):
            own[at] = f"v{rng.randrange(40)}"
        texts.append(" ".join(own))
    want = sorted(groups_by_hand(range(90), texts, 85), key=repr)
    assert 1 < len({c for _, _, c, _ in want}) < 80
    for tile in (50, 1000, 1 << 18):
        monkeypatch.setattr(minhash, "TILE_LEAST", min(tile, 8192))
        monkeypatch.setattr(minhash, "TILE_MOST", tile)
        assert rows(minhash.near_duplicates(docs_of(spark, texts), 85)) == want


@pytest.mark.parametrize(("counted", "at_once"), [(1 << 15, 256), (7, 3), (40, 1)])
def test_common_shingles(monkeypatch, counted, at_once):
    """Counts of common elements don't depend on how much is counted at once."""
    monkeypatch.setattr(minhash, "COUNTED", counted)
    monkeypatch.setattr(minhash, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    groups = [[np.sort(rng.choice(60, rng.integers(1, 25), replace=False)) for _ in range(n)] for n in (17, 11)]
    got = minhash._common(*((np.array([len(x) for x in g]), np.concatenate(g).astype(np.int64)) for g in groups))
    assert got.tolist() == [[len(set(a) & set(b)) for b in groups[1]] for a in groups[0]]


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_of(spark, []), 85).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    got = rows(minhash.near_duplicates(df, 85))
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (2, 0, 2, True), (None, 0, None, False)], key=repr)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(99, 98), (98, 99), (7, 7)], "a long, b long")
    assert dict(rows(components.components(chain))) == dict.fromkeys(range(41), 0) | {98: 98, 99: 98}


# --- 2, 3 --------------------------------------------------------------------------------------------------------------------

TONGUES = {"xx": ["ka", "ko", "ki", "kum"], "yy": ["ze", "zi", "zor", "zul"], "qq": ["mba", "mbe", "mbo", "mbu"]}


def speech(rng, tongue, n):
    return " ".join("".join(rng.choice(TONGUES[tongue]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_of_switched_text():
    rng = random.Random(2)
    model = langid.fit([(speech(rng, t, 40), t) for t in TONGUES for _ in range(20)])
    texts = [speech(rng, "xx", 30) + " " + speech(rng, "yy", 12), speech(rng, "qq", 900), "123 ...", None, ""]
    names, scores = model.label(texts)
    assert names == ["xx", "qq", "und", "und", "und"] and all(0 <= s <= 1 for s in scores) and 0.5 < scores[0] < 0.95 < scores[1]
    assert all(model.moves[i, i] > model.moves[i, j] for i in range(3) for j in range(3) if i != j)


def test_forward_backward_by_hand():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3))
    want, total, pairs = np.zeros((5, 3)), 0.0, np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=5):
        weight = math.exp(sum(float(scores[t, s]) for t, s in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += weight
        for t, s in enumerate(path):
            want[t, s] += weight
        for a, b in itertools.pairwise(path):
            pairs[a, b] += weight
    twice = np.concatenate([scores, scores[:2], scores])
    got, counts = langid.forward_backward(twice, np.array([5, 2, 0, 5]), moves, pairs=True)
    assert np.allclose(got[:5], want / total, atol=1e-5) and np.allclose(got[7:], want / total, atol=1e-5)
    assert np.allclose(langid.forward_backward(scores, np.array([5]), moves, pairs=True)[1], pairs / total, atol=1e-5)
    assert counts.sum() == pytest.approx(4 + 1 + 4)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 40])
def test_long_sequences_are_whole(block):
    """Blocks of any size give the probabilities of one pass over whole sequences, sharp moves and scores included."""
    rng = np.random.default_rng(block)
    sizes = np.array([37, 1, 0, 5, 80, 3, 14])
    for sharp in (1, 30):
        scores, moves = (sharp * rng.normal(size=(sizes.sum(), 3))).astype(np.float32), sharp * rng.normal(size=(3, 3))
        want, _ = langid.forward_backward(scores, sizes, moves, block=10_000)
        got, _ = langid.forward_backward(scores, sizes, moves, block=block)
        assert np.allclose(got, want, atol=1e-5)


def test_features_in_chunks(monkeypatch):
    """Words featured a few at a time, and a cache that overflows, change no score."""
    rng = random.Random(9)
    model = langid.fit([(speech(rng, t, 40), t) for t in TONGUES for _ in range(20)])
    assert model.lexicon and 1 < len(set(model.lexicon.values())) <= 7
    texts = [speech(rng, t, 50) for t in TONGUES for _ in range(8)] + ["z" * 3000 + " ka"]
    want = model.label(texts)
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    for cache in (1, 40, 1000):
        monkeypatch.setattr(langid, "CACHE", cache)
        for at in range(0, len(texts), 5):
            names, scores = model.label(texts[at : at + 5])
            assert names == want[0][at : at + 5] and np.allclose(scores, want[1][at : at + 5], atol=1e-5)


def test_every_language_has_a_lexicon():
    rng = random.Random(11)
    own = {f"l{i:02}": [f"{''.join(rng.choice('abcdefghij') for _ in range(5))}" for _ in range(12)] for i in range(70)}
    model = langid.fit([(" ".join(rng.choices(words, k=30)), name) for name, words in own.items() for _ in range(8)], epochs=2)
    assert all(any(w in model.lexicon for w in words) for words in own.values()) and len(set(model.lexicon.values())) >= 70


def test_long_texts_give_a_stretch(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a" * 50), (2, "bc" * 500), (2, None)], "doc_id long, text string")
    got = dict((y, t) for t, y in fitting.texts_of(df, [(1, "x"), (2, "y")], "lang", "string", longest=100))
    assert got["x"] == "a" * 50 and len(got["y"]) == 100 and got["y"] in "bc" * 500
    monkeypatch.setattr(fitting, "WHOLE", 60)
    assert all(len(t) <= 30 for t, _ in fitting.texts_of(df, [(1, "x"), (2, "y")], "lang", "string"))


def test_commonest_labels_are_sampled(spark):
    rows_ = spark.createDataFrame([(i, f"l{i % 5 if i < 500 else i}") for i in range(520)], "doc_id long, lang string")
    got = fitting.sample(rows_, "lang", 10, 4)
    assert len({y for _, y in got}) == 4 and len(got) <= 80 and sorted(got) == sorted(fitting.sample(rows_.repartition(3), "lang", 10, 4))


def test_identify(spark):
    rng = random.Random(4)
    texts = [(i, speech(rng, t, 30), t if i % 7 else None) for i, t in enumerate(list(TONGUES) * 40)] + [(900, None, "xx"), (901, "", None), (None, speech(rng, "yy", 9), "xx")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.language for r in langid.identify(df, langid.train(df, 25)).collect()}
    assert all(got[i].lang_pred == list(TONGUES)[i % 3] for i in range(120)) and got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "yy"
    nothing = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.language.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), nothing).count() == 0


def insults(rng, n, bad):
    words = [rng.choice(["and", "tree", "house", "green", "walks", "slow"]) for _ in range(n)]
    if bad:
        words[rng.randrange(n)] = rng.choice(["dolt", "grubling", "grubface"])
    return " ".join(words) + "."


def test_toxicity(spark):
    rng = random.Random(5)
    data = [(i, insults(rng, 20, i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1000, None), (1001, ""), (None, "dolt")], "doc_id long, text string").withColumn("toxicity_", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, 150)
    assert any(s.startswith("grub") for s in model.stems) and "dolt$" in model.stems
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in data) and got[1000] == got[1001] < 0.5 <= got[None]


def kinds(g, text):
    return [g._kind(w) for w in toxicity._WORD.findall(text)]


def test_grammar_labels():
    g = toxicity.Grammar({"dolt$": 5.0, "grub": 4.0}, np.zeros(7))
    p, t, d, s, m = range(5)
    more, less, aim = toxicity.TARGET_WEIGHT, toxicity.LESS, toxicity.THREAT_WEIGHT
    for text, at, weight in (
        ("a dolt", p, 5), ("you are a dolt", t, 5 + more), ("a dolt are you", t, 5 + more), ("he is not a dolt", d, 5 + more + less), ("she said he was a dolt", s, 5 + more + less),
        ('a "dolt" again', s, 5 + less), ("i will kill you", m, aim), ("you i will not kill", d, aim + less), ("grublike thing", p, 4), ("a dolt and grublike", p, 5), ("no no no no no one calls a dolt", s, 5 + 2 * less),
    ):
        out = g.clause(kinds(g, text))
        assert out[at] == pytest.approx(weight), text
    assert g.clause(kinds(g, "a dolt not far from you"))[p] == 0.0  # a target in the clause, so it isn't plain
    assert g.clause(kinds(g, "dolts kill time")) == [0.0] * 5
    assert g.matches("A dolt. You dolt! nothing, kill me not") == [5.0, 5.0 + more, 0.0, 0.0, 0.0]
    assert g.matches("undolt doltish") == g.matches(None) == [0.0] * 5
    assert g.matches("she said, clearly: a dolt. a dolt") == [5.0, 0.0, 0.0, 5.0 + less, 0.0]


def rewritten(machine, start, symbols):
    """Every path of one machine over weighted symbols: (what it writes, weight)."""
    paths = [(start, (), 0.0)]
    for x, own in symbols:
        paths = [(arc.to, (*wrote, (arc.out, 0.0 if arc.takes else own)), w + arc.weight + (own if arc.takes else 0.0)) for q, wrote, w in paths for arc in machine.arcs.get((q, x), ())]
    return [(wrote, w) for q, wrote, w in paths if q in machine.finals]


def test_grammar_against_all_paths():
    """The composed machine's best paths against all paths of the five machines, one behind the other."""
    rng = random.Random(12)
    g = toxicity.Grammar({}, np.zeros(7))
    for _ in range(300):
        start = rng.randrange(4)
        words = [(rng.choice(range(7)), rng.choice([1.0, 2.5, 4.0])) for _ in range(rng.randrange(1, 7))]
        words = [(k, w if k == toxicity.INSULT else 0.0) for k, w in words]
        ways = [(tuple(words), 0.0)]
        for machine, at in ((toxicity.insult(), 0), (toxicity.threat(), 0), (toxicity.target(), 0), (toxicity.negation(), 0), (toxicity.report(), start)):
            ways = [(wrote, w + more) for symbols, w in ways for wrote, more in rewritten(machine, at, symbols)]
        want = [0.0] * 5
        for wrote, w in ways:
            for x, _ in wrote:
                if x in toxicity.LABELS:
                    want[x - toxicity.PLAIN] = max(want[x - toxicity.PLAIN], w)
        assert g.clause(words, start) == pytest.approx(want), words


def test_long_texts_take_linear_time():
    g = toxicity.Grammar({"dolt$": 5.0}, np.zeros(7))
    spent = []
    for n in (20_000, 160_000):
        text = "you are a dolt, they say; " * n
        began = time.process_time()
        g.matches(text)
        spent.append(time.process_time() - began)
    assert spent[1] < 24 * max(spent[0], 0.05)
    assert g.matches("dolt " * 1000)[0] == 5.0


def test_toxicity_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(empty, labels)
    assert toxicity.score(empty, model).count() == 0
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "doc_id long, text string").withColumn("toxicity", F.lit("clash")).withColumn("stems", F.lit(1))
    got = toxicity.score(df, model)
    assert got.columns == df.columns and {r.toxicity for r in got.collect()} == {0.5}


# --- 4 -----------------------------------------------------------------------------------------------------------------------


def kept_by_hand(texts, window):
    split = [t.encode().split() if t else [] for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "m", "hot", "broadcast"), [(35, 4, 5000, 500_000), (5, 2, 5000, 500_000), (5, 2, 1, 500_000), (4, 4, 3, 500_000), (5, 2, 1, 0)])
def test_repeats(spark, monkeypatch, window, m, hot, broadcast):
    """No hot minimiser, most of them hot, and hot ones too many to broadcast: the same result."""
    monkeypatch.setattr(substring, "BROADCAST", broadcast)
    monkeypatch.setattr(substring, "SALTS", 3)
    texts = corpus()
    df = docs_of(spark, texts).withColumns({"k1": F.lit("x"), "row": F.lit(2)})
    got = sorted(map(tuple, substring.digest(substring.remove_repeats(df, window, m, hot)).collect()))
    assert [g[1:] for g in got] == kept_by_hand(texts, window)


def test_repeats_where_hashes_collide(monkeypatch):
    """With one hash for every window the words themselves must decide."""
    monkeypatch.setattr(substring, "powers", lambda n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64)))
    strings = [b"a b c d e", b"b c d x", b"q r s", b"q r s t"]
    got = substring.repeated(strings, np.array([1, 1, 1, 1], np.uint32), 3)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0)]


def test_repeats_edges(spark):
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "x y z w"), (2, "p\n q")], "doc_id long, text string")
    got = {(r.row.doc_id, r.n_removed, r.kept) for r in substring.remove_repeats(df, 3, 2, spacing=True).collect()}
    assert got == {(1, 4, ""), (None, 0, "x y z w"), (2, 0, "p\n q")}


def test_places_of_a_hot_window_stay(spark, monkeypatch):
    """The windows of a passage that all texts have reach no bucket and no shuffle of places, and the result is the same."""
    passage = "a b c d e f g h"
    texts = [f"{i} {passage} {i * 7 + 1000}" for i in range(40)] + ["q r s t u v", "q r s t u w", "x y z"]
    df = docs_of(spark, texts).select(F.lit(1).cast("long").alias("k1"), F.monotonically_increasing_id().alias("k2"), "text").coalesce(1)
    found, strings = substring._hot(df, 5, 2, 10)
    assert strings > 40 and found.count() >= 1
    routes = substring._Routes(spark.sparkContext.broadcast(np.array([r[0] for r in found.collect()], np.int64)))
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()])
    packed = pa.Table.from_batches(substring._travel(5, 2, 8, routes)(iter([batch])))
    assert max(int(n) for x in packed["packed"].to_pylist() for n in substring._unpack(x)[1]) == 1
    singles = spark.createDataFrame(pa.Table.from_batches(substring._singles(5, 2, routes)(iter([batch]))).to_pandas())
    marked = substring._marked(singles, 5, 10)
    assert {(r.begin, r.end) for r in marked.collect()} == {(i, i + 5) for i in range(1, 5)} and marked.count() == 160
    got = sorted(map(tuple, substring.digest(substring.remove_repeats(docs_of(spark, texts), 5, 2, 10)).collect()))
    assert [g[1:] for g in got] == kept_by_hand(texts, 5)


# --- 5, 7 --------------------------------------------------------------------------------------------------------------------


PLAIN = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


def ids_by_library(path, text):
    """What the untouched file gives for a whole text."""
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab É.,;!\n\t <|>'1", max_size=60), min_size=1, max_size=6))
def test_cached_encoding_is_exact(texts):
    for path in (BYTE, WORD):
        assert [ids.tolist() for ids in tokenize.encoder(path).encode(texts)] == [ids_by_library(path, t) for t in texts]


@pytest.mark.parametrize("cache", [5, 1_000_000])
def test_cached_encoding_of_odd_spaces(monkeypatch, cache):
    monkeypatch.setattr(tokenize.PieceEncoder, "kept", cache)
    texts = [f"a{x} b{x}{y}c  d{y}{x}" for x in "\x1c\x85\xa0 \n\t\r .,'" for y in "\x1f　 \n!s"] + [t for t in EDGE if t]
    texts += [f"word{m} É{m}{n}x Été{n}\nWord{m}\n\nword\t{m}" for m in ".,;:!?|" for n in ".|-)é1"] + ["y" * 5000 + ", " + "y" * 5000]
    for path in (BYTE, WORD):
        coder = tokenize.PieceEncoder(path)
        for own in (texts, texts[::-1], texts[::3]):
            assert [i.tolist() for i in coder.encode(own)] == [ids_by_library(path, t) for t in own]


def test_added_tokens_keep_their_ids():
    """A file's added tokens count wherever they stand, as in the library; parts of them do not."""
    for path in (BYTE, WORD):
        names = [t.content for t in PLAIN[path].get_added_tokens_decoder().values()]
        texts = [x for n in names for x in (n, f"hello {n} world", f"{n}start", f"end{n}", f"glued{n}letters", f" {n} {n}{n}\n{n}.", f"É{n}é", f"{n[:-1]} {n[1:]}", n.upper(), f"a {n[:-2]}\n{n[-2:]}")]
        assert [i.tolist() for i in tokenize.PieceEncoder(path).encode(texts)] == [ids_by_library(path, t) for t in texts]
        assert all(PLAIN[path].token_to_id(n) in ids_by_library(path, f"a{n}b") for n in names)


def test_packing(spark):
    texts = corpus(20) + ["one <|endoftext|> two<|endoftext|>"]
    got = packing.pack(docs_of(spark, texts).withColumn("bucket", F.lit(1)), BYTE, longest=64).collect()
    per = defaultdict(list)
    for r in got:
        per[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and r.bucket == r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
    for i, t in enumerate(texts):
        ids = ids_by_library(BYTE, t) + [0]
        own = sorted(per[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == struct.pack(f"<{len(ids)}I", *ids) and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == list(itertools.accumulate((r.length for r in own), initial=0))[:-1]
    assert len({r.sequence_id for r in got}) == len(got)
    assert packing.pack(docs_of(spark, []), BYTE).count() == 0
    assert packing.cuts(1023, 1024) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1] and packing.cuts(2050, 1024) == [1024, 1024, 2]


def test_buckets_are_folders(spark, tmp_path):
    packing.write_buckets(packing.pack(docs_of(spark, ["a b c"]), BYTE), str(tmp_path / "p"))
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"bucket=4"}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes(values):
    data = b"head" + tokencodes.encode_ids(np.array(values, np.uint32))
    codes = tokencodes.Codes(data, 4)
    assert codes.all().tolist() == values and codes.end == len(data) and len(codes) == len(values)
    places = np.arange(len(values))[::-3].copy()
    assert codes.get(places).tolist() == [values[i] for i in places]
    with pytest.raises(IndexError):
        codes.get(np.array([len(values)]))


def test_token_files(spark):
    texts = corpus(30) + ["one <|endoftext|> two<|startoftext|>"]
    shards = tokencodes.write_shards(docs_of(spark, texts).repartition(5), WORD, 2, shard_ids=300)
    got = rows(tokencodes.read_documents(shards))
    start = 0
    for (doc_id, at, n, crc, middle), (i, t) in zip(sorted(got), enumerate(texts), strict=True):
        ids = ids_by_library(WORD, t) + [2]
        assert (doc_id, at, n, crc, middle) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids[len(ids) // 2])
        start += n
    odd = spark.createDataFrame([(5, "b"), (None, "a"), (5, "b"), (-1, None)], "doc_id long, text string")
    assert [r[:3] for r in sorted(rows(tokencodes.read_documents(tokencodes.write_shards(odd, WORD, 2))), key=lambda r: r[1])] == [(None, 0, 2), (-1, 2, 1), (5, 3, 2), (5, 5, 2)]
    assert tokencodes.read_documents(tokencodes.write_shards(docs_of(spark, []), WORD, 2)).count() == 0


def test_single_tokens(spark, monkeypatch):
    """Any token by (document, position), from the stored shards."""
    texts = corpus(20)
    shards = tokencodes.write_shards(docs_of(spark, texts).repartition(3), WORD, 2, shard_ids=200)
    want = {(i, at): x for i, t in enumerate(texts) for at, x in enumerate([*ids_by_library(WORD, t), 2])}
    asked = [*list(want)[::3], (0, -1), (0, 100_000), (9999, 0), (None, 0)]
    got = tokencodes.lookup(shards, spark.createDataFrame(asked, "doc_id long, position long"), pieces=3).collect()
    assert sorted(got, key=repr) == sorted([(i, at, want.get((i, at))) for i, at in asked], key=repr)
    assert tokencodes.lookup(shards, spark.createDataFrame([], "doc_id long, position long")).count() == 0
    index = tokencodes.index_of(shards)
    for listed in (tokencodes.LISTED, 0):
        monkeypatch.setattr(tokencodes, "LISTED", listed)
        again = tokencodes.lookup(shards, spark.createDataFrame(asked + asked, "doc_id long, position long"), index=index).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got + got))


# --- 6 -----------------------------------------------------------------------------------------------------------------------


def filtered(pixels, kind):
    """One image with every row under one filter, by the definition."""
    h, w = pixels.shape
    at = lambda y, x: int(pixels[y, x]) if y >= 0 and x >= 0 else 0
    lines = bytearray()
    for y in range(h):
        lines.append(kind)
        for x in range(w):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines.append((at(y, x) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
    return media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(lines))) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (9, 13), np.uint8)
    assert (media.png_decode(filtered(pixels, kind)) == pixels).all()
    assert (media.png_decode(media.png_encode(pixels)) == pixels).all()


def test_png_damage():
    data = bytearray(media.png_encode(np.zeros((2, 4), np.uint8)))
    for at in (0, 20, 45, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.png_decode(bytes(bad))
    with pytest.raises(ValueError):
        media.png_decode(bytes(data[:-12]))


def test_media(spark):
    texts = [*EDGE, "y" * 64, "y" * 64]
    got = {r.doc_id: r for r in media.read_media(cut(media.store_texts(docs_of(spark, texts)))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[7][1:] == got[8][1:] and len(got[0].cosine_hash) == 8
    assert media.read_media(media.store_texts(docs_of(spark, []))).count() == 0
    broken = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert media.read_media(broken).first().media_bytes is None


def test_hash_is_stable_under_noise():
    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(10, 245, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    noisy = np.clip(image.astype(int) + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    apart = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b, strict=True))
    other = media.cosine_hash(rng.integers(0, 256, (64, 64), np.uint8))
    assert apart(media.cosine_hash(image), media.cosine_hash(noisy)) < 8 < 20 < apart(media.cosine_hash(image), other)


# --- 8 -----------------------------------------------------------------------------------------------------------------------


def test_quotes(spark):
    messages = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> How are  YOU?\nFine"), (1, 2, "user", "unrelated"), (1, 3, "assistant", "Bob wrote:\n>> How are you?\n> Fine\nNice"), (1, 4, "user", "> Hello there\n> How are you?\n\nok"), (1, 5, "user", "> nothing such\nhm"), (2, 0, "user", None), (2, 1, None, ""), (None, 0, "user", "> x\ny"), (3, None, "user", "q"), (3, None, "user", "q")]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(9))
    got = {(r.conv_id, r.turn): r for r in quotes.thread(df).collect()}
    assert [(got[1, t].text, got[1, t].reply_to, got[1, t].position) for t in range(6)] == [("Hello there\nHow are you?", None, 0), ("Fine", 0, 1), ("unrelated", None, 4), ("Nice", 1, 2), ("ok", 0, 3), ("hm", None, 5)]
    assert got[1, 3].n_quotes == got[1, 3].n_linked == 2 and got[1, 5].n_linked == 0 and got[None, 0].text == "y"
    found = {(r.turn, r.level): r.linked_turn for r in quotes.links(quotes.parse(df)).filter("conv_id = 1").collect()}
    assert found == {(1, 1): 0, (3, 2): 0, (3, 1): 1, (4, 1): 0, (5, 1): None}
    chat = {(r.conv_id, r.segment): r for r in quotes.chats(quotes.thread(df), 4).collect()}
    assert chat[1, 0].turns == [0, 1, 3, 4] and chat[1, 1].turns == [2, 5] and chat[3, 0].turns == [None, None]
    assert chat[1, 1].chat == "<|user|>\nunrelated\n<|end|>\n<|user|>\nhm\n<|end|>"
    assert quotes.chats(quotes.thread(df.limit(0))).count() == 0


def test_random_quote_trees(spark):
    """Random replies that quote any earlier messages, whole or a line of them, on any level: links, replies and texts by hand."""
    rng = random.Random(21)
    norm = lambda x: " ".join(x.lower().split())
    messages, own, passages = [], {}, {}
    for conv in range(12):
        for t in range(9):
            own[conv, t] = "\n".join(rng.choice(["Yes", "no  way", "See you", "perhaps", f"line {rng.randrange(4)}"]) for _ in range(rng.randrange(0, 4)))
            quotes_, lines = [], []
            last = 0
            for _ in range(rng.randrange(0, 3) if t else 0):
                level = rng.choice([x for x in (1, 2, 3) if x != last])
                last = level
                body = own[conv, rng.randrange(t)].split("\n") if rng.random() < 0.8 else ["nobody said this"]
                body = body if rng.random() < 0.6 else [rng.choice(body)]
                body = [x.upper() if rng.random() < 0.3 else x for x in body]
                quotes_.append((level, body))
                lines += [">" * level + " " + x for x in body]
            passages[conv, t] = quotes_
            messages.append((conv, t, "user", "\n".join([*lines, own[conv, t]])))
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.thread(df).collect()}
    chat = {r.conv_id: r for r in quotes.chats(quotes.thread(df)).collect()}
    parent = {}
    for (conv, t), found in passages.items():
        linked = []
        for level, body in found:
            units = {norm(x) for x in [*body, "\n".join(body)]} - {""}
            votes = Counter()
            for u in units:
                who = [s for s in range(t) if u in {norm(x) for x in [*own[conv, s].split("\n"), own[conv, s]]}]
                if who:
                    votes[max(who)] += 1
            if votes:
                linked.append((level, max(votes, key=lambda s: (votes[s], s))))
        r = got[conv, t]
        assert r.n_linked == len(linked) and r.n_quotes == len(found) and r.text == own[conv, t].strip("\n"), (conv, t)
        parent[conv, t] = max((s for lv, s in linked if lv == min(x for x, _ in linked)), default=None)
        assert r.reply_to == parent[conv, t]
    path = lambda c, t: (*(path(c, parent[c, t]) if parent[c, t] is not None else ()), t)
    for conv in range(12):
        order = sorted(range(9), key=lambda t: path(conv, t))
        assert [t for t in sorted(range(9), key=lambda t: got[conv, t].position)] == order
        assert chat[conv].turns == [t for t in order if got[conv, t].text or passages[conv, t]]


def test_long_conversations_are_whole(spark):
    df = spark.createDataFrame([(1, t, "user", f"say {t}") for t in range(150)], "conv_id long, turn long, role string, text string")
    assert [r.turns for r in quotes.chats(quotes.thread(df)).collect()] == [list(range(150))]
    assert sorted(len(r.turns) for r in quotes.chats(quotes.thread(df), 64).collect()) == [22, 64, 64]


def test_quote_of_repeated_words_links_latest(spark):
    n = 60
    messages = [(1, t, "user", "ok") for t in range(n)] + [(1, n, "user", "> ok\nsee"), (1, n + 1, "user", "> see\nthen")]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.thread(df).collect()}
    assert got[n].reply_to == n - 1 and got[n + 1].reply_to == n and got[n + 1].position == n + 1


def test_a_line_that_all_say_and_quote_is_many_tasks(spark):
    n = 400
    df = spark.createDataFrame([(1, t, "user", "> +1\n+1" if t else "+1") for t in range(n)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = quotes.links(quotes.parse(df.repartition(3))).collect()
        parts = quotes.running(df.withColumn("spoken", F.col("turn")), ["conv_id"], ["turn"], "spoken", highest=True)
        assert all(r.before == (r.turn - 1 if r.turn else None) for r in parts.collect()) and parts.count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r.turn, r.linked_turn, r.matched) for r in got) == [(t, t - 1, 1) for t in range(1, n)]


def test_reply_order_by_hand(spark):
    """Against paths of turns, on chains, stars, forests, repeated and missing turns; no array grows with a thread's length."""
    rng = random.Random(5)
    messages, parent = [], {}
    for conv, kind in enumerate(("chain", "star", "random", "flat")):
        for t in range(70):
            up = None if t == 0 or kind == "flat" else t - 1 if kind == "chain" else 0 if kind == "star" else rng.choice([None, *range(t)])
            parent[conv, t] = up
            for role in ("user",) * (1 + (t % 13 == 5)):
                messages.append((conv, t, role, ("" if up is None else f"> say {up} x\n") + f"say {t} x"))
    messages += [(2, None, "user", "q"), (None, 1, "a", "one"), (None, 1, "b", "two"), (None, None, "c", "three")]
    rng.shuffle(messages)
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    path = lambda c, t: (-1,) if t is None else (*(path(c, parent[c, t]) if parent[c, t] is not None else ()), t)
    want = [(c, t, i) for c in range(4) for i, t in enumerate(sorted((m[1] for m in messages if m[0] == c), key=lambda t: path(c, t)))]
    threaded = quotes.thread(df).cache()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.conv_id, r.turn, r.position) for r in threaded.collect() if r.conv_id is not None), key=key) == sorted(want, key=key)
    assert {(r.conv_id, r.turn): r.reply_to for r in threaded.collect() if r.conv_id is not None and r.turn is not None} == parent
    assert [r.position for r in threaded.filter("conv_id IS NULL").collect()] == [0, 0, 0]
    assert sorted(r.chat for r in quotes.chats(threaded).filter("conv_id IS NULL").collect()) == ["<|a|>\none\n<|end|>", "<|b|>\ntwo\n<|end|>", "<|c|>\nthree\n<|end|>"]


def test_messages_that_only_quote_stay(spark):
    messages = [(1, 0, "user", "hello"), (1, 1, "bot", "> hello"), (1, 2, "user", "bye"), (2, 0, "user", "> one"), (2, 1, "user", "> two")]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.turns, r.n_linked, r.chat) for r in quotes.chats(quotes.thread(df)).collect()}
    assert got == {1: ([0, 1, 2], 1, "<|user|>\nhello\n<|end|>\n<|user|>\nbye\n<|end|>"), 2: ([0, 1], 0, "")}


# --- 9 -----------------------------------------------------------------------------------------------------------------------


def targets_by_hand(sizes):
    """Shares by weight; sources above three times their size stop there and the rest is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, full, out = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(3 * sizes[s] for s in full)
        out = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def test_no_bin_of_keys_is_large(spark):
    """Sources of prose, of code and of nothing but digits: whatever their weights, keys spread over bins."""
    texts = ["plain words only", "x = {1: 2}; y[3] |= 4", "1234567890"]
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 3 + 1).cast("int")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    bins = mixing.keyed(df).groupBy("source", "_bin").agg(F.count("*").alias("n"))
    most = {r.source: (r.most, r.mean) for r in bins.groupBy("source").agg(F.max("n").alias("most"), F.avg("n").alias("mean")).collect()}
    assert all(a <= 60 and a < 8 * b for a, b in most.values())
    order = mixing.keyed(df).select("_key", "_bin").orderBy("_key").collect()
    assert all(x._bin <= y._bin for x, y in zip(order, order[1:], strict=False))


def test_mixing(spark):
    rng = random.Random(8)
    data = [(i, "w " * rng.choice([1, 5, 20, 80]), rng.choice(["a", "b", "é", "z", None, "tiny", "big", "big", "big"])) for i in range(600)] + [(700, None, "a"), (701, "", "void"), (702, "x", "tiny")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mixing_plan(df).collect()
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want, taken = targets_by_hand(sizes), Counter()
    for r in got:
        assert r.size == len((data[[d[0] for d in data].index(r.doc_id)][1] or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes) and len(got) == len(data)
    whole = {s: int(want[s] // sizes[s]) if sizes[s] else 0 for s in sizes}
    assert all(r.copies >= whole[r.source] for r in got)
    assert rows(mixing.mixing_plan(df.repartition(7))) == sorted((tuple(r) for r in got), key=repr)
    mixed = mixing.mix(df.withColumn("_size", F.lit("clash")))
    assert mixed.columns == [*df.columns, "_size"]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mixing_plan(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mixing_plan(df.filter("doc_id >= 700 AND doc_id < 702")).collect()] == [0, 0]


def test_rows_without_or_with_one_id_are_mixed_one_by_one(spark):
    """Null and repeated ids, and rows alike in everything: each source is still within half a document of its target."""
    data = [(None, f"{i} " + "w " * 9, "a") for i in range(90)] + [(5, f"{i} " + "w " * 9, "b") for i in range(150)] + [(None, "same " * 10, "c")] * 200 + [(7, "same " * 10, "d")] * 70
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    plan = mixing.mixing_plan(df).collect()
    want, taken = targets_by_hand({"a": 900, "b": 1500, "c": 2000, "d": 700}), Counter()
    for r in plan:
        taken[r.source] += r.taken
    assert len(plan) == len(data) and all(abs(taken[s] - want[s]) <= 5.5 for s in want)
    assert rows(mixing.mixing_plan(df)) == sorted(map(tuple, plan), key=repr)
    assert mixing.mix(df).count() == sum(r.copies for r in plan)


def test_heavier_documents_win(spark):
    data = [(i, ("1 " if i % 2 else "w ") * 10, "s" if i < 2000 else "t") for i in range(4000)]
    plan = mixing.mixing_plan(spark.createDataFrame(data, "doc_id long, text string, source string")).filter("source = 's' AND copies > 0").collect()
    clean = sum(1 for r in plan if r.doc_id % 2 == 0)
    assert clean > 0.7 * len(plan)


# --- 10 ----------------------------------------------------------------------------------------------------------------------


def best_by_hand(data, k, divisor):
    q = [(i, v, [math.floor(64 * x) for x in e]) for i, (v, e) in enumerate(data) if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e in q:
        if v % divisor == 0:
            all_ = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), w, j) for j, w, f in q if j != i)[:k]
            out += [(v, r + 1, w, -s) for r, (s, w, _) in enumerate(all_)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("big", [1.0, 1e6, 1e12])
def test_top_k(spark, big):
    rng = np.random.default_rng(3)
    data = [(int(i), (rng.integers(-3, 4, 6) / 4 * big).tolist()) for i in range(150)]
    data += [(20, None), (40, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (60, [float("nan")] * 6), (80, [float("inf")] * 6), (None, [0.0] * 6), (3, [0.5] * 6), (20, [0.25] * 6), (500, [1.0, 2.0]), (520, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash"))
    got = rows(topk.top_k(df, F.col("vec_id") % 20 == 0, 7, query_block=4, shard=16, fan=2))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    if big < 1e12:
        assert got == best_by_hand(data, 7, 20)
    else:
        assert len(got) == len(best_by_hand(data, 7, 20)) and all(s == clip(s) for *_, s in got)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows(topk.top_k(few, F.col("vec_id") % 20 == 0)) == [(0, 1, 1, 8192)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_an_encoder_keeps_as_much_as_it_is_asked_to():
    """Packing names a smaller cache than other users of a file: a worker then holds that and one slice, with the same ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i} x{i * 7919}y" for i in range(at, at + 200)) for at in range(0, 8_000, 200)]
    small, usual = tokenize.encoder(path, 1_000), tokenize.PieceEncoder(path)
    assert small.kept == 1_000 and packing.KEPT < usual.kept and packing.BYTES <= 1 << 20
    for text in texts:
        assert small.encode([text])[0].tolist() == usual.encode([text])[0].tolist()
        assert len(small.begins) <= 1_000 + 2
    assert len(usual.begins) > 8_000
    assert tokenize.encoder(path).kept == usual.kept
