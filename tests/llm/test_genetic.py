import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from labelwright.llm import genetic

WORDS = public_tokenizers.path("word_bpe_49k.json")


def valid(bins, lengths, capacity):
    return sorted(i for own in bins for i in own) == list(range(len(lengths))) and all(own and sum(lengths[i] for i in own) <= capacity for own in bins)


def test_best_fit_takes_the_tightest_bin():
    assert genetic.best_fit([0, 1, 2, 3], [6, 5, 4, 5], 10) == [[0, 2], [1, 3]]
    assert genetic.best_fit([2], [6, 8, 2], 10, [[0], [1]]) == [[0], [1, 2]]
    assert genetic.best_fit([], [], 10) == []


def test_operators_keep_packings_whole_and_evolution_never_gets_worse():
    rng = np.random.default_rng(1)
    for capacity, low, high in ((100, 1, 99), (100, 20, 55), (1000, 1, 60)):
        lengths = rng.integers(low, high, 150).tolist()
        first = genetic.founders(lengths, capacity, 1, 4, rng)
        child = genetic.crossover(first[0], first[-1], lengths, capacity, rng)
        assert all(valid(x, lengths, capacity) for x in [*first, child, genetic.mutate(child, lengths, capacity, rng)])
        last = genetic.evolve(first, lengths, capacity, 30, rng)
        assert all(valid(x, lengths, capacity) for x in last) and len(last[0]) <= min(map(len, first))


def test_crossover_injects_whole_bins():
    rng = np.random.default_rng(2)
    lengths = rng.integers(20, 55, 80).tolist()
    one, two = (genetic.founders(lengths, 100, k, 1, rng)[0] for k in (2, 3))
    child = {tuple(sorted(x)) for x in genetic.crossover(one, two, lengths, 100, rng)}
    fills = sorted((sum(lengths[i] for i in x) for x in two), reverse=True)
    assert any(tuple(sorted(x)) in child for x in two if sum(lengths[i] for i in x) >= fills[len(two) // 2])


def test_evolution_finds_what_best_fit_misses():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1000, 2000, 300).tolist()
    first = genetic.founders(lengths, 4096, 0, 4, rng)
    assert len(genetic.evolve(first, lengths, 4096, 100, rng)[0]) < min(map(len, first))


def test_levels_fill_what_groups_leave(spark):
    lengths = np.random.default_rng(3).integers(1, 90, 900).tolist() + [100] * 7
    items = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "row long, length long").repartition(3)
    got = genetic.place(items, 100, group=200).join(items, "row").collect()
    assert sorted(r.row for r in got) == list(range(len(lengths)))
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        ends = [0]
        for at, n in sorted(own):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 100
    at_once = genetic.best_fit(sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True), lengths, 100)
    assert len(bins) <= 1.02 * len(at_once)
    again = genetic.place(items, 100, group=200)
    assert sorted((r.row, r.sequence_id, r.offset) for r in again.collect()) == sorted((r.row, r.sequence_id, r.offset) for r in got)


def test_documents_of_every_kind(spark):
    texts = [(1, "one two three"), (2, None), (2, ""), (None, "x y"), (3, "word " * 9000), (4, "a b " * 100), (4, "a b " * 100), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, row int, ids string")
    got = genetic.pack(df, WORDS).collect()
    coder = Tokenizer.from_file(WORDS)
    want = []
    for doc_id, text in texts:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want.append((doc_id, k, at, len(own), np.array(own, "<u2").tobytes(), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert genetic.pack(df.limit(0), WORDS).count() == 0
