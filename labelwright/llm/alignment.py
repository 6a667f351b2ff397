"""Two tokenizers' ids of one text, aligned by galloping intersection of their token ends.

Ends are byte offsets. The shorter list of a text's ends drives: from the place where an earlier end was found, steps that double go
forward in the longer list until they pass the wanted end, and a binary search between the last two steps finds it. Offsets that
both lists hold cut the tokens into groups; differences of ranks give the tokens of the one that lie on a token of the other.

A slice of texts is aligned at once and becomes one stored row, a block, with its different (A id, B id) links and how often each text has
them. Counts over the corpus meet a block once for each different link, so the commonest link has a row a block and no more,
and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import cut, hold, slices
from labelwright.llm.tokenize import PieceEncoder

#: Driving ends of which one is found from the text's begin; the others start where that one was found.
STRIDE = 32
BYTES = 1 << 21
#: Stretches that a worker keeps of either tokenizer.
KEPT = 500_000
#: A link is one number: A id, then B id in so many bits.
B_BITS = 16
BLOCKS = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, links array<long>, times array<long>, held array<long>, own binary, own_times binary"
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class PlainEncoder(PieceEncoder):
    """Ids of whole texts in which the names of special tokens are plain text; ``data`` has each id's bytes."""

    kept = KEPT

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added, self.cut = {}, None
        back = {ord(shown): byte for byte, shown in self.alphabet.items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.data = [n.translate(back).encode("latin-1") if all(ord(c) in back for c in n) else n.encode() for n in names]


class SpaceEncoder:
    """Ids of whole texts by a sentencepiece file, whose pieces have a space at their begin only, or are spaces.

    A text is cut at its single spaces then, and a stretch is encoded once a worker; a text with other spaces is encoded whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.data = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.data.append(bytes([int(piece[3:5], 16)]))
            else:
                self.data.append(b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace("▁", " ").encode())
        if len(self.data) > 1 << B_BITS or any(b" " in x.lstrip(b" ") for x in self.data):
            raise ValueError(f"{path}: pieces that go over spaces, or too many")
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.pool, self.begins = array("H"), array("q", [0])

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            got = self.model.encode(new[at : at + 4096], num_threads=1)
            self.places.update(zip(new[at : at + 4096], range(len(self.begins) - 1, len(self.begins) - 1 + len(got)), strict=True))
            for ids in got:
                self.pool.extend(ids)
                self.begins.append(len(self.pool))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        tight = ["  " not in t and "▁" not in t and t[:1] != " " and t[-1:] != " " for t in texts]
        lists = pc.split_pattern(pa.array([t if k else "" for t, k in zip(texts, tight, strict=True)], pa.string()), " ")
        codes = lists.flatten().dictionary_encode()
        different = codes.dictionary.to_pylist()
        self._learn([x for x in different if x not in self.places])
        place = np.fromiter(map(self.places.__getitem__, different), np.int64, len(different))[codes.indices.to_numpy()]
        begins = np.frombuffer(self.begins, np.int64)
        own = begins[place + 1] - begins[place]
        ends = np.append(0, np.cumsum(own))
        ids = np.frombuffer(self.pool, np.uint16)[np.repeat(begins[place] - ends[:-1], own) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        loose = [i for i, k in enumerate(tight) if not k]
        for i, got in zip(loose, self.model.encode([texts[i] for i in loose], num_threads=1) if loose else (), strict=True):
            out[i] = np.array(got, np.uint16)
        del begins
        if len(self.begins) > KEPT or len(self.pool) > 8 * KEPT:
            self.clear()
        return out


@lru_cache(maxsize=1)
def _pair(a: str, b: str) -> tuple[PlainEncoder, SpaceEncoder]:
    return PlainEncoder(a), SpaceEncoder(b)


def gallop(wanted: np.ndarray, start: np.ndarray, ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first place in ``ends`` (ascending), from ``start`` on and ``last`` at most, whose end isn't below ``wanted``; all of them at once.

    What is at ``last`` must not be below.
    """
    low, step, high = start.copy(), np.ones(start.size, np.int64), start.copy()
    on = np.flatnonzero(ends[high] < wanted)
    while on.size:  # steps that double
        low[on] = high[on] + 1
        high[on] = np.minimum(high[on] + step[on], last[on])
        step[on] *= 2
        on = on[ends[high[on]] < wanted[on]]
    on = np.flatnonzero(low < high)
    while on.size:  # between the last two steps
        middle = (low[on] + high[on]) >> 1
        below = ends[middle] < wanted[on]
        low[on[below]] = middle[below] + 1
        high[on[~below]] = middle[~below]
        on = on[low[on] < high[on]]
    return high


def common(a_ends: np.ndarray, a_first: np.ndarray, b_ends: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of the ends that both lists of a text hold. Ends ascend over all texts; a text's lists end alike."""
    sides = (a_ends, a_first), (b_ends, b_first)
    shorter = np.diff(a_first) <= np.diff(b_first)
    out = []
    for side, drives in ((0, shorter), (1, ~shorter)):
        (own, first), (other, begin) = sides[side], sides[1 - side]
        n = np.diff(first)
        text = np.repeat(np.flatnonzero(drives), n[drives])
        if not text.size:
            continue
        at = np.flatnonzero(np.repeat(drives, n))
        rank, last = at - first[text], begin[text + 1] - 1
        head = rank % STRIDE == 0
        place = np.zeros(at.size, np.int64)
        place[head] = gallop(own[at[head]], begin[text[head]], other, last[head])
        from_head = place[np.maximum.accumulate(np.where(head, np.arange(at.size), 0))]
        place[~head] = gallop(own[at[~head]], from_head[~head], other, last[~head])
        both = other[place] == own[at]
        out.append((at[both], place[both]) if side == 0 else (place[both], at[both]))
    pairs = np.concatenate([np.stack(x) for x in out], axis=1) if out else np.zeros((2, 0), np.int64)
    return tuple(pairs[:, np.argsort(pairs[0], kind="stable")])


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last B token on each A token of one text, by the ranks of its first and last byte among B's ends."""
    if not a_ends.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, zero, last = np.append(0, a_ends[:-1]), np.zeros(a_ends.size, np.int64), np.full(a_ends.size, b_ends.size - 1)
    return gallop(begins + 1, zero, b_ends, last), gallop(a_ends, zero, b_ends, last)


def _ends(ids: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, their ends, and the first place of each text and the end."""
    flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    return flat, np.cumsum(sizes[flat]), np.append(0, np.cumsum([x.size for x in ids])).astype(np.int64)


def _names(ids: np.ndarray, names: np.ndarray, first_of_group: np.ndarray) -> list[str]:
    """The ids of each group, decimal, joined by commas."""
    shown = pa.array(names, pa.string()).take(pa.array(ids))
    lists = pa.ListArray.from_arrays(pa.array(first_of_group, pa.int32()), shown)
    return pc.binary_join(lists, ",")


def align_slice(texts: list[str | None], one: PlainEncoder, two: SpaceEncoder) -> dict[str, list | np.ndarray]:
    """What a block holds of its texts; see ``align``."""
    spaced = [" " + t if t else "" for t in texts]
    a, b = one.encode(spaced), two.encode([t or "" for t in texts])
    none = np.zeros(0, np.uint16)
    for i, t in enumerate(spaced):
        data = t.encode()
        if not t or b"".join(map(one.data.__getitem__, a[i].tolist())) != data or b"".join(map(two.data.__getitem__, b[i].tolist())) != data:
            a[i] = b[i] = none
    sizes = [np.fromiter(map(len, x.data), np.int64, len(x.data)) for x in (one, two)]
    (a_ids, a_ends, a_first), (b_ids, b_ends, b_first) = _ends(a, sizes[0]), _ends(b, sizes[1])
    x, y = common(a_ends, a_first, b_ends, b_first)
    n_groups = np.diff(np.searchsorted(x, a_first))
    names = [_names(ids, np.arange(len(enc.data)).astype(str), np.append(0, at + 1)) for ids, enc, at in ((a_ids, one, x), (b_ids, two, y))]
    groups = pc.binary_join_element_wise(*names, "|")
    cuts = np.append(0, np.cumsum(n_groups))
    shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), groups), ";").to_pylist()
    text = np.repeat(np.arange(len(texts)), n_groups)
    keys, times = np.unique((text << (2 * B_BITS)) | (a_ids[x] << B_BITS) | b_ids[y], return_counts=True)
    links, own = np.unique(keys & ((1 << (2 * B_BITS)) - 1), return_inverse=True)
    total = np.bincount(own, times, links.size).astype(np.int64)
    return {
        "n_a": np.diff(a_first), "n_b": np.diff(b_first), "n_groups": n_groups, "groups": shown, "links": links, "times": total,
        "held": np.bincount(keys >> (2 * B_BITS), minlength=len(texts)), "own": own.astype("<u4").tobytes(), "own_times": times.astype("<u4").tobytes()}


def align(docs: DataFrame, a: str, b: str, shown: bool = False) -> DataFrame:
    """Blocks of aligned texts: ids and groups counted, the groups as ``a1,a2|b1;a3|b2,b3`` (``shown``) or their sha256, and links.

    ``a`` is a byte-level file that gets a space before the text, ``b`` a sentencepiece file that adds one itself. Null and empty texts, and texts
    that either tokenizer doesn't give back byte for byte, have no tokens. Rows that share an id or have none stand for themselves, other columns are
    left out whatever their names, an empty table gives no block, a very long text is a block of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(f"align {a} {b}", _pair.cache_clear)
        one, two = _pair(a, b)
        seq = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, texts in slices(batch.column(1), BYTES):
                made = align_slice(texts, one, two)
                if not shown:
                    made["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in made["groups"]]
                row = [seq, ids[low:high]] + [made[c] for c in ("n_a", "n_b", "n_groups", "groups", "links", "times", "held", "own", "own_times")]
                kinds = [pa.int64()] + [pa.list_(pa.int64())] * 4 + [pa.list_(pa.string())] + [pa.list_(pa.int64())] * 3 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])
                seq += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def link_counts(blocks: DataFrame) -> DataFrame:
    """link, n, best: how many links of all texts each (A id, B id) pair has, and whether no pair of its B id has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("links", "times")).alias("x")).groupBy(F.col("x.links").alias("link")).agg(F.sum("x.times").alias("n"))
    counts = cut(pairs.withColumn("b", F.col("link").bitwiseAND((1 << B_BITS) - 1)), "link-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def link_names(counts: DataFrame) -> DataFrame:
    """a, b, n, best of ``link_counts``."""
    return counts.select(F.shiftright("link", B_BITS).alias("a"), F.col("link").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n", "best")


def documents_of(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each text of the blocks: counts of ids, groups and links, links that are their B id's best, and the sum of its links' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                doc_ids, n_a, n_b, n_groups, groups, held = (row[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "groups", "held"))
                own, times = (np.frombuffer(row[c].as_py(), "<u4").astype(np.int64) for c in ("own", "own_times"))
                n, best = np.zeros(own.max() + 1 if own.size else 0, np.int64), np.zeros(own.max() + 1 if own.size else 0, np.int64)
                if own.size:
                    at, counted, is_best = (x.to_numpy(zero_copy_only=False) for x in row["found"].values.flatten())
                    n[at], best[at] = counted, is_best
                cuts = np.append(0, np.cumsum(held.to_numpy()))
                sums = [np.diff(np.append(0, np.cumsum(v))[cuts]) for v in (times, times * best[own], times * n[own])]
                yield pa.RecordBatch.from_arrays([doc_ids, n_a, n_b, n_groups, *map(pa.array, sums), groups], names=[c.split()[0] for c in ROWS.split(", ")])

    asked = blocks.select("block", F.posexplode("links").alias("at", "link")).join(counts, "link")
    found = asked.groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    return blocks.drop("links", "times").join(found, "block", "left").mapInArrow(run, ROWS)


def aligned_documents(docs: DataFrame, a: str, b: str, shown: bool = False) -> DataFrame:
    blocks = cut(align(docs, a, b, shown), "aligned", compression="zstd")
    return documents_of(blocks, link_counts(blocks))
