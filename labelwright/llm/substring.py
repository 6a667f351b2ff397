"""Removal of repeated passages: windows of words counted exactly in super-k-mer partitions.

The minimiser of a window is the smallest hash of its runs of ``MINIMISER`` words. Neighbouring windows with one minimiser
travel as one packed string (their words once, not once a window) to the minimiser's bucket, where all windows
with that content meet. A bucket numbers its words, sorts its windows and counts those of equal words.

Before they travel, equal strings of a task become one string with a list of places. A minimiser that many strings
share (a passage that many texts quote in other surroundings) would fill one bucket; such minimisers are found by
counting all of them beforehand. Their windows become rows of digest and place: digests are counted with partial sums, and
places are marked by a join in which a frequent digest's places stay where they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelwright.llm.common import cut, hold, release, slices
from labelwright.llm.words import Words, least_of, mix, powers, runs_of

WINDOW, MINIMISER = 35, 4
#: Strings of a bucket, about. A bucket is what one Python call holds.
BUCKET_STRINGS = 40_000
#: Strings of one minimiser (and places of one window) beyond which its windows are rows of their own (and its places stay).
HOT = 5_000
#: Hot minimisers and frequent digests up to which they are broadcast (8 and 16 bytes each); beyond it they are joined, in so many parts.
BROADCAST, SALTS = 500_000, 64
BYTES = 1 << 20
#: Windows of one string at most: a longer stretch of one minimiser goes as several strings, which overlap by a window's words but one.
STRETCH = 512
KEYED = "k1 long, k2 long, text string"
SPANS = "k1 long, k2 long, begin long, end long"
SINGLES = "d1 long, d2 long, k1 long, k2 long, start long"


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """k1, k2 name a row by its content, so any evaluation of the input gives the same names. Rows alike share a name and a result."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(*more, F.coalesce(doc_id, F.lit(0)).alias("k1"), F.xxhash64(doc_id.isNull(), text).alias("k2"), text.alias("text"))


class _Windows:
    """Windows of a slice of texts: starts (word places), minimisers, and the stretches of equal minimiser."""

    def __init__(self, texts: list[str | None], window: int, m: int):
        self.words = w = Words(texts)
        counts = np.maximum(w.counts - window + 1, 0)
        self.n = int(counts.sum())
        if not self.n:
            return
        ends = np.cumsum(counts)
        self.text = np.repeat(np.arange(counts.size), counts)
        self.at = np.arange(self.n) - np.repeat(ends - counts, counts) + np.repeat(w.first[:-1], counts)
        least = least_of(runs_of(w.hashes, m), window - m + 1)[self.at]
        new = np.ones(self.n, bool)
        new[1:] = (np.diff(self.at) != 1) | (least[1:] != least[:-1])
        place = np.arange(self.n)
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % STRETCH == 0
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], self.n)
        self.least = least[self.begin]


def _prefix(minimisers: np.ndarray) -> np.ndarray:
    """Minimisers are counted by their first 32 bits: what is hot then is what must be, and seldom more."""
    return (minimisers >> np.uint64(32)).astype(np.int64)


def _minimisers(window: int, m: int):
    """Counts of strings by minimiser, for each slice; every minimiser is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("repeats")
        for batch in batches:
            for a, b, texts in slices(batch.column(0), BYTES):
                found = _Windows(texts, window, m)
                if found.n:
                    values, n = np.unique(_prefix(found.least), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["minimiser", "n"])

    return run


def _hot(docs: DataFrame, window: int, m: int, hot: int) -> tuple[DataFrame, int]:
    """(minimiser) of more than ``hot`` strings, as a stored table; and the number of all strings."""
    counted = docs.select("text").mapInArrow(_minimisers(window, m), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    found = cut(counted.groupBy(F.when(F.col("n") > hot, F.col("minimiser")).alias("minimiser")).agg(F.sum("n").alias("n")), "minimisers")
    return found.filter("minimiser IS NOT NULL").select("minimiser"), found.agg(F.sum("n")).first()[0] or 0


def _with_hot(texts: DataFrame, found: DataFrame, window: int, m: int) -> DataFrame:
    """``texts`` with ``hot``: the hot minimisers that each text has, by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("repeats")
        for batch in batches:
            keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, texts in slices(batch.column(2), BYTES):
                own = _Windows(texts, window, m)
                if own.n:
                    text = own.text[own.begin] + a
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[0][text], keys[1][text], _prefix(own.least))], names=["k1", "k2", "minimiser"])

    pairs = texts.mapInArrow(run, "k1 long, k2 long, minimiser long").distinct()
    salt = F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int").alias("salt")
    salted = found.select("minimiser", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lists = pairs.select("*", salt).join(salted, ["minimiser", "salt"]).groupBy("k1", "k2").agg(F.collect_set("minimiser").alias("hot"))
    return texts.join(lists, ["k1", "k2"], "left").select("k1", "k2", "text", "hot")


class _Routes:
    """Which windows of a slice go alone: those of hot minimisers, known to every task (``shared``) or listed beside each text."""

    def __init__(self, shared):
        self.shared = shared

    def alone(self, batch: pa.RecordBatch, found: _Windows, a: int, b: int) -> np.ndarray:
        """For each string of the slice, whether its minimiser is hot."""
        if self.shared is not None:
            many = self.shared.value
        else:
            many = np.unique(batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False))
        return np.isin(_prefix(found.least), many)


def _singles(window: int, m: int, routes: _Routes):
    """A row (128-bit digest of its words, place) for each window of a hot minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("repeats")
        for batch in batches:
            keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, texts in slices(batch.column(2), BYTES):
                found = _Windows(texts, window, m)
                if not found.n:
                    continue
                single = routes.alone(batch, found, a, b)
                own = np.flatnonzero(np.repeat(single, found.end - found.begin))
                for at in range(0, own.size, 65_536):
                    some = own[at : at + 65_536]
                    first, text = found.at[some], found.text[some]
                    starts, ends = found.words.starts[first].tolist(), found.words.ends[first + window - 1].tolist()
                    data = found.words.data
                    digests = np.frombuffer(b"".join([blake2b(data[s:e], digest_size=16).digest() for s, e in zip(starts, ends, strict=True)]), np.int64).reshape(-1, 2)
                    columns = digests[:, 0], digests[:, 1], keys[0][text + a], keys[1][text + a], first - found.words.first[text]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["d1", "d2", "k1", "k2", "start"])

    return run


def _marked(singles: DataFrame, window: int, hot: int) -> DataFrame:
    """Spans of windows whose digest more places have. Places of a digest that more than ``hot`` have don't meet: they are marked
    where they are (broadcast) or, if such digests are very many, in ``SALTS`` parts."""
    seen = cut(singles.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1"), "digests")
    frequent = seen.filter(F.col("n") > hot).select("d1", "d2", F.lit(True).alias("often"))
    if frequent.count() <= BROADCAST:
        told = singles.join(F.broadcast(frequent), ["d1", "d2"], "left")
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("k1", "k2", "start"), F.lit(SALTS)).cast("int")
        told = singles.withColumn("salt", salt).join(salted, ["d1", "d2", "salt"], "left")
    twice = told.filter("often IS NULL").join(seen.filter(F.col("n") <= hot), ["d1", "d2"], "left_semi")
    return told.filter("often").select("k1", "k2", "start").unionByName(twice.select("k1", "k2", "start")).select("k1", "k2", F.col("start").alias("begin"), (F.col("start") + window).alias("end"))


def _pack(strings: dict[bytes, list[tuple[int, int, int]]]) -> bytes:
    places = np.array([p for own in strings.values() for p in own], np.int64).reshape(-1, 3)
    n = np.fromiter(map(len, strings.values()), np.uint32, len(strings))
    raw = struct.pack("<II", len(strings), len(places)) + n.tobytes() + places.T.tobytes() + b"\n".join(strings)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpack(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    strings, places = struct.unpack_from("<II", raw)
    n = np.frombuffer(raw, np.uint32, strings, 8)
    at = 8 + 4 * strings
    return raw[at + 24 * places :].split(b"\n"), n, np.frombuffer(raw, np.int64, 3 * places, at).reshape(3, places)


def _travel(window: int, m: int, buckets: int, routes: _Routes):
    """The strings of all minimisers that aren't hot, packed for their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("repeats")
        for batch in batches:
            keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in slices(batch.column(2), BYTES):
                found = _Windows(texts, window, m)
                if not found.n:
                    continue
                own = np.flatnonzero(~routes.alone(batch, found, a, b))
                w, begin, end = found.words, found.begin[own], found.end[own]
                first = found.at[begin]
                starts, ends = w.starts[first], w.ends[found.at[end - 1] + window - 1]
                text = found.text[begin]
                held: dict[int, dict[bytes, list]] = {}
                columns = (found.least[own] % np.uint64(buckets)).tolist(), starts.tolist(), ends.tolist(), (text + a).tolist(), (first - w.first[text]).tolist()
                for bucket, s, e, row, place in zip(*columns, strict=True):
                    held.setdefault(bucket, {}).setdefault(w.data[s:e], []).append((keys[0][row], keys[1][row], place))
                packed = [_pack(x) for x in held.values()]
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    return run


def _same(ids: np.ndarray, x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
    """Which windows at x have the words of those at y."""
    view = np.lib.stride_tricks.sliding_window_view(ids, window)
    return np.concatenate([(view[x[i : i + 65_536]] == view[y[i : i + 65_536]]).all(1) for i in range(0, x.size, 65_536)] or [np.zeros(0, bool)])


def repeated(strings: list[bytes], n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (string, first window, last window) of windows whose words start elsewhere too. n: places of each string."""
    lists = pc.split_pattern(pa.array(strings, pa.binary()).cast(pa.string()), " ")
    ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int32)
    first = lists.offsets.to_numpy().astype(np.int64)
    counts = np.diff(first) - window + 1
    total = int(counts.sum())
    string = np.repeat(np.arange(counts.size), counts)
    inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at = inside + first[string]
    up, down = powers(ids.size + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    hashes = (sums[at + window] - sums[at]) * down[at]
    order = np.argsort(hashes, kind="stable")
    new = np.ones(total, bool)
    new[1:] = np.diff(hashes[order]) != 0
    # Equal hashes must be equal words; where they are not, that group's windows are sorted by their words.
    follow = np.flatnonzero(~new)
    wrong = follow[~_same(ids, at[order[follow]], at[order[follow - 1]], window)]
    group = np.cumsum(new) - 1
    for g in np.unique(group[wrong]).tolist():
        own = np.flatnonzero(group == g)
        by_words = np.lexsort(np.lib.stride_tricks.sliding_window_view(ids, window)[at[order[own]]].T[::-1])
        order[own] = order[own][by_words]
        new[own[1:]] = ~_same(ids, at[order[own[1:]]], at[order[own[:-1]]], window)
    begins = np.flatnonzero(new)
    seen = np.add.reduceat(n[string][order].astype(np.int64), begins) if total else np.zeros(0, np.int64)
    twice = np.zeros(total, bool)
    twice[order] = np.repeat(seen > 1, np.diff(np.append(begins, total)))
    hit = np.flatnonzero(twice)
    if not hit.size:
        return hit, hit, hit
    edge = np.flatnonzero((np.diff(hit) != 1) | (np.diff(string[hit]) != 0))
    low, high = hit[np.append(0, edge + 1)], hit[np.append(edge, hit.size - 1)]
    return string[low], inside[low], inside[high]


def _count(window: int):
    names = ["k1", "k2", "begin", "end"]

    def run(table: pa.Table) -> pa.Table:
        hold("repeats")
        parts = [_unpack(x) for x in table.column("packed").to_pylist()]
        strings = [s for own, _, _ in parts for s in own]
        n = np.concatenate([x for _, x, _ in parts])
        places = np.concatenate([x for _, _, x in parts], axis=1)
        string, low, high = repeated(strings, n, window)
        times = n[string].astype(np.int64)
        from_place = np.cumsum(n, dtype=np.int64) - n
        place = np.repeat(from_place[string] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        del parts, strings
        release()
        k1, k2, start = places[:, place]
        return pa.table([k1, k2, start + np.repeat(low, times), start + np.repeat(high, times) + window], names=names)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """k1, k2, begin, end: word spans of rows that repeated windows cover. Spans may overlap."""
    spark = docs.sparkSession
    texts = _keyed(docs).select("k1", "k2", "text")
    found, strings = _hot(texts, window, minimiser, hot)
    n_hot = found.count()
    few = n_hot <= BROADCAST
    routes = _Routes(spark.sparkContext.broadcast(np.array([r[0] for r in found.collect()], np.int64)) if few else None)
    if not few:
        texts = _with_hot(texts, found, window, minimiser)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), strings // BUCKET_STRINGS)
    packed = texts.mapInArrow(_travel(window, minimiser, buckets, routes), "bucket long, packed binary")
    spans = packed.groupBy("bucket").applyInArrow(_count(window), SPANS)
    if not n_hot:
        return spans
    singles = cut(texts.mapInArrow(_singles(window, minimiser, routes), SINGLES), "singles")
    return spans.unionByName(_marked(singles, window, hot))


def _kept(spacing: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("repeats")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: tuple[list, ...] = ([], [], [])
                for i, text in enumerate(part.column(1).to_pylist()):
                    begin, end = (part.column(c)[i] if part.column(c)[i].is_valid else None for c in (2, 3))
                    words = text.encode().split() if text else []
                    n = len(words)
                    hit = begin is not None
                    if hit:
                        edges = np.zeros(n + 1, np.int64)
                        np.add.at(edges, begin.values.to_numpy(), 1)
                        np.add.at(edges, end.values.to_numpy(), -1)
                        words = list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
                    kept = text if spacing and not hit else b" ".join(words).decode()
                    for column, value in zip(out, (n, n - len(words), kept), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["row", "n_words", "n_removed", "kept"])
        release()

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot: int = HOT, spacing: bool = False) -> DataFrame:
    """row (a struct of the other columns, by whatever names), n_words, n_removed and kept, for each row of ``docs``.

    ``kept`` is the words outside repeated windows, joined by one space; with ``spacing`` a text that loses nothing stays
    as it was. Null and empty texts have no words; texts shorter than a window keep all; rows alike repeat each other
    and lose every window. A very long text is worked on whole, in two numbers a repeated window and some 100 bytes a word.
    """
    spans = repeated_spans(docs, window, minimiser, hot).groupBy("k1", "k2").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row")
    named = _keyed(docs.select(others, "doc_id", "text"), "row")
    joined = named.join(spans, ["k1", "k2"], "left").select("row", "text", "begins", "ends")
    kind = StructType([joined.schema["row"], *(StructField(c, LongType()) for c in ("n_words", "n_removed")), StructField("kept", StringType())])
    return joined.mapInArrow(_kept(spacing), kind)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same result from every window's words, grouped.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), hit AS (
  SELECT r, i FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM hit
), word AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
