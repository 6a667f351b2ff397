"""Periodic runs of words: Lyndon arrays by Baier's grouping, then runs from Lyndon roots.

The first phase of a suffix sorter that works by grouping puts the places of a text into groups by the longest Lyndon word that
begins at each, highest group first: a finished group's places hand their word to the nearest unfinished place on their left, and the
places of one group that get as many copies of it move together into a group of their own, just above the one they leave. A place's word is then
known when its group's turn comes. Under any order of the words and under its reverse, every run has a Lyndon word of its period's length
inside. Each such root is extended both ways by longest common extensions, and what is long enough is a run.

A text is one unit of work of one narrow pass, linear in its words; there is no shuffle.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from labelwright.llm.common import hold, slices
from labelwright.llm.words import mix, powers

#: Words of the shortest run.
LEAST = 12
#: Words of a text from which its tables are packed arrays: slower, and 8 bytes a number.
PACKED = 1 << 20
BYTES = 1 << 20
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon(letters: Sequence[Sequence[int]], n: int) -> Sequence[int]:
    """The length of the longest Lyndon word that begins at each of n places.

    ``letters`` has the places of each letter, ascending, smallest letter first. ``left`` and ``right`` link the unfinished places.
    """
    table = (lambda x: array("q", x)) if n > PACKED else list
    length, of = table([0]) * n, table([0]) * n
    left, right = table(range(-1, n)), table(range(1, n + 2))
    members, size = list(letters), [len(x) for x in letters]
    top = len(members)
    for g, own in enumerate(members):
        for i in own:
            of[i] = g
    below, above = list(range(-1, top)), list(range(1, top + 1)) + [-1]
    members.append(())
    size.append(0)
    g = top - 1
    while g >= 0:
        own, n_own = members[g], size[g]
        members[g] = ()
        if n_own:
            if len(own) > n_own:
                own = [i for i in own if of[i] == g]
            for i in own:
                length[i] = right[i] - i
            # Who gets the word, and how many copies in a row: neighbours of one group hand theirs to the same place.
            takers: list[int] = []
            copies: list[int] = []
            last = -1
            for i in own:
                a, b = left[i], right[i]
                right[a], left[b] = b, a
                of[i] = top
                if a == last:
                    if a >= 0:
                        copies[-1] += 1
                elif a >= 0:
                    takers.append(a)
                    copies.append(1)
                    last = a
            if len(takers) == 1:
                moves = [(of[takers[0]], takers)]
            else:
                found: dict[tuple[int, int], list[int]] = {}
                for p, k in zip(takers, copies, strict=True):
                    found.setdefault((k, of[p]), []).append(p)
                # More copies are higher: they go first, and each next group goes between.
                moves = [(h, found[k, h]) for k, h in (sorted(found, reverse=True) if len(found) > 1 else found)]
            for h, moved in moves:
                if len(moved) == size[h]:
                    continue  # the whole group takes it: its place among the groups is the same
                size[h] -= len(moved)
                new = len(size)
                for p in moved:
                    of[p] = new
                members.append(moved)
                size.append(len(moved))
                u = above[h]
                above[h], below[u] = new, new
                above.append(u)
                below.append(h)
        g = below[g]
    return length


def _extend(codes: np.ndarray, sums: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from places i and j on are equal, ``most`` at most: forward (step 1), or backward from the words before them (-1)."""
    down = powers(codes.size + 1)[1]
    n = np.zeros(i.size, np.int64)
    if not i.size:
        return n
    for bit in range(int(most.max()).bit_length(), -1, -1):
        t = n + (1 << bit)
        ok = np.flatnonzero(t <= most)
        s = t[ok]
        a, b = (i[ok], j[ok]) if step > 0 else (i[ok] - s, j[ok] - s)
        n[ok[(sums[a + s] - sums[a]) * down[a] == (sums[b + s] - sums[b]) * down[b]]] += 1 << bit
    return n


def _slowly(codes: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    n = 0
    while n < most and (codes[i + n] == codes[j + n] if step > 0 else codes[i - 1 - n] == codes[j - 1 - n]):
        n += 1
    return n


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs by start and period: stretches of smallest period q and at least max(least, 2q)
    words that no neighbouring word extends."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.append(0, np.cumsum(counts))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not first[-1]:
        return found
    codes = pa.array([w for own in texts for w in own], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(counts.size), counts)
    order = np.argsort(text * (codes.max() + 1) + codes, kind="stable")  # by text, then letter, then place
    cut = np.flatnonzero(np.append(True, (np.diff(codes[order]) != 0) | (np.diff(text[order]) != 0)))
    places = (order - first[text[order]]).tolist()
    bounds, heads = np.append(cut, codes.size).tolist(), np.append(np.searchsorted(cut, first[:-1]), cut.size).tolist()
    roots = np.zeros((2, codes.size), np.int64)
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= least:
            letters = [places[bounds[k] : bounds[k + 1]] for k in range(heads[t], heads[t + 1])]
            roots[0, a:b] = lyndon(letters, b - a)
            letters.reverse()
            roots[1, a:b] = lyndon(letters, b - a)
    # A root inside its run has the word before it a period further on, too.
    q = roots.ravel()
    i = np.tile(np.arange(codes.size), 2)
    own = np.tile(text, 2)
    ask = np.flatnonzero((q > 0) & (i > first[own]))
    ask = ask[codes[i[ask] - 1] == codes[i[ask] + q[ask] - 1]]
    i, q, own = i[ask], q[ask], own[ask]
    up = powers(codes.size + 1)[0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    back = _extend(codes, sums, i, i + q, i - first[own], -1)
    ahead = _extend(codes, sums, i, i + q, first[own + 1] - i - q, 1)
    long = back + ahead >= np.maximum(least - q, q)
    rows = np.unique(np.stack([own, i - back - first[own], q, back + ahead + q], axis=1)[long], axis=0)
    wrong = set()
    for t, start, period, length in rows.tolist():
        a = start + int(first[t])
        if not (codes[a : a + length - period] == codes[a + period : a + length]).all():
            wrong.add(t)
        found[t].append((start, length, period))
    for t in wrong:  # two stretches had one hash: this text's roots are extended word by word
        found[t] = _checked(codes, int(first[t]), int(first[t + 1]), i[own == t].tolist(), q[own == t].tolist(), least)
    return found


def _checked(codes: np.ndarray, low: int, high: int, places: list[int], periods: list[int], least: int) -> list[tuple[int, int, int]]:
    out = set()
    for i, q in zip(places, periods, strict=True):
        back, ahead = _slowly(codes, i, i + q, i - low, -1), _slowly(codes, i, i + q, high - i - q, 1)
        if back + ahead >= max(least - q, q):
            out.add((i - back - low, q, back + ahead + q))
    return [(s, n, q) for s, q, n in sorted(out)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run has after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, keep, strict=True) if k])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """row (a struct of the other columns, by whatever names), runs (start, length, period by start, then period) and collapsed (the text
    without what runs repeat, words joined by one space) of each row.

    Null and empty texts have no words, no runs and '' as collapsed; so have, but for their words, texts shorter than ``least``. Rows alike,
    and rows that share an id or have none, are texts of their own; an empty table gives no row. A very long text is worked on whole, in
    about 250 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("runs")
        for batch in batches:
            for a, b, texts in slices(batch.column(1), BYTES):
                words = [t.encode().split() if t else [] for t in texts]
                found = find_runs(words, least)
                kept = pa.array([collapse(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
                runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found], _RUN)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), runs, kept], names=["row", "runs", "collapsed"])

    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row")
    rows = docs.select(others, F.col("text").cast("string").alias("text"))
    kind = StructType([rows.schema["row"], *StructType.fromDDL(f"runs {RUN}"), StructField("collapsed", StringType())])
    return rows.mapInArrow(run, kind)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: the first, then the shortest period) and digests of ``periodic_runs``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("m.length") / -F.col("m.period")).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_period(docs: DataFrame) -> DataFrame:
    """Documents of which about one in ten gets a periodic end, as the id says: with h = crc32 of the id and h % 10 = 0 the words from a on
    repeat those from a to a + p - 1. Without an id, or without words, a text stays as it is."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (at(i) + 1).cast("int"))), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    made = F.transform(F.array(words), repeated)[0]  # the words are bound to a name, so they are split once
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(made, "text")).otherwise(F.col("text")))


#: The same from every repeated stretch of six words: pairs of its places by distance, neighbours joined, multiples of a period left out.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295::BIGINT) AS h
  FROM documents
), k AS (
  SELECT r, doc_id, w0, len(w0) AS n, coalesce(h % 10 = 0 AND len(w0) > 0, false) AS made, h // 10 AS g FROM d
), k2 AS (
  SELECT *, CASE WHEN made THEN g % n ELSE 0 END AS a FROM k
), k3 AS (
  SELECT *, CASE WHEN made THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM k2
), t AS (
  SELECT r, doc_id, n, CASE WHEN made THEN list_transform(range(0, n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS w FROM k3
), six AS (
  SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT r, w, unnest(range(0, n - 5)) AS i FROM t WHERE n >= 12)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.r = y.r AND x.s = y.s AND x.i < y.i
), isles AS (
  SELECT r, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM pairs) GROUP BY r, q, isle
), long AS (
  SELECT * FROM isles WHERE e - s >= greatest(12, 2 * q)
), runs AS (
  SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)
), told AS (
  SELECT r, count(*) AS n_runs, max(struct_pack(l := e - s, s := -s, q := -q)) AS m, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs
), word AS (
  SELECT r, unnest(w) AS x, unnest(range(0, n)) AS i FROM t
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS c FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-m.s AS BIGINT) AS start, CAST(m.l AS BIGINT) AS length, CAST(-m.q AS BIGINT) AS period, CAST(1000 * m.l // -m.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
