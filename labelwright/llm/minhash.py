"""Near-duplicates by MinHash with tensored banding, candidates confirmed on full sets.

Two small collections of ``BUNDLES`` bundles of ``ROWS`` minhashes each give BUNDLES ** 2 tables: a table's key is one bundle of
the first joined with one of the second. So 2 * BUNDLES * ROWS minhashes serve where BUNDLES ** 2 * 2 * ROWS would be due, about the
square root. A pair of similarity s shares no table with probability at most 2 * (1 - s ** ROWS) ** BUNDLES: 2e-5 at 0.85, 4e-6 at 0.87.

Texts of equal sets are one class from the start, so copies cost nothing further. A bundle that only one class has can't
be in a shared key and goes before keys are formed. What buckets connect is a set; its members are first held against two hubs, the
member that shares most buckets and their own smallest. Where a set is then one component, nothing is left to find. Where it
isn't, the members outside the largest component are held against all members, tile by tile on full sets; a tile returns
links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import cut, hold, slices
from labelwright.llm.components import components
from labelwright.llm.words import Words, mix, runs_of

SHINGLE, BUNDLES, ROWS = 5, 12, 3
HASHES = 2 * BUNDLES * ROWS
#: Hub pairs agree in at least this many of the 72 minhashes; a pair of similarity 0.8 has fewer with probability 1e-6.
AGREE = 40
#: Shingles of one side of a tile: a sixteenth of the set's, between these bounds. A member's set is never cut.
TILE_LEAST, TILE_MOST = 1 << 13, 1 << 18
#: Shingles and members of one side that a tile counts at once.
COUNTED, AT_ONCE = 1 << 15, 256
#: Text that is made shingles of at once.
BYTES = 1 << 20
#: Ids up to which the set of candidates is broadcast to the scan (8 bytes each); beyond it the scan is shuffled.
BROADCAST_IDS = 500_000
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingles(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different 64-bit shingle hashes of each text, joined; and where each text's begin, with the end.

    Words are lower-cased in A-Z. A text of fewer than n words has one shingle, all its words; without words it has none.
    """
    w = Words(texts, lower=True)
    runs = runs_of(w.hashes, n)
    out = []
    for first, count in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if count >= n:
            own = np.sort(runs[first : first + count - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(runs_of(w.hashes[first : first + count], count) if count else runs[:0])
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return np.concatenate(out) if out else runs[:0], np.concatenate([[0], np.cumsum(sizes)])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("near-duplicates")
    for batch in batches:
        ids = batch.column(0)
        for a, b, texts in slices(batch.column(1), BYTES):
            hashes, at = shingles(texts)
            sizes = np.diff(at)
            some = np.flatnonzero(sizes)
            begins = at[:-1][some]
            prints = np.zeros((2, sizes.size), np.uint64)
            minima = np.zeros((sizes.size, HASHES), np.uint32)
            if some.size:
                for k, salt in enumerate(_SEEDS[-2:]):
                    prints[k, some] = np.add.reduceat(mix(hashes ^ salt), begins)
                for j in range(HASHES):
                    values = ((hashes ^ _SEEDS[2 * j]) * (_SEEDS[2 * j + 1] | np.uint64(1))) >> np.uint64(32)
                    minima[some, j] = np.minimum.reduceat(values, begins)
            sketches = pa.FixedSizeListArray.from_arrays(pa.array(minima.view(np.int32).ravel()), HASHES).cast(pa.list_(pa.int32()))
            columns = [ids.slice(a, b - a), pa.array(sizes), *(pa.array(p.view(np.int64)) for p in prints), sketches]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("near-duplicates")
    for batch in batches:
        ids = batch.column(0)
        for a, b, texts in slices(batch.column(1), BYTES):
            hashes, at = shingles(texts)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["id", "shingles"])


def _bundles(sketch: str = "sketch") -> Column:
    s = F.col(sketch)
    return F.array(*[F.xxhash64(F.lit(i), *[s[i * ROWS + r] for r in range(ROWS)]) for i in range(2 * BUNDLES)])


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, id) of every table's buckets that hold two classes or more."""
    bundles = classes.select("id", F.posexplode(_bundles()).alias("place", "bundle"))
    shared = bundles.groupBy("bundle").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("bundle")
    kept = bundles.join(shared, "bundle", "left_semi").groupBy("id").agg(
        F.collect_set(F.when(F.col("place") < BUNDLES, F.col("bundle"))).alias("one"), F.collect_set(F.when(F.col("place") >= BUNDLES, F.col("bundle"))).alias("two"))
    keys = kept.select("id", F.explode("one").alias("one"), "two").select("id", "one", F.explode("two").alias("two")).select(F.xxhash64("one", "two").alias("key"), "id")
    keys = cut(keys, "keys")
    full = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    return cut(keys.join(full, "key").select("key", "id", "lo"), "buckets")


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    one = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    two = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b")
    agree = sum((F.col("s_a")[j] == F.col("s_b")[j]).cast("int") for j in range(HASHES))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.filter(sizes & (agree >= AGREE)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * common >= percent * union on the full sets."""
    one, two = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _common(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Common elements of each set of one group with each of another; (sizes, elements) each, elements of a set different.

    The first group goes in runs of few members and elements, so the table of who has what stays small whatever the sets.
    """
    (n1, x1), (n2, x2) = one, two
    known, at1 = np.unique(x1, return_inverse=True)
    place = np.minimum(np.searchsorted(known, x2), max(known.size - 1, 0))
    hit = np.flatnonzero(known[place] == x2)
    owner, place = np.repeat(np.arange(n2.size), n2)[hit], place[hit]
    out = np.zeros((n1.size, n2.size), np.int32)
    ends = np.append(0, np.cumsum(n1))
    local = np.full(known.size, -1, np.int64)
    first = 0
    while first < n1.size:
        last = max(first + 1, min(first + AT_ONCE, int(np.searchsorted(ends, ends[first] + COUNTED, side="right")) - 1))
        own = np.unique(at1[ends[first] : ends[last]])
        local[own] = np.arange(own.size)
        has = np.zeros((own.size, last - first), np.uint8)
        has[local[at1[ends[first] : ends[last]]], np.repeat(np.arange(last - first), n1[first:last])] = 1
        met = np.flatnonzero(local[place] >= 0)
        rows, who = local[place[met]], owner[met]
        for at in range(0, rows.size, COUNTED):
            part = who[at : at + COUNTED]
            begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            out[first:last, part[begins]] += np.add.reduceat(has[rows[at : at + COUNTED]], begins, axis=0, dtype=np.int32).T
        local[own] = -1
        first = last
    return out


def _tile_links(percent: int):
    def links(ids: np.ndarray, roots: np.ndarray, side: np.ndarray, sizes: np.ndarray, elements: np.ndarray) -> list[tuple[int, int]]:
        """Links between different components of one tile, as few as join them."""
        ends = np.cumsum(sizes)
        low, high = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())

        def part(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return sizes[own], np.concatenate([elements[ends[i] - sizes[i] : ends[i]] for i in own.tolist()])

        common = _common(part(low), part(high))
        union = sizes[low][:, None] + sizes[high][None, :] - common
        x, y = np.nonzero((100 * common >= percent * union) & (roots[low][:, None] != roots[high][None, :]))
        top: dict[int, int] = {}

        def find(r: int) -> int:
            while top.get(r, r) != r:
                r = top[r]
            return r

        out = []
        for i, j in zip(low[x].tolist(), high[y].tolist(), strict=True):
            p, q = find(int(roots[i])), find(int(roots[j]))
            if p != q:
                top[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
        return out

    def run(table: pa.Table) -> pa.Table:
        hold("near-duplicates")
        table = table.sort_by("id")
        lists = table.column("shingles").combine_chunks()
        found = links(*(table.column(c).to_numpy() for c in ("id", "root", "side")), np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten().to_numpy()) if len(table) > 1 else []
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate("ab")})

    return run


def _between(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside each set of members (set, id, root, n_shingles).

    The members outside a set's largest component visit all others; those inside it don't visit each other. Tiles are cut by
    shingles and each is a group of its own, so a set of any size is many tasks of bounded memory.
    """
    counts = members.groupBy("set", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    of_set = counts.groupBy("set").agg(F.sum("n").alias("members"), F.sum("w").alias("all_w"), F.max(F.struct("n", "root", "w")).alias("main")).filter(F.col("members") > F.col("main.n"))
    tile = F.least(F.lit(float(TILE_MOST)), F.greatest(F.lit(float(TILE_LEAST)), F.col("all_w") / 16))
    of_set = cut(of_set.select("set", F.col("main.root").alias("main"), F.ceil((F.col("all_w") - F.col("main.w")) / tile).alias("outs"), F.ceil(F.col("main.w") / tile).alias("ins")), "open")
    inside = members.join(of_set, "set").withColumn("inner", F.col("root") == F.col("main"))
    own = F.when(F.col("inner"), F.col("outs") + F.pmod(F.xxhash64("id"), F.col("ins"))).otherwise(F.pmod(F.xxhash64("id"), F.col("outs")))
    visits = inside.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("inner"), F.col("outs")).otherwise(F.col("outs") + F.col("ins")) - 1)))
    visits = visits.select("set", "id", "root", "side", F.least("side", "other").alias("s"), F.greatest("side", "other").alias("t"))
    return visits.join(sets, "id").groupBy("set", "s", "t").applyInArrow(_tile_links(percent), "a long, b long")


def _connected(buckets: DataFrame) -> DataFrame:
    """id, set (smallest id that buckets connect it with), lo (its smallest bucket's hub), shared (its buckets).

    First by one link an id, to its smallest hub; what other buckets connect beyond that is few links between roots.
    """
    first = cut(buckets.groupBy("id").agg(F.min("lo").alias("lo"), F.count("*").alias("shared")), "hubs")
    roots = components(first.filter("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")))
    first = cut(first.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    one, two = first.select("id", F.col("root").alias("a")), first.select(F.col("id").alias("lo"), F.col("root").alias("b"))
    more = cut(buckets.select("id", "lo").join(one, "id").join(two, "lo").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
    near = first
    if not more.isEmpty():
        up = components(more).select(F.col("id").alias("root"), F.col("root").alias("up"))
        near = near.join(up, "root", "left").withColumn("root", F.coalesce("up", "root")).drop("up")
    return cut(near.select("id", F.col("root").alias("set"), "lo", "shared"), "near")


def linked(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, root) of every class that is linked with another."""
    buckets = _buckets(classes)
    near = _connected(buckets)
    few = near.count() <= BROADCAST_IDS
    ids = near.select(F.col("id").alias("doc_id"))
    sets = cut(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    hubs = near.groupBy("set").agg(F.max_by("id", F.struct("shared", -F.col("id"))).alias("hub"))
    hubs = cut(hubs, "hubs")
    pairs = near.join(hubs, "set").select("id", F.explode(F.array_distinct(F.array("hub", "lo"))).alias("hub")).filter("id <> hub")
    pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = cut(_confirmed(_alike(pairs, classes, percent), sets, percent), "links")
    roots = components(links)
    members = near.join(classes.select("id", "n_shingles"), "id").join(roots, "id", "left").select("set", "id", "n_shingles", F.coalesce("root", "id").alias("root"))
    more = cut(_between(members, sets, percent), "links")
    return roots if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached by links of percent / 100 or more) and kept.

    Null and empty texts have no shingles and no link. Rows that repeat a doc_id count as one document with each of their
    texts; a row without doc_id joins a component but can't name it, and isn't kept. Other columns are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = cut(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, f1 long, f2 long, sketch array<int>"), "sketches")
    content = ["n_shingles", "f1", "f2"]
    classes = sketches.filter("n_shingles > 0").groupBy(*content).agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch")).filter("id IS NOT NULL")
    classes = cut(classes, "classes")
    roots = linked(classes, texts, percent)
    named = classes.select(*content, "id").join(roots, "id", "left").select(*content, F.coalesce("root", "id").alias("root"))
    whole = sketches.drop("sketch").join(named, content, "left")
    component = F.coalesce("root", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


#: The same result by comparing all texts that share a shingle; links followed by recursion.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM d
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT DISTINCT a AS id, a AS root FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.root
), c AS (
  SELECT id, min(root) AS root FROM r GROUP BY id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(doc_id = coalesce(root, doc_id), false) AS kept
FROM s LEFT JOIN c ON c.id = s.doc_id
"""
