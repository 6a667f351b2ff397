"""Documents packed into few sequences by a grouping genetic algorithm on islands.

A packing is a list of bins, each a list of documents. Crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold a document twice, and puts the displaced documents back by best fit; mutation empties slack bins. Pieces are dealt by a
hash to groups of a bounded size, and several islands evolve a population for each group; between epochs each island's best packing
migrates to the next island. A group whose best has as few bins as its tokens need at least is done.

What one group can't fill others can: the slackest bins of all groups are emptied and their pieces packed again in new groups, level after
level, until one group is left. Only lengths take part; ids stay in the stored pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import cut, slices
from labelwright.llm.tokenize import encoder

#: Pieces of a group, about; islands of a group, packings of an island; epochs, between which the best migrate, and generations of one.
GROUP, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4_000, 2, 4, 2, 6
#: The share of a group's bins, the slackest ones, that is packed again on the next level.
AGAIN = 8
BYTES = 1 << 22
PIECES = "row long, doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"
PACKINGS = "group long, island int, least long, bins long, fitness double, rows binary, lengths binary, assigned binary"
PLACES = "row long, sequence_id long, offset long, length long, again boolean"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 4096) -> DataFrame:
    """The ids of whole texts, cut after every ``longest`` ids, as a stored table with a number ``row`` for each piece.

    ``ids`` are little-endian unsigned 16-bit numbers (vocabularies are below 65,536 ids), ids_crc32 is of the same as 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(tokenizer), TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in slices(batch.column(1), BYTES):
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for doc_id, ids in zip(doc_ids[a:b], coder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint16(end_id))
                    for k, at in enumerate(range(0, ids.size, longest)):
                        own = ids[at : at + longest]
                        for column, value in zip(out, (row, doc_id, k, at, own.size, own.astype("<u2").tobytes(), zlib.crc32(own.astype("<u4"))), strict=True):
                            column.append(value)
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES), "pieces", compression="zstd", **{"parquet.block.size": str(16 << 20)})


class _Rooms:
    """Bins by the room they have left; the tightest that takes a length is found in a bit set."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.capacity = 0, capacity

    def add(self, b: int, room: int) -> None:
        if room:
            self.by_room[room].append(b)
            self.bits |= 1 << room

    def take(self, length: int) -> tuple[int, int]:
        """(bin, its room), taken out; (-1, capacity) if none has the room."""
        bits = self.bits >> length
        if not bits:
            return -1, self.capacity
        room = length + (bits & -bits).bit_length() - 1
        own = self.by_room[room]
        b = own.pop()
        if not own:
            self.bits ^= 1 << room
        return b, room


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """The bins with the items put, in this order, where the least room is left over; new bins where none has room."""
    bins = [] if bins is None else bins
    rooms = _Rooms(capacity)
    for b, own in enumerate(bins):
        rooms.add(b, capacity - sum([lengths[i] for i in own]))
    for i in items:
        b, room = rooms.take(lengths[i])
        if b < 0:
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        rooms.add(b, room - lengths[i])
    return bins


def _fills(bins: list[list[int]], lengths: list[int]) -> list[int]:
    return [sum([lengths[i] for i in own]) for own in bins]


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Mean squared fill: of packings with as many bins, the one with fuller and emptier ones is better."""
    return sum([(f / capacity) ** 2 for f in _fills(bins, lengths)]) / max(1, len(bins))


def crossover(one: list[list[int]], two: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """``one`` with some of the fullest bins of ``two``: its bins that share a document with those go, what they alone held is put back."""
    fills = _fills(two, lengths)
    order = sorted(range(len(two)), key=fills.__getitem__, reverse=True)
    chosen = [order[int(k)] for k in np.unique((rng.random(max(1, len(two) // 4)) ** 2 * len(two)).astype(np.int64))]
    inside = {i for b in chosen for i in two[b]}
    kept = [own for own in one if inside.isdisjoint(own)]
    displaced = [i for own in one if not inside.isdisjoint(own) for i in own if i not in inside]
    displaced.sort(key=lengths.__getitem__, reverse=True)
    return best_fit(displaced, lengths, capacity, [list(x) for x in kept] + [list(two[b]) for b in chosen])


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The slackest bins, and a few others, emptied and their documents put back, longest first."""
    fills = _fills(bins, lengths)
    n = max(2, len(bins) // 20)
    gone = set(sorted(range(len(bins)), key=fills.__getitem__)[:n]) | set(rng.integers(0, len(bins), n).tolist())
    loose = sorted((i for b in gone for i in bins[b]), key=lengths.__getitem__, reverse=True)
    return best_fit(loose, lengths, capacity, [list(own) for b, own in enumerate(bins) if b not in gone])


def evolve(population: list[list[list[int]]], lengths: list[int], capacity: int, generations: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """The population after some generations, best first; it ends early at a packing that can't have fewer bins."""
    least = -(-sum(lengths) // capacity)
    score = lambda bins: (len(bins), -fitness(bins, lengths, capacity))
    ranked = sorted(((score(x), k, x) for k, x in enumerate(population)), key=lambda x: x[:2])
    for t in range(generations):
        if ranked[0][0][0] <= least:
            break
        one, two = ranked[0][2], ranked[int(rng.integers(len(ranked)))][2]
        child = mutate(crossover(*((one, two) if t % 2 else (two, one)), lengths, capacity, rng), lengths, capacity, rng)
        ranked = sorted([*ranked, (score(child), len(population) + t, child)], key=lambda x: x[:2])[: len(population)]
    return [x for _, _, x in ranked]


def founders(lengths: list[int], capacity: int, island: int, n: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """First packings: best fit, longest first on the first island, and by lengths blurred more and more. One that can't have fewer bins is the last."""
    size, made = np.array(lengths), []
    for k in range(n):
        order = np.argsort(-size * (1 + 0.1 * (k + island) * rng.standard_normal(size.size)), kind="stable")
        made.append(best_fit(order.tolist(), lengths, capacity))
        if len(made[-1]) <= -(-sum(lengths) // capacity):
            break
    return made


def _assigned(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<u4")
    for b, own in enumerate(bins):
        out[own] = b
    return out.tobytes()


def _bins(assigned: bytes) -> list[list[int]]:
    of = np.frombuffer(assigned, "<u4")
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


def _packings(group: int, island: int, rows: bytes, lengths: np.ndarray, population: list[list[list[int]]], capacity: int) -> pa.Table:
    n, own = len(population), lengths.tolist()
    columns = [[group] * n, [island] * n, [-(-sum(own) // capacity)] * n, [len(x) for x in population], [fitness(x, own, capacity) for x in population], [rows] * n, [lengths.astype("<u4").tobytes()] * n, [_assigned(x, lengths.size) for x in population]]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PACKINGS.split(", ")])


def _founded(capacity: int, population: int, generations: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, island = (k.as_py() for k in key)
        table = table.sort_by("row")
        lengths = table.column("length").to_numpy().astype(np.int64)
        rng = np.random.default_rng([group, island])
        first = founders(lengths.tolist(), capacity, island, population, rng)
        return _packings(group, island, table.column("row").to_numpy().astype("<i8").tobytes(), lengths, evolve(first, lengths.tolist(), capacity, generations, rng), capacity)

    return run


def _migrated(capacity: int, population: int, generations: int, epoch: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, island = (k.as_py() for k in key)
        lengths = np.frombuffer(table.column("lengths")[0].as_py(), "<u4").astype(np.int64)
        table = table.sort_by([("bins", "ascending"), ("fitness", "descending")])
        own = [_bins(x) for x in dict.fromkeys(table.column("assigned").to_pylist())]
        rng = np.random.default_rng([group, island, epoch])
        return _packings(group, island, table.column("rows")[0].as_py(), lengths, evolve(own, lengths.tolist(), capacity, generations, rng)[:population], capacity)

    return run


def _placed(level: int, capacity: int, last: bool):
    """Places of the best packing's pieces; on all levels but the last the slackest bins' pieces go ``again``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group = batch.column("group")[i].as_py()
                rows, lengths = np.frombuffer(batch.column("rows")[i].as_py(), "<i8"), np.frombuffer(batch.column("lengths")[i].as_py(), "<u4").astype(np.int64)
                of = np.frombuffer(batch.column("assigned")[i].as_py(), "<u4").astype(np.int64)
                fill = np.bincount(of, lengths)
                slack = np.zeros(fill.size, bool)
                if not last:
                    slack[np.argsort(fill, kind="stable")[: -(-fill.size // AGAIN)]] = True
                    slack &= fill < capacity
                order = np.argsort(of, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                head = np.append(True, np.diff(of[order]) != 0)
                offset = before - before[np.maximum.accumulate(np.where(head, np.arange(of.size), 0))]
                columns = rows[order], (level << 56) + (group << 24) + of[order], offset, lengths[order], slack[of[order]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in PLACES.split(", ")])

    return run


def _level(items: DataFrame, level: int, groups: int, capacity: int, islands: int, population: int, epochs: int, generations: int) -> DataFrame:
    """(row, sequence_id, offset, length, again) of (row, length): one level of groups, evolved."""
    dealt = items.select(F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "row", "length")
    packings = cut(dealt.groupBy("group", "island").applyInArrow(_founded(capacity, population, generations), PACKINGS), "packings")
    for epoch in range(1, epochs):
        # Groups with a packing that can't have fewer bins are done; the others' best migrate.
        goes_on = packings.groupBy("group").agg(F.min("bins").alias("b"), F.max("least").alias("l")).filter("b > l").select("group")
        still, done = (packings.join(goes_on, "group", how) for how in ("left_semi", "left_anti"))
        elite = still.groupBy("group", "island").agg(F.max_by(F.struct(*packings.columns), F.struct(-F.col("bins"), "fitness")).alias("e")).select("e.*")
        guests = elite.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        moved = still.unionByName(guests).groupBy("group", "island").applyInArrow(_migrated(capacity, population, generations, epoch), PACKINGS)
        packings = cut(done.unionByName(moved), "packings")
    best = packings.groupBy("group").agg(F.max_by(F.struct("rows", "lengths", "assigned"), F.struct(-F.col("bins"), "fitness", -F.col("island"))).alias("e")).select("group", "e.*")
    return cut(best.mapInArrow(_placed(level, capacity, groups == 1), PLACES), "places")


def place(items: DataFrame, capacity: int = 4096, group: int = GROUP, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """row, sequence_id, offset of (row, length), with as few sequences of ``capacity`` as the algorithm finds.

    A row of full length is a sequence by itself. No row gives no sequence; rows of one length are told apart by their number only.
    """
    alone = items.filter(F.col("length") >= capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, level, done = items.filter(F.col("length") < capacity).select("row", "length"), 1, alone
    while n := left.count():
        groups = -(-n // group)
        made = _level(left, level, groups, capacity, islands, population, epochs, generations)
        done = done.unionByName(made.filter("NOT again").select("row", "sequence_id", "offset"))
        left, level = made.filter("again").select("row", "length"), level + 1
    return done


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 4096, **options: int) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is the end id alone. A document of more than ``longest`` ids is cut after every ``longest``; others stay whole. Rows
    that share an id or have none are documents of their own. Other columns are left out, whatever their names; an empty table gives no
    piece. ``ids`` (little-endian unsigned 16-bit) come from the table that the texts were encoded into, once.
    """
    made = pieces(docs, tokenizer, end_id, longest)
    return made.join(place(made.select("row", "length"), longest, **options), "row").drop("row")
