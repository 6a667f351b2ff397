"""CSV records whose cells may hold line feeds, read in many tasks a file.

Whether a line begins inside a quoted cell depends on all that is before it. A line without quotes changes nothing; any other line either ends
a record or leaves a cell open, for each of the two states it may begin in. A range of lines is then a map of two states onto two, with
the records that end in it for either; the maps of a file's ranges are combined by windows, so that each range knows the state it begins in and
its first record's number, and all ranges are cut into records at once. A record over a border arrives in parts and is joined by number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.sources.ranges import read_lines, told
from labelwright.tables import stored

#: Encodings in which a byte of a line feed, quote or separator may be part of another character.
WIDE = re.compile(r"(?i)utf.?(16|32)|ucs|gb18030|gbk|big5|shift|sjis|cp932")
PARTS = "_record long, _range long, _at long, data binary, whole boolean"


def _field(sep: str) -> str:
    s = re.escape(sep)
    return rf'(?:"(?:[^"]|"")*"(?:[^"{s}][^{s}]*)?|[^"{s}][^{s}]*|)'


def _ends(lines: pa.Array, sep: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends a record if it begins a record, and if it begins inside a quoted cell."""
    zero, one = np.ones(len(lines), bool), np.zeros(len(lines), bool)
    quoted = np.flatnonzero(pc.count_substring(lines, b'"').to_numpy())
    if quoted.size:
        some, s, f = lines.take(pa.array(quoted)), re.escape(sep), _field(sep)
        zero[quoted] = pc.match_substring_regex(some, rf"(?s)^{f}(?:{s}{f})*$").to_numpy(zero_copy_only=False)
        one[quoted] = pc.match_substring_regex(some, rf'(?s)^(?:[^"]|"")*"(?:[^"{s}][^{s}]*)?(?:{s}{f})*$').to_numpy(zero_copy_only=False)
    return zero, one


def _states(zero: np.ndarray, one: np.ndarray, first: int) -> np.ndarray:
    """The state before each line and after the last, 1 inside a quoted cell: that of the last line that forces one, turned by those since."""
    forced, flips = zero == one, ~zero & one
    turns = np.append(0, np.cumsum(flips))
    at = np.maximum.accumulate(np.where(forced, np.arange(zero.size), -1)) if zero.size else np.zeros(0, np.int64)
    base = np.where(at < 0, first, (~zero[at]).astype(int))
    since = turns[1:] - np.where(at < 0, 0, turns[at + 1])
    return np.append(first, (base + since) & 1)


def _empty(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, pa.array([b"", b"\r"], pa.binary())).to_numpy(zero_copy_only=False)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    cuts = np.append(np.flatnonzero(new), keys[0].size).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _maps(sep: str):
    """A row for each stretch of a range: what it makes of either state, and the records that begin in it then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, files, starts, at = batch.columns
            names, files = files.dictionary_encode().dictionary, files.dictionary_encode().indices.to_numpy()
            zero, one = _ends(lines, sep)
            empty, out = _empty(lines), []
            for a, b in _runs(files, starts.to_numpy()):
                row = [names[int(files[a])].as_py(), starts[a].as_py(), at[a].as_py()]
                for first in (0, 1):
                    state = _states(zero[a:b], one[a:b], first)
                    row += [int(state[-1]), int((~((state[:-1] == 0) & empty[a:b]) & (state[:-1] == 0)).sum())]
                out.append(row)
            columns = list(zip(*out, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_file", "_start", "_at", "s0", "n0", "s1", "n1"])

    return run


def _ranges(lines: DataFrame, sep: str) -> DataFrame:
    """_file, _start, _range, _state (0 or 1 at the range's begin), _first (records that begin in the file before it), _before (records of
    earlier files, without headers counted by the caller), as a stored table with a row a range."""
    parts = lines.select("value", "_file", "_start", "_place").mapInArrow(_maps(sep), "_file string, _start long, _at long, s0 int, n0 long, s1 int, n1 long")
    in_order = F.array_sort(F.collect_list(F.struct("_at", "s0", "n0", "s1", "n1")))
    # Stretches of one range are few (a batch each): folded in order.
    fold = lambda first: F.aggregate("p", F.struct(F.lit(first).alias("s"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.when(a["s"] == 0, x["s0"]).otherwise(x["s1"]).alias("s"), (a["n"] + F.when(a["s"] == 0, x["n0"]).otherwise(x["n1"])).alias("n")))
    whole = parts.groupBy("_file", "_start").agg(in_order.alias("p")).select("_file", "_start", fold(0).alias("z"), fold(1).alias("o"))
    whole = stored(whole.select("_file", "_start", F.col("z.s").alias("s0"), F.col("z.n").alias("n0"), F.col("o.s").alias("s1"), F.col("o.n").alias("n1")), "quote-maps")
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(((F.col("s0") == 1) & (F.col("s1") == 0)).cast("int")).over(earlier), F.lit(0))
    through = flips + ((F.col("s0") == 1) & (F.col("s1") == 0)).cast("int")
    turned = whole.withColumns({"_flips": flips, "_forced": F.when(F.col("s0") == F.col("s1"), F.struct(F.col("s0").alias("s"), through.alias("f")))})
    last = F.last("_forced", ignorenulls=True).over(earlier)
    stated = turned.withColumn("_last", last).withColumn("_state", F.when(F.col("_last").isNull(), F.col("_flips") % 2).otherwise((F.col("_last.s") + F.col("_flips") - F.col("_last.f")) % 2).cast("int"))
    own = F.when(F.col("_state") == 0, F.col("n0")).otherwise(F.col("n1"))
    counted = stated.withColumn("_own", own).withColumn("_first", F.coalesce(F.sum("_own").over(earlier), F.lit(0)))
    files = counted.groupBy("_file").agg(F.sum("_own").alias("all"))  # a row a file
    before = files.select("_file", (F.sum("all").over(Window.orderBy("_file")) - F.col("all")).alias("_before"), (F.row_number().over(Window.orderBy("_file")) - 1).alias("_files"))
    return stored(counted.join(before, "_file").select("_file", "_start", "_state", "_first", "_before", "_files").withColumn("_range", F.monotonically_increasing_id()), "csv-ranges")


def _cut(sep: str, header: bool):
    """Records, or the parts of those that may go on in another range or batch. Numbers are those of the file's rows in all files' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, record, at = -1, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, own = batch.column(0), batch.column(1).to_numpy()
            zero, one = _ends(lines, sep)
            empty, data, out = _empty(lines), lines.to_pylist(), []
            for a, b in _runs(own):
                if own[a] != last:
                    last, at = int(own[a]), 0
                    state, record, before, files = (batch.column(c)[a].as_py() for c in range(2, 6))
                    # ``record`` is the number of the record that is open, or the last one before.
                    record, base = record - 1, before - (files + 1 if header else 0)
                states = _states(zero[a:b], one[a:b], state)
                begins = (states[:-1] == 0) & ~empty[a:b]
                number = record + np.cumsum(begins)
                used = np.flatnonzero(begins | (states[:-1] == 1))
                # Lines of one record that are in this stretch travel as one.
                heads = used[np.append(True, np.diff(number[used]) != 0)] if used.size else used
                ends = np.append(heads[1:], b - a)
                for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
                    k = int(number[h])
                    mine = [x for x in range(h, e) if begins[x] or states[x] == 1]
                    text = b"\n".join([data[a + x] for x in mine])
                    if header and k == 0:
                        continue
                    out.append((base + k, last, at + h, text, bool(begins[h] and states[mine[-1] + 1] == 0)))
                state, record, at = int(states[-1]), int(number[-1]), at + b - a
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_record", "_range", "_at", "data", "whole"])

    return run


def cells(text: str, sep: str = ",") -> list[str]:
    """The cells of one record: ``""`` in a quoted cell is a quote, what follows its end up to the separator is part of it as it stands."""
    if '"' not in text:
        return text.split(sep)
    out, at = [], 0
    while True:
        if text[at : at + 1] == '"':
            value, at = [], at + 1
            while True:
                end = text.find('"', at)
                if end < 0:  # never closed: the file's last record
                    return [*out, "".join(value) + text[at:]]
                value.append(text[at:end])
                at = end + 1
                if text[at : at + 1] != '"':
                    break
                value.append('"')
                at += 1
            end = text.find(sep, at)
            out.append("".join(value) + (text[at:] if end < 0 else text[at:end]))
        else:
            end = text.find(sep, at)
            out.append(text[at:] if end < 0 else text[at:end])
        if end < 0:
            return out
        at = end + len(sep)


def read_records(spark: SparkSession, path: str, names: list[str], header: bool = True, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """row_id and the named columns as text, of CSV files read in byte ranges; row_id counts from 0 in file order without gaps.

    Records over several lines, doubled quotes and any split are read as one reader of the whole file would. Empty lines are no records; a
    record of another length fails the job; bytes that the encoding doesn't have become U+FFFD. The first record of each file is left out if ``header``.
    """
    if WIDE.search(encoding):
        raise ValueError(f"{encoding}: lines and quotes can't be found by byte; read such a file whole")
    lines = read_lines(spark, path)
    ranges = _ranges(lines, sep)
    about = told(lines, ranges).select("value", "_range", "_state", "_first", "_before", "_files")
    parts = about.mapInArrow(_cut(sep, header), PARTS)
    return _parsed(parts, ranges, names, sep, encoding)


def _parsed(parts: DataFrame, ranges: DataFrame, names: list[str], sep: str, encoding: str) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                row = cells((data[:-1] if data.endswith(b"\r") else data).decode(encoding, "replace"), sep)
                if len(row) != len(names):
                    raise ValueError(f"a record of {len(row)} cells, not {len(names)}: {data[:80]!r}")
                rows.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=["row_id", *names])

    place = ranges.select("_range", F.col("_start").alias("_s"))
    pieces = parts.filter("NOT whole").join(place, "_range").groupBy("_record").agg(F.array_sort(F.collect_list(F.struct("_s", "_at", "data"))).alias("p"))
    joined = pieces.select("_record", F.array_join(F.transform("p", lambda x: F.decode(x["data"], "ISO-8859-1")), "\n").alias("t")).select("_record", F.encode("t", "ISO-8859-1").alias("data"))
    whole = parts.filter("whole").select("_record", "data").unionByName(joined)
    return whole.mapInArrow(parse, "row_id long, " + ", ".join(f"`{n}` string" for n in names))
