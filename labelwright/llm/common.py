"""What the training-data operators share: written cuts of a lineage, caches of a worker, text rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.tables import stored as cut

__all__ = ["WORD", "cut", "documents", "hold", "release", "slices", "word_count"]

#: Words are runs of anything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"


_HOLDER: list = [None, None]


def release() -> None:
    """Give memory that a worker no longer uses back to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def hold(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Say that a Python worker's memory now is ``owner``'s: the one before, if another, drops what it kept (``clear``).

    Workers live on from stage to stage, so each stage's caches would add up otherwise.
    """
    if _HOLDER[0] != owner:
        if _HOLDER[1]:
            _HOLDER[1]()
        _HOLDER[:] = [owner, clear]
        release()


def slices(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int, list[str | None]]]:
    """The texts of a batch in runs of about ``size`` bytes, with the first one's place and the end; a longer text is a run of its own.

    Only one run is in memory as Python texts.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield start, end, texts.slice(start, end - start).to_pylist()
        start = end
    release()


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
