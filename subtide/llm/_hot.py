"""Word n-grams that are too common to deal rows by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X

#: At most so many n-grams are called common, so their broadcast is bounded.
MOST = 20_000
#: A slice of texts reports an n-gram that makes up this share of its n-grams.
SHARE = 1e-5


def common_grams(rows: DataFrame, grams: Callable[[pa.RecordBatch, X.Texts], np.ndarray], most: int = MOST, share: float = SHARE) -> np.ndarray:
    """Sorted hashes of the commonest n-grams of all texts.

    ``grams`` gives a slice's n-gram hashes. An n-gram with at least ``share`` of
    all has that share in some slice, so none is missed; counts are added over
    the slices that report it. Only the order in which n-grams are tried depends
    on the answer, never a result.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text", 2 * X.SLICE_BYTES):
                h, n = np.unique(grams(part, t), return_counts=True)
                keep = n >= max(3, share * n.sum())
                yield pa.record_batch([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["h", "n"])

    table = rows.select("text").mapInArrow(report, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return np.sort(np.asarray(table["h"], np.int64).view(np.uint64)) if table.num_rows else np.zeros(0, np.uint64)


def tried_last(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """An order key: the hash, with all common n-grams after all others."""
    key = h >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        key = key | ((common[at] == h).astype(np.uint64) << np.uint64(63))
    return key
