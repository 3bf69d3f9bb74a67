"""Periodic runs of words: branching tandems on an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word
extends keeping q. A document's suffix array is built by prefix doubling; the
ranks of each round stay, as they tell whether two stretches of 2^k words are
equal. Longest common prefixes come from these ranks. Each place of the LCP array
with depth p splits its interval in two; the suffixes of the smaller part look
up where the suffixes p words on and p words back stand (inverse suffix array):
one that stands in the other part makes a branching tandem, a square of period p
that the word after it breaks off. Its left rotations, counted by the same
ranks, give the whole run; runs with equal bounds are one, with the least
period. No tree is built, and no document meets another, so nothing is shuffled.

Many documents share one array: words are numbered by document, and a mark that
equals nothing ends each of them. Memory is about 4 bytes a word for each doubling
of the longest repeat, over slices of about 1 MB; a longer document is a slice of
its own. Words are compared by 64-bit hashes.

Defined results: a text that is null, empty or without words has no run and an
empty collapsed text; ids of any type, null ones too, and repeated rows stay rows
of their own; ties cannot arise (runs of a text differ in bounds); an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X

MIN_WORDS = 24
MIN_TIMES = 3
#: Suffixes looked up at a time.
BLOCK = 1 << 20


def doubled_ranks(s: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes of ``s`` by their first 1, 2, 4 ... values, until all differ.

    A rank is the place of the first suffix of its group, so it stays once the
    group has one. No repeat may reach the end of ``s``.
    """
    order = np.argsort(s, kind="stable")
    fresh = np.append(True, s[order[1:]] != s[order[:-1]]) if len(s) else np.zeros(0, bool)
    rank = np.empty(len(s), np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    levels, depth = [rank], 1
    open_ = order[~(fresh & np.append(fresh[1:], True))]
    while len(open_):
        head = rank[open_].astype(np.int64)
        key = head << 32 | rank[open_ + depth]
        by = np.argsort(key, kind="stable")
        open_, key, head = open_[by], key[by], head[by]
        at = np.arange(len(key))
        group = np.append(True, head[1:] != head[:-1])
        fresh = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[open_] = head + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        open_, depth = open_[~(fresh & np.append(fresh[1:], True))], depth * 2
    return levels


def ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        n += (levels[k][a + n] == levels[k][b + n]).astype(np.int64) << k
    return n


def behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values before a equal those before b, where a < b."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = a - n - (1 << k)
        n += ((at >= 0) & (levels[k][np.maximum(at, 0)] == levels[k][np.maximum(at, 0) + b - a])).astype(np.int64) << k
    return n


def halves(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(split, first, end) of each place with a common prefix: suffix ranks first to split - 1 and split to end - 1 agree so far, and those of one part with those of the other no further.

    Bounds are the nearest smaller places (to the right also the equal ones),
    found by binary descent over minima of 1, 2, 4 ... places.
    """
    k = np.flatnonzero(lcp > 0)
    # stretches with common prefixes bound how far a search goes
    edge = np.flatnonzero(np.append(lcp, 0) <= 0)
    widest = int(np.diff(edge).max(initial=1))
    low = [lcp]
    while 1 << len(low) <= widest:
        half = 1 << (len(low) - 1)
        low.append(np.append(np.minimum(low[-1][:-half], low[-1][half:]), np.full(half, -1, lcp.dtype)))
    v, first, end = lcp[k], k.copy(), k + 1
    for t in range(len(low) - 1, -1, -1):
        at = first - (1 << t)
        first = np.where((at >= 0) & (low[t][np.maximum(at, 0)] >= v), at, first)
        at = np.minimum(end, len(lcp) - 1)
        end = np.where((end < len(lcp)) & (low[t][at] > v), end + (1 << t), end)
    return k, first - 1, end


def squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each branching tandem: two equal halves, of which the second is followed by another value than the first."""
    isa = levels[-1]
    sa = np.empty(len(isa), np.int64)
    sa[isa] = np.arange(len(isa))
    lcp = np.zeros(len(isa), np.int32)
    same = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[same] = ahead(levels, sa[same - 1], sa[same])
    split, first, end = halves(lcp)
    left = split - first <= end - split
    begin, size = np.where(left, first, split), np.where(left, split - first, end - split)
    # where the other part stands
    lo, hi = np.where(left, split, first), np.where(left, end, split)
    starts, periods = [], []
    upto = np.append(0, np.cumsum(size))
    b = 0
    while b < len(size):
        a, b = b, max(b + 1, int(np.searchsorted(upto, upto[b] + BLOCK, "right")) - 1)
        n = size[a:b]
        which = np.repeat(np.arange(a, b), n)
        i = sa[begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        p = lcp[split[which]].astype(np.int64)
        for at, start in ((i + p, i), (i - p, i - p)):
            place = isa[np.maximum(at, 0)]
            hit = (at >= 0) & (place >= lo[which]) & (place < hi[which])
            starts.append(start[hit])
            periods.append(p[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(periods or [none])


def runs_of_words(w: X.Words, h: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word over all texts, length, period) of the runs of at least ``min_words`` words and ``min_times`` periods, by first word and length."""
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, none, none
    owner = w.owner()
    n_texts = len(w.first) - 1
    _, number = np.unique(X.mix(h ^ X.mix(owner.astype(np.uint64) + np.uint64(1))), return_inverse=True)
    # each text's words, then a mark of its own
    s = np.empty(len(h) + n_texts, np.int64)
    s[w.first[1:] + np.arange(n_texts)] = len(h) + np.arange(n_texts)
    s[np.arange(len(h)) + owner] = number
    levels = doubled_ranks(s)
    start, p = squares(levels)
    back = behind(levels, start, start + p)
    length = back + 2 * p
    long = (length >= min_words) & (length >= min_times * p)
    a, n, p = (start - back)[long], length[long], p[long]
    order = np.lexsort((p, n, a))
    a, n, p = a[order], n[order], p[order]
    least = np.append(True, (a[1:] != a[:-1]) | (n[1:] != n[:-1])) if len(a) else np.zeros(0, bool)
    a, n, p = a[least], n[least], p[least]
    return a - np.searchsorted(w.first[1:] + np.arange(n_texts), a), n, p


def kept_words(w: X.Words, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each word stays: it is in no run, or within the first period of all that hold it."""
    a, n, p = runs
    change = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(change, a + p, 1)
    np.add.at(change, a + n, -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_times: int = MIN_TIMES, keep_text: bool = True) -> DataFrame:
    """(id, n_words, runs, collapsed_sha256[, collapsed_text]) of every text; runs are (start, length, period) in words, by start."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string" + ", collapsed_text string" * keep_text
    names = ["id", "n_words", "runs", "collapsed_sha256"] + ["collapsed_text"] * keep_text

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text"):
                w = X.words_of(t)
                a, n, p = runs = runs_of_words(w, X.span_hashes(t.buf, w.starts, w.ends), min_words, min_times)
                body, off = X.joined_words(t.buf, w, kept_words(w, runs))
                kept = [body[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                owner = np.searchsorted(w.first, a, "right") - 1
                item = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (a - w.first[owner], n, p)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, w.first).astype(np.int32)), item)
                out = [part.column(0), pa.array(w.counts.astype(np.int64)), lists, pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                yield pa.record_batch(out + [pa.array([x.decode() for x in kept], pa.string())] * keep_text, names=names)

    return rows.mapInArrow(search, kind).withColumnRenamed("id", id_col)
