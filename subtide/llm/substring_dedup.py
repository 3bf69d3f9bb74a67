"""Remove 50-word passages that a document with a smaller id has, by super-k-mers.

A window is ``k`` consecutive words of one text. Its minimiser is the least of
its ``m``-word n-grams by hash, common n-grams last. Consecutive windows with one
minimiser form a super-k-mer: one packed string of their words, which goes to
the minimiser's bucket. Two equal windows have one minimiser, so they meet in
one bucket, where the windows of its strings are sorted and the smallest
document of each is found exactly.

What travels is kept small. Minimisers of a single document go no further, and
equal strings of a bucket travel once, for their first document (their digests
say which are equal); every later copy of a string is covered whole. Common
n-grams come last in the order, so a passage in very many documents does not
fill one bucket: windows that reach out of it go to the buckets of its
surroundings, and those within it are equal strings.

Defined results: null and empty texts have no words; a text of fewer than ``k``
words loses nothing; rows of one id are one document and lose nothing to each
other; rows with null ids stand after all ids and count as one document;
repeated rows get the same result each; windows are judged on the input; ids are
whole numbers (others raise an error on the cast); an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X
from subtide.llm._hot import common_grams, tried_last
from subtide.llm._tables import fits, written

K = 50
M = 8
#: Windows of one packed string at most.
RUN = 64
#: Windows of a bucket that are sorted at a time.
SORT_WINDOWS = 200_000
#: Rows of a table that is broadcast at most; above, it is shuffled.
BROADCAST_ROWS = 250_000
LAST_ID = (1 << 63) - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = len(x)
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = np.minimum(x[: n - width + 1], x[width - size : width - size + n - width + 1])
    return x


def super_kmers(t: X.Texts, k: int, m: int, common: np.ndarray) -> tuple[X.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: words, and each run's first word, windows and minimiser."""
    w = X.words_of(t)
    none = np.zeros(0, np.int64)
    if len(w.starts) < k:
        return w, none, none, none.astype(np.uint64)
    least = sliding_min(tried_last(X.gram_hashes(X.span_hashes(t.buf, w.starts, w.ends), m), common), k - m + 1)
    ok = X.full_windows(w, k)
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    first = w.first[:-1][w.first[:-1] < len(ok)]
    begin[first] |= ok[first]
    at = np.flatnonzero(begin)
    last = np.searchsorted(np.flatnonzero(~ok), at)
    stops = np.append(np.flatnonzero(~ok), len(ok))[last]
    size = np.minimum(np.append(at[1:], len(ok)), stops) - at
    # long runs, of texts that repeat themselves, are cut
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at, parts) + nth * RUN
    return w, start, np.minimum(np.repeat(size, parts) - nth * RUN, RUN), np.repeat(least[at], parts)


def bucket_runs(strings: list[bytes], ids: list[int], k: int) -> list[list[tuple[int, int]]]:
    """For each distinct string of a bucket, runs (offset, length) of windows that a smaller id has too."""
    words = [s.split(b" ") for s in strings]
    total = sum(len(w) - k + 1 for w in words)
    parts = -(-total // SORT_WINDOWS)
    found: list[list[int]] = [[] for _ in strings]
    for part in range(parts):
        windows = []
        for i, w in enumerate(words):
            for o in range(len(w) - k + 1):
                x = b" ".join(w[o : o + k])
                if parts == 1 or hash(x) % parts == part:
                    windows.append((x, ids[i], i, o))
        windows.sort()
        now, least = None, 0
        for x, id_, i, o in windows:
            if x != now:
                now, least = x, id_
            elif id_ > least:
                found[i].append(o)
    out = []
    for offsets in found:
        runs: list[tuple[int, int]] = []
        for o in sorted(offsets):
            if runs and runs[-1][0] + runs[-1][1] == o:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((o, 1))
        out.append(runs)
    return out


def covered_words(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(id, row, spans): spans (first word, end word) that go, of documents that lose any.

    ``docs`` has (id long without nulls, row long, text string), and (id, row) names a text.
    """
    common = common_grams(docs, lambda _, t: _all_grams(t, m))
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text"):
                w, start, size, least = super_kmers(t, k, m, shared.value)
                data = t.buf.tobytes()
                begin, end = w.starts[start].tolist(), w.ends[start + size + k - 2].tolist()
                digest = [hashlib.blake2b(b" ".join(data[a:b].split()), digest_size=16).digest() for a, b in zip(begin, end, strict=True)]
                owner = np.searchsorted(w.first, start, "right") - 1
                ids, rows = (part.column(c).to_numpy()[owner] for c in ("id", "row"))
                out = [ids, rows, (start - w.first[owner]).astype(np.int32), size.astype(np.int32), least.view(np.int64)]
                yield pa.record_batch([*(pa.array(x) for x in out), pa.array(digest, pa.binary())], names=["id", "row", "start", "size", "least", "digest"])

    runs = written(docs.mapInArrow(cut, "id long, row long, start int, size int, least long, digest binary"), "skm-runs")
    # written, so that the join reads two plain shuffles, of which Spark splits skewed partitions
    several = written(runs.groupBy("least").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("least"), "skm-several")
    runs = written(runs.join(several, "least"), "skm-shared")

    # one row for each distinct string of a bucket, with its first document
    strings = runs.groupBy("least", "digest").agg(F.min(F.struct("id", "row", "start", "size")).alias("rep"), F.max("id").alias("last_id"))
    strings = written(strings.select("least", "digest", "rep.*", "last_id").withColumnRenamed("id", "first_id"), "skm-strings")
    mixed = strings.groupBy("least").agg(F.count("*").alias("n"), F.min("first_id").alias("lo"), F.max("first_id").alias("hi")).where("n > 1 and lo < hi").select("least")
    wanted = strings.join(mixed, "least").groupBy(F.col("first_id").alias("id"), "row").agg(F.collect_list(F.struct("least", "digest", "start", "size")).alias("runs"))
    texts = docs.join(wanted, ["id", "row"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: tuple[list, list, list, list] = [], [], [], []
                for id_, text, mine in zip(*(batch.column(c).slice(at, 500).to_pylist() for c in ("id", "text", "runs")), strict=True):
                    words = text.encode().split()
                    for r in mine:
                        for x, y in zip(out, (r["least"], r["digest"], id_, b" ".join(words[r["start"] : r["start"] + r["size"] + k - 1])), strict=True):
                            x.append(y)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["least", "digest", "id", "packed"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, bytes]] = {}
        bucket = None

        def done() -> pa.RecordBatch:
            runs = bucket_runs([p for _, p in held.values()], [i for i, _ in held.values()], k)
            hit = [(d, [{"at": a, "n": n} for a, n in r]) for d, r in zip(held, runs, strict=True) if r]
            return pa.record_batch([pa.array([bucket] * len(hit), pa.int64()), pa.array([d for d, _ in hit], pa.binary()), pa.array([r for _, r in hit], kind)], names=["least", "digest", "inner"])

        kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            for least, digest, id_, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if least != bucket:
                    if len(held) > 1:
                        yield done()
                    bucket, held = least, {}
                held[digest] = (id_, packed)
        if len(held) > 1:
            yield done()

    packed = texts.mapInArrow(pack, "least long, digest binary, id long, packed binary")
    inner = packed.repartition("least").sortWithinPartitions("least").mapInArrow(sort, "least long, digest binary, inner array<struct<at: int, n: int>>")
    facts = strings.select("least", "digest", "first_id", "last_id").join(inner, ["least", "digest"], "left").where("last_id > first_id or inner is not null")
    hit = runs.join(written(facts, "skm-facts"), ["least", "digest"])
    span = lambda a, n: F.struct(a.cast("int").alias("a"), (a + n + (k - 1)).cast("int").alias("b"))
    spans = F.when(F.col("id") > F.col("first_id"), F.array(span(F.col("start"), F.col("size")))).otherwise(F.transform(F.coalesce("inner", F.expr("cast(array() as array<struct<at: int, n: int>>)")), lambda r: span(F.col("start") + r["at"], r["n"])))
    hit = hit.select("id", "row", F.explode(spans).alias("s"))
    return hit.groupBy("id", "row").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def _all_grams(t: X.Texts, m: int) -> np.ndarray:
    w = X.words_of(t)
    h = X.gram_hashes(X.span_hashes(t.buf, w.starts, w.ends), m)
    return h[X.full_windows(w, m)]


def remove_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M, keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every text."""
    rows = docs.select(docs[id_col].cast("long").alias("raw_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("raw_id", F.coalesce("raw_id", F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")
    spans = written(covered_words(rows.select("id", "row", "text").where(F.length("text") >= 2 * k - 1), k, m), "skm-spans")
    side = F.broadcast(spans) if fits(spans, BROADCAST_ROWS) else spans
    joined = rows.join(side, ["id", "row"], "left").select("raw_id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: tuple[list, list, list, list] = [], [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.encode().split()
                    kept, end = [], 0
                    for s in spans or ():
                        kept += words[end : s["a"]]
                        end = max(end, s["b"])
                    kept += words[end:]
                    body = b" ".join(kept)
                    for x, y in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode() if keep_text else None), strict=True):
                        x.append(y)
                cols = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                yield pa.record_batch(cols + [pa.array(out[3], pa.string())] * keep_text, names=["raw_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    return joined.mapInArrow(strip, "raw_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text).withColumnRenamed("raw_id", id_col)


PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_id FROM g),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM f WHERE first_id < doc_id) x, (SELECT unnest(range(50)) AS j) y),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT p.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p.i) AS body FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i WHERE c.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
