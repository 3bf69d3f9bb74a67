"""Exact top-k inner products by distributed histogram selection.

Vectors are made whole numbers, packed into blocks, and every block of
candidates meets every block of queries (a stated query set against all rows,
in blocks, by an equality join on the query block's number). Passes over those
meetings count scores: each query's score interval is cut into ``bins`` bins,
tasks add up their counts and keep only the bins that can hold the kth score,
the global histogram gives the bin of the kth score, and the next pass cuts that
bin, until bins are one score wide. A last pass keeps the scores at or above the
kth, and ties go to the smaller id.

Defined results: null vectors, null ids, empty vectors and those holding null or
non-finite components take no part, neither as query nor as candidate; the rows
of a query's own id are not its candidates; repeated candidates are ranked each;
a query repeated with the same id gives its ranking once for each distinct
vector; fewer than k candidates are all returned; vectors of unequal length are
scored with missing components as 0; scores are exact for components of any size,
and a pair whose score passes 63 bits raises an error that names it, as does a
component that overflows when scaled; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subtide.llm._tables import written

SCALE = 1024
BINS = 4_096
CANDIDATE_ROWS = 2_048
QUERY_ROWS = 256
#: Numbers that a task holds for its queries at most before it passes them on.
HELD = 1 << 22
#: Whole numbers up to here are exact in doubles, with some room for rounded lengths.
EXACT, WIDE = float(1 << 53) * (1 - 1e-9), float(1 << 62)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of usable vectors, as doubles: those beyond 2^53 are whole as they are."""
    v = F.transform(F.transform(F.col(vec_col), lambda x: x.cast("double") * scale), lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x))
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.col(id_col).isNotNull()
    return df.where(usable).where(~bad).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(ids: list[int], rows: list[list[float]], width: int) -> bytes:
    m = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return np.array([len(rows), width], np.int64).tobytes() + np.asarray(ids, np.int64).tobytes() + m.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(data, np.int64, 2)
    ids = np.frombuffer(data, np.int64, n, 16)
    return ids, np.frombuffer(data, np.float64, n * width, 16 + 8 * n).reshape(n, width)


def blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """(data): packed runs of at most ``size`` rows of (id, v)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.record_batch([pa.array([_matrix(part.column(0).to_pylist(), part.column(1).to_pylist(), width)], pa.binary())], names=["data"])

    return rows.mapInArrow(packed, "data binary")


def query_blocks(rows: DataFrame, n_blocks: int, width: int) -> DataFrame:
    """(q_block, q_data): the queries dealt by hash to blocks 0 to n_blocks - 1."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_matrix([x["id"] for x in r], [x["v"] for x in r], width) for r in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["q_block", "q_data"])

    dealt = rows.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).alias("q_block")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return dealt.mapInArrow(packed, "q_block long, q_data binary")


def products(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray | None = None, b_ids: np.ndarray | None = None) -> np.ndarray:
    """Exact a @ b.T of whole numbers in doubles, as int64.

    Where the product of two rows' lengths is under 2^53, so is each partial sum,
    and doubles are exact; under 2^62, 64-bit integers are; pairs beyond are
    multiplied as Python integers. Rows of one id are no pair, and may have any score.
    """
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        long = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        bound = np.outer(*long)
        exact = bound < EXACT
        if exact.all():
            return (a @ b.T).astype(np.int64)
        out = np.where(exact, a @ b.T, 0.0).astype(np.int64)
    if (wide := ~exact & (bound < WIDE)).any():
        a_int, b_int = (np.where((n < WIDE)[:, None], m, 0.0).astype(np.int64) for m, n in zip((a, b), long, strict=True))
        out = np.where(wide, a_int @ b_int.T, out)
    pairs = np.argwhere(~(exact | wide))
    rows = [{i: [int(x) for x in m[i]] for i in np.unique(pairs[:, side]).tolist()} for side, m in enumerate((a, b))]
    for i, j in pairs.tolist():
        if a_ids is not None and a_ids[i] == b_ids[j]:
            continue
        score = sum(x * y for x, y in zip(rows[0][i], rows[1][j], strict=True))
        if not LEAST <= score <= MOST:
            raise ValueError(f"the inner product of vectors {a_ids[i] if a_ids is not None else i} and {b_ids[j] if b_ids is not None else j} passes 63 bits: {score}")
        out[i, j] = score
    return out


def meetings(candidates: DataFrame, queries: DataFrame, n_blocks: int) -> DataFrame:
    """(q_block, q_data, c_data): each block of candidates beside each block of queries."""
    spread = candidates.select(F.col("data").alias("c_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("q_block"))
    return spread.join(queries, "q_block").select("q_block", "q_data", "c_data")


def _histograms(met: DataFrame, bounds: DataFrame, k: int, bins: int, most_held: int) -> DataFrame:
    """(q_block, q_row, bin, n) of scores within each query's bounds; counts that cannot matter are left out.

    Above a query's bounds stand ``above`` scores already; bins are numbered
    upward from ``lo`` in steps of ``width``, up to ``hi``.
    """
    with_bounds = met.join(bounds, "q_block")

    def counted(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        out = [], [], [], []
        for (block, i), n in held.items():
            up = np.flatnonzero(n)[::-1]
            # the kth score of all is no lower than the kth among those counted here
            keep = up[: int(np.searchsorted(np.cumsum(n[up]), k)) + 1]
            for x, y in zip(out, (np.full(len(keep), block), np.full(len(keep), i), keep, n[keep]), strict=True):
                x.extend(y.tolist())
        return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["q_block", "q_row", "bin", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) * bins > most_held:
                    yield counted(held)
                    held.clear()
                q_ids, q = _unpack(r["q_data"])
                c_ids, c = _unpack(r["c_data"])
                s = products(q, c, q_ids, c_ids)
                lo, width, hi = np.array(r["lo"]), np.array(r["width"]), np.array(r["hi"])
                for i in range(len(q)):
                    own = s[i][c_ids != q_ids[i]]
                    # unsigned, as bounds may be 2^64 apart
                    up = own[(own >= lo[i]) & (own <= hi[i])].view(np.uint64) - lo[i].astype(np.uint64)
                    n = np.bincount((up // width[i].astype(np.uint64)).astype(np.int64), minlength=bins)
                    key = (r["q_block"], i)
                    held[key] = held[key] + n if key in held else n
        yield counted(held)

    return with_bounds.mapInArrow(count, "q_block long, q_row int, bin long, n long").groupBy("q_block", "q_row", "bin").agg(F.sum("n").alias("n"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, bins: int = BINS, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS, most_held: int = HELD) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of each query row."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score long").withColumnRenamed("id", id_col)
    usable = whole_vectors(vectors, id_col, vec_col, scale)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = usable.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("norm")).first()
    if facts["width"] is None:
        return empty
    width, norm = facts["width"], facts["norm"]
    candidates = written(blocks(usable, candidate_rows, width), "topk-candidates")
    chosen = whole_vectors(vectors.where(is_query), id_col, vec_col, scale).distinct()
    n_blocks = -(-chosen.count() // query_rows)
    if not n_blocks:
        return empty
    queries = written(query_blocks(chosen, n_blocks, width), "topk-queries")

    # no score of query q is beyond |q| times the longest candidate
    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, q = _unpack(data)
                with np.errstate(over="ignore", invalid="ignore"):
                    reach = np.ceil(np.sqrt((q**2).sum(1)) * norm * (1 + 1e-9)) + 1
                lo = [max(LEAST, -int(x)) if np.isfinite(x) else LEAST for x in reach]
                hi = [min(MOST, -x) for x in lo]
                step = [(y - x) // bins + 1 for x, y in zip(lo, hi, strict=True)]
                yield pa.record_batch([pa.array([block], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in (lo, step, hi, [0] * len(q)))], names=["q_block", "lo", "width", "hi", "above"])

    kind = "q_block long, lo array<long>, width array<long>, hi array<long>, above array<long>"
    bounds = written(queries.mapInArrow(first_bounds, kind), "topk-bounds")
    met = meetings(candidates, queries, n_blocks)
    while True:
        widest = bounds.select(F.max(F.array_max("width"))).first()[0]
        counts = _histograms(met, bounds, k, bins, most_held)
        rows = bounds.select("q_block", F.posexplode(F.arrays_zip("lo", "width", "hi", "above")).alias("q_row", "b")).select("q_block", "q_row", "b.*")
        down = Window.partitionBy("q_block", "q_row").orderBy(F.desc("bin"))
        reached = rows.join(counts, ["q_block", "q_row"]).withColumn("so_far", F.col("above") + F.sum("n").over(down))
        # the bin of the kth score; with fewer than k candidates, the lowest that has any
        kth = reached.withColumn("is_last", F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy("bin")) == 1)
        kth = kth.where((F.col("so_far") >= k) & (F.col("so_far") - F.col("n") < k) | F.col("is_last") & (F.col("so_far") < k))
        kth = kth.select("q_block", "q_row", (F.col("lo").cast("decimal(20,0)") + F.col("bin") * F.col("width").cast("decimal(17,0)")).cast("long").alias("new_lo"), (F.col("so_far") - F.col("n")).alias("new_above"))
        done = rows.join(kth, ["q_block", "q_row"], "left")
        next_width = F.ceil(F.col("width") / bins).cast("long")
        step = F.struct("q_row", F.coalesce("new_lo", "lo").alias("lo"), next_width.alias("width"), F.least(F.col("new_lo").cast("decimal(20,0)") + F.col("width") - 1, "hi").cast("long").alias("hi"), F.coalesce("new_above", "above").alias("above"))
        packed = done.groupBy("q_block").agg(F.sort_array(F.collect_list(step)).alias("s"))
        bounds = written(packed.select("q_block", F.col("s.lo").alias("lo"), F.col("s.width").alias("width"), F.col("s.hi").alias("hi"), F.col("s.above").alias("above")), "topk-bounds")
        if widest == 1:
            break

    def gathered(held: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out = [], [], [], [], []
        for (block, i), (q_id, ids, score) in held.items():
            for x, y in zip(out, (np.full(len(ids), block), np.full(len(ids), i), np.full(len(ids), q_id), ids, score), strict=True):
                x.extend(y.tolist())
        return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["q_block", "q_row", "query_id", "id", "score"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) * k > most_held:
                    yield gathered(held)
                    held.clear()
                q_ids, q = _unpack(r["q_data"])
                c_ids, c = _unpack(r["c_data"])
                s = products(q, c, q_ids, c_ids)
                for i in range(len(q)):
                    at = np.flatnonzero((s[i] >= r["lo"][i]) & (c_ids != q_ids[i]))
                    ids, score = c_ids[at], s[i][at]
                    key = (r["q_block"], i)
                    if key in held:
                        ids, score = np.concatenate([held[key][1], ids]), np.concatenate([held[key][2], score])
                    order = np.lexsort((ids, ~score))[:k]  # ~ turns the order without leaving 64 bits
                    held[key] = int(q_ids[i]), ids[order], score[order]
        yield gathered(held)

    kept = met.join(bounds.select("q_block", "lo"), "q_block").mapInArrow(best, "q_block long, q_row long, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "id"))
    ranked = kept.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
