"""Delete later copies of repeated line runs: suffix array by prefix doubling.

The corpus is one sequence of line ids, with the texts one after another and
nothing running from one text into the next. Prefix doubling sorts its suffixes:
ranks by the first line, then by 2, 4, 8 ... lines, each round from the pairs
(rank here, rank so many lines on), ranked anew over all distinct pairs in range
partitions with prefix-summed counts. Suffixes that are alone under their rank
share no more lines with any other and leave the array; doubling ends when none
is left. Suffixes with one rank at a depth are a longest-common-prefix interval:
runs of so many lines that occur together. The least position of the interval is
the first copy; the others are later copies.

The longest common prefix of a suffix with any earlier one lies between its
deepest interval as a later copy and twice that depth. A descent finds it: steps
of half the depth, a quarter ... one line are tried by the rank of so many lines
behind the prefix known so far, against all members of the interval. A prefix
grows where an earlier suffix has the same rank there. Where it does not, those
that have one rank there are alike for all shorter steps, so that the least of
them stands for all. Each later copy so has its exact length and the first copy
of so many lines; those that no other run of the text contains are the maximal
repeated runs (``repeated_runs``), and their lines go. Where ``min_lines`` is a
power of two, the intervals alone cover the same lines (a prefix of 5 lines is two
of 4, one line apart), and deletion does without the descent.

A run counts from ``min_lines`` lines, or, for a single line,
from ``long_line_words`` words. Lines without a word neither make nor break
equality: they are left out of the sequence, and stay. Lines are equal if their
128-bit ids are.

Rows hold ids, ranks and positions only; texts move once, at the end, and only
beside the spans to delete.

Defined results: the first copy is the one with the least (id, position), rows
with null ids last, then by text hash; equal ids with different texts are
different texts; repeated rows are equal texts of one id, of which neither is
the later one, so they lose the same lines; null texts stay null, empty texts
stay empty; a text of which every worded line goes becomes empty (``emptied``);
ties cannot arise; ids are whole numbers (others raise an error on the cast); an
empty table gives an empty table; other columns are kept by ``dedup_rows`` and
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subtide.llm import _text as X
from subtide.llm._tables import fits, forget, unused, written

MIN_LINES = 2
LONG_LINE_WORDS = 50
#: Rows and spans of a table that is broadcast at most; above, it is shuffled.
BROADCAST_SPANS = 250_000
LAST_ID = (1 << 63) - 1


def worded_lines(t: X.Texts) -> tuple[X.Words, np.ndarray]:
    """Lines with a word (without their line ends), and their words."""
    w = X.words_of(t)
    lines = X.runs_of(t.buf != 10, t.off)
    k = np.searchsorted(w.starts, lines.ends) - np.searchsorted(w.starts, lines.starts)
    has = k > 0
    starts, ends = lines.starts[has], lines.ends[has]
    return X.Words(starts, ends, np.searchsorted(starts, t.off)), k[has]


def line_table(docs: DataFrame) -> DataFrame:
    """(id, row, pos, line1, line2, words): one row for each worded line; both ``line`` columns are its 128-bit id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text"):
                lines, k = worded_lines(t)
                owner = lines.owner()
                ids, rows = (part.column(c).to_numpy()[owner] for c in ("id", "row"))
                pos = np.arange(len(owner)) - lines.first[owner]
                both = [X.span_hashes(t.buf, lines.starts, lines.ends, which).view(np.int64) for which in (0, 1)]
                yield pa.record_batch([pa.array(ids), pa.array(rows), pa.array(pos, pa.int32()), pa.array(both[0]), pa.array(both[1]), pa.array(k, pa.int32())], names=["id", "row", "pos", "line1", "line2", "words"])

    return docs.mapInArrow(cut, "id long, row long, pos int, line1 long, line2 long, words int")


def ranked(pairs: DataFrame) -> DataFrame:
    """(r1, r2, rank) of the distinct pairs that occur twice: rank in order of (r1, r2), from 1, without gaps."""
    spark = pairs.sparkSession
    several = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = written(several.repartitionByRange(parts, "r1", "r2").withColumn("part", F.spark_partition_id()), "lines-pairs")
    # one row a partition comes to the driver, and goes back as a table of prefix sums
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    sums = spark.createDataFrame(before, "part int, before long")
    number = F.row_number().over(Window.partitionBy("part").orderBy("r1", "r2"))
    return placed.withColumn("at", number).join(F.broadcast(sums), "part").select("r1", "r2", (F.col("at") + F.col("before")).alias("rank"))


def intervals(docs: DataFrame) -> list[tuple[int, DataFrame]]:
    """(depth, suffixes in intervals of that depth) for 1, 2, 4 ... lines, until no two suffixes agree.

    Suffixes are (id, row, pos, rank); at depth 1 with the ``words`` of the line.
    """
    lines = written(line_table(docs).distinct(), "lines")
    rank = written(ranked(lines.select(F.col("line1").alias("r1"), F.col("line2").alias("r2"))), "lines-rank")
    array = lines.join(rank.toDF("line1", "line2", "rank"), ["line1", "line2"]).select("id", "row", "pos", "rank", "words")
    array, depth, out = written(array, "lines-array"), 1, []
    forget(lines, rank)
    while not array.isEmpty():
        out.append((depth, array))
        # the rank so many lines on in the same text; without one, the suffix is alone
        on = array.select("id", "row", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("r2"))
        pairs = written(array.select("id", "row", "pos", F.col("rank").alias("r1")).join(on, ["id", "row", "pos"]), "lines-doubling")
        rank = written(ranked(pairs.select("r1", "r2")), "lines-rank")
        array, depth = written(pairs.join(rank, ["r1", "r2"]).select("id", "row", "pos", "rank"), "lines-array"), depth * 2
        forget(pairs, rank)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def longest_copies(levels: list[tuple[int, DataFrame]], least: int) -> DataFrame | None:
    """(id, row, pos, length, f) of each suffix that shares ``least`` lines or more with an earlier one.

    ``length`` is the most it shares with any earlier one, ``f`` the first suffix with so many lines of it.
    """
    at, node = F.struct("id", "row", "pos"), ["d", "cur", "path"]
    tagged = [array.select(F.lit(depth).alias("d"), "rank", "id", "row", "pos") for depth, array in levels if 2 * depth > least]
    if not tagged:
        return None
    # written, so that the join reads two plain shuffles, of which Spark splits skewed partitions
    first = written(_union(tagged).groupBy("d", "rank").agg(F.min(at).alias("f")), "lines-first")
    members, later = written(_union(tagged).join(first, ["d", "rank"]), "lines-level"), at > F.col("f")
    used = [first, members]
    deepest = members.where(later).groupBy("id", "row", "pos").agg(F.max("d").alias("deepest"))
    members = members.join(deepest, ["id", "row", "pos"], "left").withColumn("asks", F.coalesce(F.col("d") == F.col("deepest"), F.lit(False)))
    members = written(members.drop("deepest"), "lines-members")
    forget(*used)
    # intervals in which no suffix asks for its length are left
    asked = members.where("asks").select("d", "rank").distinct()
    state = members.join(asked, ["d", "rank"], "left_semi").select("d", F.col("d").alias("cur"), F.array("rank").alias("path"), "id", "row", "pos", "asks", "f")
    ranks = _union([array.select(F.lit(depth).alias("step"), "id", "row", F.col("pos").alias("behind"), F.col("rank").alias("r")) for depth, array in levels])
    used, found = [members], []
    for halving in range(1, levels[-1][0].bit_length()):
        step = F.shiftright("d", halving)
        found.append(state.where((step < 1) & F.col("asks")))
        tried = state.where(step >= 1).withColumns({"step": step, "behind": F.col("pos") + F.col("cur")})
        tried = written(tried.join(ranks, ["step", "id", "row", "behind"], "left").drop("behind"), "lines-tried")
        alike = tried.where("r IS NOT NULL").groupBy(*node, "r").agg(F.min(at).alias("g"), F.max(F.when(F.col("asks"), at)).alias("last"))
        alike = written(alike.select(*node, "r", "g", F.coalesce(F.col("last") > F.col("g"), F.lit(False)).alias("grows")), "lines-alike")
        met = written(tried.join(alike, [*node, "r"], "left").withColumn("longer", F.col("asks") & F.coalesce(at > F.col("g"), F.lit(False))), "lines-met")
        forget(tried, alike)
        used.append(met)
        on = met.where("grows").select("d", (F.col("cur") + F.col("step")).alias("cur"), F.array_append("path", F.col("r")).alias("path"), "id", "row", "pos", F.col("longer").alias("asks"), F.col("g").alias("f"))
        stands = F.col("r").isNull() | (at == F.col("g"))
        stay = met.where((F.col("asks") & ~F.col("longer")) | (~F.col("asks") & stands)).select(*state.columns)
        state = on.unionByName(stay.join(stay.where("asks").select(*node).distinct(), node, "left_semi").select(*state.columns))
    found.append(state.where("asks"))
    out = written(_union(found).where(F.col("cur") >= least).select("id", "row", "pos", F.col("cur").alias("length"), "f"), "lines-longest")
    forget(*used)
    return out


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_line_words: int = LONG_LINE_WORDS) -> DataFrame:
    """(id, row, a, b, first_id, first_row, first_a): worded lines a to b (b not included) repeat those from first_a on of the first copy.

    No longer run from a on repeats an earlier one, and no run of a text contains another.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    levels, at = intervals(docs), F.struct("id", "row", "pos")
    found = [x for x in [longest_copies(levels, min_lines) if levels else None] if x is not None]
    if levels and min_lines > 1:
        single = levels[0][1].where(F.col("words") >= long_line_words)
        first = written(single.groupBy("rank").agg(F.min(at).alias("f")), "lines-first")
        found.append(written(single.join(first, "rank").where(at > F.col("f")).select("id", "row", "pos", F.lit(1).alias("length"), "f"), "lines-longest"))
        forget(first)
    forget(*[array for _, array in levels])
    if not found:
        return docs.sparkSession.createDataFrame([], "id long, row long, a int, b int, first_id long, first_row long, first_a int")
    best = _union(found).groupBy("id", "row", "pos").agg(F.max(F.struct("length", "f")).alias("hit"))
    end = F.col("pos") + F.col("hit.length")
    before = Window.partitionBy("id", "row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = best.withColumn("end", end).withColumn("reach", F.max("end").over(before)).where("reach IS NULL OR end > reach")
    runs = written(runs.select("id", "row", F.col("pos").alias("a"), F.col("end").alias("b"), F.col("hit.f.id").alias("first_id"), F.col("hit.f.row").alias("first_row"), F.col("hit.f.pos").alias("first_a")), "lines-runs")
    forget(*found)
    return runs


def interval_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_line_words: int = LONG_LINE_WORDS) -> DataFrame:
    """(id, row, a, b, first_id, first_row, first_a): as ``repeated_runs``, by intervals of 1, 2, 4 ... lines alone.

    Bounds and first copies need not be those of maximal runs; the lines covered are the same.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    levels, found = intervals(docs), []
    at = F.struct("id", "row", "pos")
    for depth, array in levels:
        if depth > 1 and depth < min_lines:
            continue
        if depth < min_lines:
            array = array.where(F.col("words") >= long_line_words)
        # written, so that the join reads two plain shuffles, of which Spark splits skewed partitions
        first = written(array.groupBy("rank").agg(F.min(at).alias("f")), "lines-first")
        later = array.join(first, "rank").where(at != F.col("f"))
        found.append(written(later.select("id", "row", "pos", F.struct(F.lit(depth).alias("depth"), "f").alias("hit")), "lines-later"))
        forget(first)
    if not found:
        return docs.sparkSession.createDataFrame([], "id long, row long, a int, b int, first_id long, first_row long, first_a int")
    union = found[0]
    for x in found[1:]:
        union = union.unionByName(x)
    # each suffix in its deepest interval; neighbours with neighbouring first copies are one run
    deepest = union.groupBy("id", "row", "pos").agg(F.max("hit").alias("hit")).select("id", "row", "pos", "hit.depth", F.col("hit.f.id").alias("first_id"), F.col("hit.f.row").alias("first_row"), F.col("hit.f.pos").alias("first_pos"))
    same = Window.partitionBy("id", "row", "first_id", "first_row", F.col("first_pos") - F.col("pos")).orderBy("pos")
    reach = F.max(F.col("pos") + F.col("depth")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("pos") <= reach, 0).otherwise(1)
    runs = deepest.withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(same)).withColumn("ahead", F.col("first_pos") - F.col("pos"))
    runs = runs.groupBy("id", "row", "first_id", "first_row", "ahead", "nth").agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.col("depth")).alias("b"), F.min("first_pos").alias("first_a"))
    runs = written(runs.select("id", "row", "a", "b", "first_id", "first_row", "first_a"), "lines-runs")
    forget(*found, *[array for _, array in levels])
    return runs


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, long_line_words: int = LONG_LINE_WORDS) -> DataFrame:
    """(id, row, spans): spans (first worded line, end) of repeated runs to delete, apart and in order."""
    found = repeated_runs if min_lines & (min_lines - 1) or min_lines < 1 else interval_runs
    runs = found(docs, min_lines, long_line_words).select("id", "row", "a", "b").distinct()
    w = Window.partitionBy("id", "row").orderBy("a", "b")
    fresh = F.when(F.col("a") <= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    runs = runs.withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(w))
    spans = runs.groupBy("id", "row", "nth").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _without(text: str, spans: list[dict]) -> tuple[str, int, int]:
    """Text without its worded lines in the spans; lines and words deleted."""
    kept, n, gone, words = [], 0, 0, 0
    it = iter(spans)
    now = next(it, None)
    for line in text.split("\n"):
        k = len(line.encode().split())
        if k:
            while now is not None and now["b"] <= n:
                now = next(it, None)
            if now is not None and now["a"] <= n:
                gone, words, n = gone + 1, words + k, n + 1
                continue
            n += 1
        kept.append(line)
    return "\n".join(kept), gone, words


def _joined(docs: DataFrame, id_col: str, text_col: str, min_lines: int, long_line_words: int, rest: list[str]) -> tuple[DataFrame, list[str]]:
    names = [unused(docs, x) for x in ("line_id", "line_row", "line_spans")]
    rows = docs.select(*[docs[c] for c in rest], F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias(names[0]), F.xxhash64(docs[text_col].cast("string")).alias(names[1]))
    light = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    spans = written(later_copies(light, min_lines, long_line_words), "lines-spans")
    side = spans.toDF(*names)
    side = F.broadcast(side) if fits(spans, BROADCAST_SPANS, 1 + F.size("spans")) else side
    return rows.join(side, names[:2], "left"), names


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_line_words: int = LONG_LINE_WORDS) -> DataFrame:
    """(id, text, n_lines_removed, n_words_removed, emptied) of each row: the text without later copies."""
    both, names = _joined(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), "id", "text", min_lines, long_line_words, ["id", "text"])
    kind = f"id {both.schema['id'].dataType.simpleString()}, text string, n_lines_removed long, n_words_removed long, emptied boolean"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in X.slices(batch, "text"):
                out = [(x, 0, 0) if not s else _without(x, s) for x, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                empty = [n > 0 and not x.encode().split() for x, n, _ in out]
                yield pa.record_batch([part.column(0), pa.array([x for x, _, _ in out], pa.string()), pa.array([n for _, n, _ in out], pa.int64()), pa.array([k for _, _, k in out], pa.int64()), pa.array(empty, pa.bool_())], names=["id", "text", "n_lines_removed", "n_words_removed", "emptied"])

    return both.select("id", "text", names[2]).mapInArrow(strip, kind).withColumnsRenamed({"id": id_col, "text": text_col} if (id_col, text_col) != ("id", "text") else {})


def dedup_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_line_words: int = LONG_LINE_WORDS) -> DataFrame:
    """docs with later copies cut from the text; rows that lose their last worded line go."""
    columns = docs.columns
    both, names = _joined(docs, id_col, text_col, min_lines, long_line_words, columns)
    at = columns.index(text_col)
    both = both.select(*columns, names[2])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in X.slices(batch, text_col):
                out = [(x, 0, 0) if not s else _without(x, s) for x, s in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist(), strict=True)]
                keep = pa.array([n == 0 or bool(x.encode().split()) for x, n, _ in out], pa.bool_())
                cols = part.columns[: len(columns)]
                cols[at] = pa.array([x for x, _, _ in out], pa.string())
                yield pa.record_batch(cols, names=columns).filter(keep)

    return both.mapInArrow(strip, docs.schema)


LINES_SQL = r"""
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k FROM l0),
l AS (SELECT doc_id, line, k, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM l1 WHERE k > 0),
r AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM l),
one AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM r) WHERE nth > 1 AND k >= 50),
two AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) AS nth FROM r WHERE following IS NOT NULL) WHERE nth > 1),
gone AS (SELECT doc_id, pos FROM one UNION SELECT doc_id, pos FROM two UNION SELECT doc_id, pos + 1 FROM two),
m AS (SELECT l1.doc_id, l1.i, l1.line, l1.k, gone.pos IS NOT NULL AS gone
      FROM l1 LEFT JOIN l ON l1.doc_id = l.doc_id AND l1.i = l.i LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS body, count(*) FILTER (gone) AS n, coalesce(sum(k) FILTER (gone), 0) AS nk, coalesce(sum(k) FILTER (NOT gone), 0) AS left_k FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(body, '')) END AS kept_sha256, CAST(coalesce(n, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(nk, 0) AS BIGINT) AS n_words_removed,
       coalesce(n, 0) > 0 AND left_k = 0 AS emptied
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
