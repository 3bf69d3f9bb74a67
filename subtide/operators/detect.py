"""Find runs of mistimed lines: ordered set algebra as windows over ``lines``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subtide.functions.columns import by_line, seconds_text
from subtide.schema import Params

BEFORE = (Window.unboundedPreceding, -1)


def duration() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def short_lines(lines: DataFrame, threshold_sec: float) -> DataFrame:
    """Add ``is_short``: lasts no longer than the threshold."""
    return lines.withColumn("is_short", duration() / F.lit(1000.0) <= threshold_sec)


def fill_single_gaps(flagged: DataFrame, flag: str = "is_short") -> DataFrame:
    """Flag a line between two flagged lines too."""
    w = by_line()
    near = F.coalesce(F.lag(flag).over(w), F.lit(False)) & F.coalesce(F.lead(flag).over(w), F.lit(False))
    return flagged.withColumn(flag, F.col(flag) | near)


def runs(flagged: DataFrame, min_lines: int, flag: str = "is_short") -> DataFrame:
    """groups: maximal runs of flagged lines of at least ``min_lines``."""
    w = by_line()
    island = flagged.where(flag).select("media_id", "line_ix", (F.col("line_ix") - F.row_number().over(w)).alias("island"))
    out = island.groupBy("media_id", "island").agg(F.min("line_ix").alias("start_ix"), F.max("line_ix").alias("end_ix"), F.count("*").alias("n_lines"))
    return _numbered(out.where(F.col("n_lines") >= min_lines))


def _numbered(groups: DataFrame) -> DataFrame:
    at = Window.partitionBy("media_id").orderBy("start_ix", "end_ix")
    return groups.select("media_id", (F.row_number().over(at) - 1).cast("long").alias("group_ix"), "start_ix", "end_ix", (F.col("end_ix") - F.col("start_ix") + 1).alias("n_lines"))


def expand_runs(groups: DataFrame, lines: DataFrame, back: int, fore: int, min_delay_sec: float) -> DataFrame:
    """Extend runs to the nearest line longer than ``min_delay_sec``, if it is near enough.

    Without such a line before (after), a run near enough to the start (end) of
    the media extends to it.
    """
    slow = F.when(duration() > min_delay_sec * 1000, F.col("line_ix"))
    backward = by_line().rowsBetween(*BEFORE)
    # the next such line is the last one seen in reverse order, which keeps the frame a running one
    forward = Window.partitionBy("media_id").orderBy(F.desc("line_ix")).rowsBetween(*BEFORE)
    facts = lines.select(
        "media_id",
        "line_ix",
        F.last(slow, ignorenulls=True).over(backward).alias("prev_slow"),
        F.last(slow, ignorenulls=True).over(forward).alias("next_slow"),
        F.count("*").over(Window.partitionBy("media_id")).alias("n_all"),
    )
    at_start = facts.select("media_id", F.col("line_ix").alias("start_ix"), "prev_slow")
    at_end = facts.select("media_id", F.col("line_ix").alias("end_ix"), "next_slow", "n_all")
    g = groups.join(at_start, ["media_id", "start_ix"]).join(at_end, ["media_id", "end_ix"])
    start = F.when(F.col("start_ix") - F.col("prev_slow") <= back, F.col("prev_slow")).when(F.col("prev_slow").isNull() & (F.col("start_ix") < back), F.lit(0).cast("long")).otherwise(F.col("start_ix"))
    last = F.col("n_all") - 1
    end = F.when(F.col("next_slow") - F.col("end_ix") <= fore, F.col("next_slow")).when(F.col("next_slow").isNull() & (last - F.col("end_ix") < fore), last).otherwise(F.col("end_ix"))
    out = g.select("media_id", "group_ix", start.alias("start_ix"), end.alias("end_ix"))
    return out.withColumn("n_lines", F.col("end_ix") - F.col("start_ix") + 1)


def merge_runs(groups: DataFrame, max_gap: int) -> DataFrame:
    """Join runs with at most ``max_gap`` lines between them."""
    w = Window.partitionBy("media_id").orderBy("start_ix", "end_ix", "group_ix")
    reach = F.max("end_ix").over(w.rowsBetween(*BEFORE))
    g = groups.withColumn("fresh", F.when(reach.isNull() | (F.col("start_ix") - reach > max_gap + 1), 1).otherwise(0))
    g = g.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _numbered(g.groupBy("media_id", "island").agg(F.min("start_ix").alias("start_ix"), F.max("end_ix").alias("end_ix")))


def mark_groups(lines: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the line is in one of the groups (which do not overlap)."""
    starts = groups.select("media_id", F.col("start_ix").alias("line_ix"), F.lit(1).alias("opens"))
    ends = groups.select("media_id", F.col("end_ix").alias("line_ix"), F.lit(1).alias("closes"))
    w = by_line()
    both = lines.join(starts, ["media_id", "line_ix"], "left").join(ends, ["media_id", "line_ix"], "left")
    opened = F.sum(F.coalesce("opens", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.coalesce(F.sum(F.coalesce("closes", F.lit(0))).over(w.rowsBetween(*BEFORE)), F.lit(0))
    return both.withColumn(name, opened > closed).drop("opens", "closes")


def run_bounds(flagged: DataFrame, flag: str) -> DataFrame:
    """Add ``run_first`` and ``run_last``, the bounds of the flagged run that a line is in (null elsewhere), and ``last_ix``, the media's last line."""
    asc, desc = by_line(), Window.partitionBy("media_id").orderBy(F.desc("line_ix"))
    so_far = (Window.unboundedPreceding, 0)
    opens = F.col(flag) & ~F.coalesce(F.lag(flag).over(asc), F.lit(False))
    closes = F.col(flag) & ~F.coalesce(F.lead(flag).over(asc), F.lit(False))
    x = flagged.withColumns({"opens": opens, "closes": closes})
    x = x.withColumn("run_first", F.when(F.col(flag), F.last(F.when(F.col("opens"), F.col("line_ix")), ignorenulls=True).over(asc.rowsBetween(*so_far))))
    x = x.withColumn("run_last", F.when(F.col(flag), F.last(F.when(F.col("closes"), F.col("line_ix")), ignorenulls=True).over(desc.rowsBetween(*so_far))))
    return x.withColumn("last_ix", F.first("line_ix").over(desc.rowsBetween(*so_far))).drop("opens", "closes")


def find_mistimed(lines: DataFrame, params: Params, threshold_sec: float | None = None) -> DataFrame:
    """Add ``is_mistimed``: short lines, single gaps between them, and long runs expanded and merged.

    Runs stay columns of their lines, and meet their neighbours through windows
    forward and backward over the media, so all of it shares one exchange. It gives
    what ``runs``, ``expand_runs``, ``merge_runs`` and ``mark_groups`` give in turn.
    """
    threshold = params.mistimed_line_thresh_sec if threshold_sec is None else threshold_sec
    asc, desc = by_line(), Window.partitionBy("media_id").orderBy(F.desc("line_ix"))
    before, so_far = BEFORE, (Window.unboundedPreceding, 0)
    x = run_bounds(fill_single_gaps(short_lines(lines, threshold)), "is_short")
    slow = F.when(duration() > params.seg_min_delay_sec * 1000, F.col("line_ix"))
    long_run = F.col("is_short") & (F.col("run_last") - F.col("run_first") + 1 >= params.seg_min_lines)
    x = x.withColumns({"head": long_run & (F.col("line_ix") == F.col("run_first")), "tail": long_run & (F.col("line_ix") == F.col("run_last"))})
    x = x.withColumn("prev_slow", F.last(slow, ignorenulls=True).over(asc.rowsBetween(*before)))
    # the next slow line after a run is known at its last line, and is handed to its first
    x = x.withColumn("next_slow", F.last(slow, ignorenulls=True).over(desc.rowsBetween(*before)))
    x = x.withColumn("after", F.last(F.when(F.col("tail"), F.struct("next_slow")), ignorenulls=True).over(desc.rowsBetween(*so_far))["next_slow"])
    back, fore = params.seg_backtrace_limit, params.seg_foretrace_limit
    first, last = F.col("run_first"), F.col("run_last")
    start = F.when(first - F.col("prev_slow") <= back, F.col("prev_slow")).when(F.col("prev_slow").isNull() & (first < back), F.lit(0).cast("long")).otherwise(first)
    end = F.when(F.col("after") - last <= fore, F.col("after")).when(F.col("after").isNull() & (F.col("last_ix") - last < fore), F.col("last_ix")).otherwise(last)
    x = x.withColumn("wide", F.when(F.col("head"), F.struct(start.alias("a"), end.alias("b"))))
    # starts of wide runs rise with their runs, so the neighbours decide whether runs merge
    x = x.withColumn("reach", F.max("wide.b").over(asc.rowsBetween(*so_far)))
    joins = F.col("wide.a") - F.max("wide.b").over(asc.rowsBetween(*before)) <= params.seg_max_gap + 1
    x = x.withColumn("mark", F.when(F.col("head"), F.struct(F.col("wide.a").alias("a"), F.coalesce(joins, F.lit(False)).alias("joins"))))
    x = x.withColumn("ahead", F.last("mark", ignorenulls=True).over(desc.rowsBetween(*before)))
    inside = (F.col("reach") >= F.col("line_ix")) | (F.col("ahead.a") <= F.col("line_ix")) | (F.col("reach").isNotNull() & F.col("ahead.joins"))
    return x.withColumn("is_mistimed", F.col("is_short") | F.coalesce(inside, F.lit(False))).select(*lines.columns, "is_mistimed")


def find_segments(lines: DataFrame, params: Params) -> DataFrame:
    """groups: runs of mistimed lines long enough to transcribe again."""
    return runs(find_mistimed(lines, params, params.mistimed_seg_thresh_sec), params.seg_min_lines, "is_mistimed")


def segment_spans(lines: DataFrame, params: Params, pad: bool = False) -> DataFrame:
    """``find_segments``, with ``pad`` one line wider on either side, with ``start_ms`` and ``end_ms``: one exchange in all."""
    w = by_line()
    x = find_mistimed(lines, params, params.mistimed_seg_thresh_sec)
    x = run_bounds(x.withColumns({"prev_start": F.lag("start_ms").over(w), "next_end": F.lead("end_ms").over(w)}), "is_mistimed")
    g = x.where("is_mistimed").groupBy("media_id", "run_first", "run_last", "last_ix").agg(F.min_by(F.struct("start_ms", "prev_start"), "line_ix").alias("a"), F.max_by(F.struct("end_ms", "next_end"), "line_ix").alias("b"))
    g = g.where(F.col("run_last") - F.col("run_first") + 1 >= params.seg_min_lines)
    if pad:
        # overlapping or equal bounds cannot change the order of runs, so they are numbered as before
        g = g.select("media_id", "run_first", F.greatest(F.col("run_first") - 1, F.lit(0)).alias("start_ix"), F.least(F.col("run_last") + 1, "last_ix").alias("end_ix"), F.coalesce("a.prev_start", "a.start_ms").alias("start_ms"), F.coalesce("b.next_end", "b.end_ms").alias("end_ms"))
    else:
        g = g.select("media_id", "run_first", F.col("run_first").alias("start_ix"), F.col("run_last").alias("end_ix"), F.col("a.start_ms").alias("start_ms"), F.col("b.end_ms").alias("end_ms"))
    at = Window.partitionBy("media_id").orderBy("run_first")
    return g.select("media_id", (F.row_number().over(at) - 1).cast("long").alias("group_ix"), "start_ix", "end_ix", (F.col("end_ix") - F.col("start_ix") + 1).alias("n_lines"), "start_ms", "end_ms")


def pad_segments(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """One more line on either side, within the media."""
    n = lines.groupBy("media_id").agg(F.count("*").alias("n_all"))
    g = groups.join(n, "media_id").select("media_id", "group_ix", F.greatest(F.col("start_ix") - 1, F.lit(0)).alias("start_ix"), F.least(F.col("end_ix") + 1, F.col("n_all") - 1).alias("end_ix"))
    return g.withColumn("n_lines", F.col("end_ix") - F.col("start_ix") + 1)


def span_times(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """groups with the start of their first and the end of their last line; those that have them are left."""
    if {"start_ms", "end_ms"} <= set(groups.columns):
        return groups
    a = lines.select("media_id", F.col("line_ix").alias("start_ix"), "start_ms")
    b = lines.select("media_id", F.col("line_ix").alias("end_ix"), "end_ms")
    return groups.join(a, ["media_id", "start_ix"]).join(b, ["media_id", "end_ix"])


def segment_report(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """Start, end, duration and size of each run, also as m:ss.ss."""
    g = span_times(groups, lines).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    texts = [seconds_text(F.col(f"{c}_ms")).alias(f"{c}_text") for c in ("start", "end", "duration")]
    return g.select("media_id", "group_ix", "start_ix", "end_ix", "n_lines", "start_ms", "end_ms", "duration_ms", *texts)


def long_lines(lines: DataFrame, threshold_sec: float) -> DataFrame:
    return lines.where(duration() > threshold_sec * 1000)


def long_gaps(lines: DataFrame, threshold_sec: float) -> DataFrame:
    """(gap_start_ms, gap_end_ms) where the next line by time starts over ``threshold_sec`` later."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms", "line_ix")
    g = lines.select("media_id", F.col("end_ms").alias("gap_start_ms"), F.lead("start_ms").over(w).alias("gap_end_ms"))
    return g.where(F.col("gap_end_ms") - F.col("gap_start_ms") > threshold_sec * 1000)


def expand_runs_by_time(groups: DataFrame, lines: DataFrame, time_limit_sec: float, boundary_sec: float) -> DataFrame:
    """(.., back_ix, fore_ix): the farthest long line that each run reaches within a time limit.

    From a run's first line backward, and from its last line forward, lines are
    walked (that line included) while their durations add up to no more than the
    limit; null where no line longer than ``boundary_sec`` is met.

    Durations are added up once over a media. Where none is negative, the lines
    within the limit are those whose sums lie in a range, so each run looks up the
    first long line beyond its bound in a union of long lines and bounds, sorted by
    sums. Media that have a line ending before it starts walk instead.
    """
    limit, boundary = F.lit(time_limit_sec * 1000), F.lit(boundary_sec)
    run = F.struct(*groups.columns)
    none = F.lit(None)
    d = lines.select("media_id", "line_ix", duration().cast("double").alias("dur"))
    edges = groups.select("media_id", run.alias("run"), F.explode(F.array(F.struct(F.col("start_ix").alias("line_ix"), F.lit("back").alias("side")), F.struct(F.col("end_ix").alias("line_ix"), F.lit("fore").alias("side")))).alias("e"))
    both = d.withColumns({"run": none.cast(edges.schema["run"].dataType), "side": none.cast("string")}).unionByName(edges.select("media_id", "e.line_ix", none.cast("double").alias("dur"), "run", "e.side"))
    # an edge stands after its line, and knows its sum
    w = Window.partitionBy("media_id").orderBy("line_ix", F.col("run").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"upto": F.sum("dur").over(w), "own": F.last("dur", ignorenulls=True).over(w), "odd": F.coalesce(F.min("dur").over(Window.partitionBy("media_id")) < 0, F.lit(False))})

    # a line counts with its sum before it (back) or with it (fore), an edge with its bound; places rise toward the edge
    is_line = F.col("run").isNull()
    place = lambda side, at: F.struct(F.lit(side).alias("side"), at.alias("at"))
    lines_at = F.array(place("back", F.col("own") - F.col("upto")), place("fore", F.col("upto")))
    edge_at = F.array(F.struct("side", F.when(F.col("side") == "back", limit - F.col("upto")).otherwise(F.col("upto") - F.col("own") + limit).alias("at")))
    wanted = ~F.col("odd") & (~is_line | (F.col("dur") / F.lit(1000.0) > boundary))
    x = both.where(wanted | ~is_line).select("media_id", "line_ix", "run", "odd", F.explode(F.when(is_line, lines_at).otherwise(edge_at)).alias("p")).select("media_id", "line_ix", "run", "odd", "p.*")
    tie = F.when(F.col("side") == "back", -F.col("line_ix")).otherwise(F.col("line_ix"))
    order = Window.partitionBy("media_id", "side").orderBy("at", F.col("run").isNotNull(), tie).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("met", F.last(F.when(F.col("run").isNull(), F.col("line_ix")), ignorenulls=True).over(order)).where("run is not null")
    hit = ~F.col("odd") & F.when(F.col("side") == "back", F.col("met") <= F.col("line_ix")).otherwise(F.col("met") >= F.col("line_ix"))
    found = x.select("media_id", "run", F.when(hit & (F.col("side") == "back"), F.col("met")).alias("back_ix"), F.when(hit & (F.col("side") == "fore"), F.col("met")).alias("fore_ix"))

    # the walk stops for good at the first excess, even if a negative duration would bring the sum back
    steps = both.where("odd and run is null").select("media_id", "line_ix", "dur").join(edges.select("media_id", "run", "e.side", F.col("e.line_ix").alias("edge_ix")), "media_id")
    steps = steps.where(F.when(F.col("side") == "back", F.col("line_ix") <= F.col("edge_ix")).otherwise(F.col("line_ix") >= F.col("edge_ix")))
    far = Window.partitionBy("media_id", "run", "side").orderBy(F.abs(F.col("line_ix") - F.col("edge_ix"))).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("total", F.sum("dur").over(far)).withColumn("most", F.max("total").over(far)).where((F.col("most") <= limit) & (F.col("dur") / F.lit(1000.0) > boundary))
    walked = steps.groupBy("media_id", "run").agg(F.min(F.when(F.col("side") == "back", F.col("line_ix"))).alias("back_ix"), F.max(F.when(F.col("side") == "fore", F.col("line_ix"))).alias("fore_ix"))

    out = found.unionByName(walked).groupBy("media_id", "run").agg(F.max("back_ix").alias("back_ix"), F.max("fore_ix").alias("fore_ix"))
    return out.select("run.*", "back_ix", "fore_ix")
