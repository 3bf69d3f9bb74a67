"""Repair timings: merge, redistribute, pad, splice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subtide.functions.columns import strip
from subtide.operators import detect
from subtide.schema import Params


def _rows_of(groups: DataFrame, from_ix: Column) -> DataFrame:
    """One row for each line of each group, from ``from_ix`` to its end."""
    return groups.select("media_id", "group_ix", "start_ix", "end_ix", F.explode(F.sequence(from_ix, F.col("end_ix"))).alias("line_ix"))


def merge_forward(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """A run at the start of a media gives its texts and start time to the next line, and is blanked."""
    first = groups.where("start_ix = 0").select("media_id", F.col("end_ix").alias("run_end"))
    n = lines.groupBy("media_id").agg(F.count("*").alias("n_all"))
    first = first.join(n, "media_id").where("run_end + 1 < n_all").drop("n_all")
    head = lines.join(first, "media_id").where("line_ix <= run_end")
    joined = head.groupBy("media_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "text"))), lambda x: x["text"])).alias("run_text"), F.min_by("start_ms", "line_ix").alias("run_start"))
    x = lines.join(first, "media_id", "left").join(joined, "media_id", "left")
    takes = F.col("line_ix") == F.col("run_end") + 1
    text = F.when(takes, F.concat_ws(" ", "run_text", "text")).when(F.col("line_ix") <= F.col("run_end"), "").otherwise(F.col("text"))
    return x.withColumns({"text": text, "start_ms": F.when(takes, F.col("run_start")).otherwise(F.col("start_ms"))}).select(*lines.columns)


def redistribute_backward(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """The line before a run and the run share their time in proportion to text length, each share cut to whole ms."""
    rows = _rows_of(groups.where("start_ix > 0"), F.col("start_ix") - 1).select("media_id", "line_ix", F.col("group_ix").alias("run"))
    x = lines.join(rows, ["media_id", "line_ix"])
    every, order = Window.partitionBy("media_id", "run"), Window.partitionBy("media_id", "run").orderBy("line_ix")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumns({"chars": F.length("text").cast("double"), "from_ms": F.first("start_ms").over(whole), "to_ms": F.last("end_ms").over(whole)})
    x = x.withColumn("all_chars", F.sum("chars").over(every)).where("all_chars > 0")
    x = x.withColumn("share", ((F.col("to_ms") - F.col("from_ms")) * (F.col("chars") / F.col("all_chars"))).cast("long"))
    x = x.withColumn("new_end", F.col("from_ms") + F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    new = x.select("media_id", "line_ix", (F.col("new_end") - F.col("share")).alias("new_start"), "new_end")
    out = lines.join(new, ["media_id", "line_ix"], "left")
    return out.withColumns({"start_ms": F.coalesce("new_start", "start_ms"), "end_ms": F.coalesce("new_end", "end_ms")}).select(*lines.columns)


def fix_mistimed(lines: DataFrame, params: Params, line_range: tuple[int, int] | None = None) -> DataFrame:
    """Repair every mistimed run (of those that overlap the range, if given).

    It gives what ``merge_forward`` and ``redistribute_backward`` give over the
    runs, with the runs as columns of their lines: one exchange by media, which
    the texts of runs at the start of a media read once more.
    """
    asc = Window.partitionBy("media_id").orderBy("line_ix")
    x = detect.run_bounds(detect.find_mistimed(lines, params), "is_mistimed")
    chosen = F.col("is_mistimed")
    if line_range is not None:
        chosen = chosen & (F.col("run_first") <= max(line_range)) & (F.col("run_last") >= min(line_range))
    x = x.withColumn("own_run", F.when(chosen, F.col("run_first"))).withColumn("head_end", F.first(F.when(F.col("own_run") == 0, F.col("run_last"))).over(asc.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("head_end", F.when(F.col("head_end") < F.col("last_ix"), F.col("head_end")))
    head = x.where("line_ix <= head_end").groupBy("media_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "text"))), lambda r: r["text"])).alias("run_text"), F.min_by("start_ms", "line_ix").alias("run_start"))
    # a line before a run shares its time with it
    x = x.withColumn("run", F.when(F.col("own_run") > 0, F.col("own_run")).when(F.col("own_run").isNull(), F.lead("own_run").over(asc)))
    x = x.join(head, "media_id", "left")
    takes = F.col("line_ix") == F.col("head_end") + 1
    text = F.when(takes, F.concat_ws(" ", "run_text", "text")).when(F.col("line_ix") <= F.col("head_end"), "").otherwise(F.col("text"))
    x = x.withColumns({"text": text, "start_ms": F.when(takes, F.col("run_start")).otherwise(F.col("start_ms"))})
    order = Window.partitionBy("media_id", "run").orderBy("line_ix")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("chars", F.length("text").cast("double"))
    x = x.withColumns({"from_ms": F.first("start_ms").over(whole), "to_ms": F.last("end_ms").over(whole), "all_chars": F.sum("chars").over(whole)})
    moves = F.col("run").isNotNull() & (F.col("all_chars") > 0)
    x = x.withColumn("share", F.when(moves, ((F.col("to_ms") - F.col("from_ms")) * (F.col("chars") / F.col("all_chars"))).cast("long")))
    x = x.withColumn("new_end", F.col("from_ms") + F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumns({"start_ms": F.when(moves, F.col("new_end") - F.col("share")).otherwise(F.col("start_ms")), "end_ms": F.when(moves, F.col("new_end")).otherwise(F.col("end_ms"))}).select(*lines.columns)


def renumber(lines: DataFrame, *order: str | Column) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy(*(order or ("line_ix",)))
    return lines.withColumn("line_ix", (F.row_number().over(w) - 1).cast("long"))


def remove_empty(lines: DataFrame, line_range: tuple[int, int] | None = None) -> DataFrame:
    """Drop lines without text (in the range only, if given) and renumber."""
    empty = strip(F.col("text")) == ""
    if line_range is not None:
        empty = empty & F.col("line_ix").between(min(line_range), max(line_range))
    return renumber(lines.where(~empty))


def _active(lines: DataFrame, params: Params, line_range: tuple[int, int] | None) -> DataFrame:
    chars = F.length("text")
    need = chars / F.lit(float(params.max_cps)) * F.lit(1000.0) if params.max_cps > 0 else F.lit(0.0)
    x = lines.withColumn("dur", F.greatest(need, F.lit(params.min_sec * 1000.0)))
    x = x.withColumn("target", F.least(F.col("start_ms") + F.col("dur"), F.col("end_ms") + F.lit(params.max_lead_out_sec * 1000.0)))
    act = (chars > 0) & (F.col("target") > F.col("end_ms"))
    if line_range is not None:
        act = act & F.col("line_ix").between(min(line_range), max(line_range))
    return x.withColumn("active", act)


def apply_timing_standards(lines: DataFrame, params: Params, line_range: tuple[int, int] | None = None) -> DataFrame:
    """Lengthen lines to the reading speed and least duration without crossing neighbours of their style.

    Two passes of windows. Media that have a line ending before it starts are
    gone through line by line instead, as their order of changes matters.
    """
    x = _active(lines, params, line_range)
    x = x.withColumn("odd", F.max(F.col("end_ms") < F.col("start_ms")).over(Window.partitionBy("media_id")))
    w = Window.partitionBy("media_id", "style").orderBy("line_ix")
    y = x.where(~F.col("odd")).withColumn("new_end", F.least("target", F.lead("start_ms").over(w).cast("double")))
    y = y.withColumn("end_1", F.when(F.col("active"), F.bround(F.greatest(F.col("end_ms").cast("double"), "new_end")).cast("long")).otherwise(F.col("end_ms")))
    y = y.withColumn("prev_end", F.coalesce(F.lag("end_1").over(w), F.lit(0)))
    lack = F.col("dur") - (F.col("new_end") - F.col("start_ms"))
    earlier = F.greatest(F.col("start_ms") - F.least(lack, F.lit(params.max_lead_in_sec * 1000.0)), F.col("prev_end").cast("double"))
    y = y.withColumn("start_2", F.when(F.col("active") & (lack > 0) & (earlier < F.col("start_ms")), earlier.cast("long")).otherwise(F.col("start_ms")))
    full = F.greatest(F.col("end_ms").cast("double"), "new_end", (F.col("start_2") + 1).cast("double"))
    y = y.withColumn("end_2", F.when(F.col("active") & (full > F.col("end_ms")), F.bround(full).cast("long")).otherwise(F.col("end_ms")))
    even = y.select(*[F.col({"start_ms": "start_2", "end_ms": "end_2"}.get(c, c)).alias(c) for c in lines.columns])
    lead_in, columns = params.max_lead_in_sec * 1000.0, lines.columns

    def walk(media: pd.DataFrame) -> pd.DataFrame:
        media = media.sort_values("line_ix", ignore_index=True)
        start, end = media["start_ms"].tolist(), media["end_ms"].tolist()
        following: dict[int, int] = {}
        last: dict[str, int] = {}
        for i, style in enumerate(media["style"]):
            if style in last:
                following[last[style]] = i
            last[style] = i
        before = {j: i for i, j in following.items()}
        for i in media.index[media["active"]]:
            dur, until = media["dur"][i], media["target"][i]
            if i in following:
                until = min(until, start[following[i]])
            lack = dur - (until - start[i])
            if lack > 0:
                earlier = max(start[i] - min(lack, lead_in), end[before[i]] if i in before else 0)
                if earlier < start[i]:
                    start[i] = int(earlier)
            full = max(end[i], until, start[i] + 1)
            if full > end[i]:
                end[i] = int(round(full))
        return media.assign(start_ms=start, end_ms=end)[columns]

    uneven = x.where("odd").groupBy("media_id").applyInPandas(walk, lines.schema)
    return even.unionByName(uneven)


def splice(lines: DataFrame, ranges: DataFrame, replacement: DataFrame) -> DataFrame:
    """Replace index ranges by new lines.

    ``replacement`` has the columns of ``lines`` with ``lo_ix`` (its range) and
    ``new_ix`` (its order). A range beyond the media leaves it as it is; ranges
    that overlap are an error.
    """
    n = lines.groupBy("media_id").agg(F.count("*").alias("n_all"))
    w = Window.partitionBy("media_id").orderBy("lo_ix")
    r = ranges.join(n, "media_id").where("lo_ix >= 0 and lo_ix <= hi_ix and hi_ix < n_all").withColumn("reach", F.max("hi_ix").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.select("media_id", F.when(F.col("lo_ix") <= F.col("reach"), F.raise_error(F.lit("ranges overlap")).cast("long")).otherwise(F.col("lo_ix")).alias("lo_ix"), "hi_ix")
    gone = r.select("media_id", F.explode(F.sequence("lo_ix", "hi_ix")).alias("line_ix"))
    kept = lines.join(gone, ["media_id", "line_ix"], "left_anti").withColumns({"at": F.col("line_ix"), "nth": F.lit(-1).cast("long")})
    new = replacement.join(r.select("media_id", "lo_ix"), ["media_id", "lo_ix"])
    new = new.withColumns({"at": F.col("lo_ix"), "nth": F.col("new_ix").cast("long"), "line_ix": F.lit(0).cast("long")}).select(*kept.columns)
    return renumber(kept.unionByName(new), "at", "nth").select(*lines.columns)


def shift(lines: DataFrame, offset_ms: Column | int) -> DataFrame:
    move = F.lit(offset_ms) if isinstance(offset_ms, int) else offset_ms
    return lines.withColumns({"start_ms": F.col("start_ms") + move, "end_ms": F.col("end_ms") + move})


def cut_plan(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """Start, end and length of the audio of each group, and the key under which it is kept."""
    g = detect.span_times(groups, lines)
    return g.select("media_id", "group_ix", "start_ix", "end_ix", "start_ms", "end_ms", ((F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)).alias("duration_s"), F.concat_ws("-", "start_ms", "end_ms").alias("cut_key"))


def parse_line_range(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """"XX-YY" or "XX", counted from 1, to ``lo_ix`` and ``hi_ix``, counted from 0; other text is an error."""
    s = F.trim(F.col(spec))
    ok = s.rlike(r"^[0-9]+(-[0-9]+)?$")
    lo = F.regexp_extract(s, r"^([0-9]+)", 1)
    hi = F.regexp_extract(s, r"-([0-9]+)$", 1)
    checked = F.when(ok, lo).otherwise(F.raise_error(F.concat(F.lit("not a line range: "), F.coalesce(s, F.lit("null"))))).cast("long")
    return specs.withColumns({"lo_ix": checked - 1, "hi_ix": F.when(hi == "", checked).otherwise(hi.cast("long")) - 1})


def in_range(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines in their media's range."""
    return lines.join(ranges.select("media_id", "lo_ix", "hi_ix"), "media_id").where(F.col("line_ix").between(F.col("lo_ix"), F.col("hi_ix"))).select(*lines.columns)


def rebase_range(ranges: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Move a range's end by the change in the number of lines, not before its start."""
    a = before.groupBy("media_id").agg(F.count("*").alias("n_before"))
    b = after.groupBy("media_id").agg(F.count("*").alias("n_after"))
    r = ranges.join(a, "media_id", "left").join(b, "media_id", "left")
    moved = F.col("hi_ix") + F.coalesce("n_after", F.lit(0)) - F.coalesce("n_before", F.lit(0))
    return r.select("media_id", "lo_ix", F.greatest("lo_ix", moved).alias("hi_ix"))


def pending_cuts(cuts: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(done before, still to do) by media and times."""
    key = ["media_id", "start_ms", "end_ms"]
    seen = done.select(*key).distinct()
    return cuts.join(seen, key, "left_semi"), cuts.join(seen, key, "left_anti")


def retranscribe(lines: DataFrame, cuts: DataFrame, seg_words: DataFrame, params: Params) -> DataFrame:
    """Put lines built from new words of each cut in its place.

    ``seg_words`` is a words table with ``group_ix``; its times start at the cut.
    """
    from subtide.operators import words as W

    # one media a cut while lines are built, so that numbering starts anew in each
    named = seg_words.withColumn("owner", F.col("media_id")).withColumn("media_id", F.struct("owner", "group_ix")).drop("group_ix", "owner")
    built = W.convert(named, params).select(F.col("media_id.owner").alias("media_id"), F.col("media_id.group_ix").alias("group_ix"), F.col("line_ix").alias("new_ix"), "start_ms", "end_ms", "style", "text", "speaker")
    at = cuts.select("media_id", "group_ix", F.col("start_ix").alias("lo_ix"), F.col("end_ix").alias("hi_ix"), F.col("start_ms").alias("cut_ms"))
    built = shift(built.join(at, ["media_id", "group_ix"]), F.col("cut_ms")).drop("cut_ms", "hi_ix", "group_ix")
    return remove_empty(splice(lines, at.select("media_id", "lo_ix", "hi_ix"), built))
