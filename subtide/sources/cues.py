"""Cue files (SRT, VTT, SBV, ASS, SSA) and plain text to lines, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subtide.functions.columns import media_of_file
from subtide.functions.store import write_named

FORMATS = ("srt", "vtt", "sbv", "ass", "ssa")
_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})"


def _ms(text: Column) -> Column:
    """[h:]m:s.fraction to ms."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, _TIME, i), F.lit("")).cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(text, _TIME, 4), 3, "0").cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + fraction


def _clock(ms: Column, mark: str, digits: int, hours: int) -> Column:
    """ms to h:mm:ss and a fraction of 2 or 3 digits."""
    ms = F.greatest(ms, F.lit(0))
    ms = F.bround(ms / 10).cast("long") * 10 if digits == 2 else ms
    second = F.floor(ms / 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hour = F.floor(second / 3600).cast("string")
    hour = F.when(F.length(hour) < hours, F.lpad(hour, hours, "0")).otherwise(hour)
    fraction = F.lpad((F.floor((ms % 1000) / (10 if digits == 2 else 1))).cast("string"), digits, "0")
    return F.concat(hour, F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60), F.lit(mark), fraction)


#: Fields of an event table that does not name its own.
EVENT_FIELDS = ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")


def _body() -> Column:
    return F.regexp_replace(F.regexp_replace("doc", "\ufeff", ""), "\r\n?", "\n")


def _event_rows(files: DataFrame) -> DataFrame:
    """(media_id, at, row, fields, v): the rows of event tables with the fields that the ``Format:`` row before them names, and their values; the last field takes the rest."""
    x = files.select("media_id", F.posexplode(F.split(_body(), "\n")).alias("at", "row"))
    w = Window.partitionBy("media_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("section", F.last(F.when(F.col("row").rlike(r"^\s*\[.*\]\s*$"), F.lower(F.trim("row"))), ignorenulls=True).over(w))
    in_events = F.coalesce(F.col("section") == "[events]", F.lit(True))
    named = F.transform(F.split(F.regexp_replace("row", r"^Format:\s*", ""), ","), lambda f: F.lower(F.trim(f)))
    x = x.withColumn("fields", F.last(F.when(in_events & F.col("row").startswith("Format:"), named), ignorenulls=True).over(w))
    x = x.where(in_events & F.col("row").startswith("Dialogue:")).withColumn("fields", F.coalesce("fields", F.array(*[F.lit(f) for f in EVENT_FIELDS])))
    return x.select("media_id", "at", "row", "fields", F.split(F.regexp_replace("row", r"^Dialogue:\s*", ""), ",", F.size("fields")).alias("v"))


def _field(*names: str) -> Column:
    """The value of the first of the fields that the table has; null without one."""
    at = [F.nullif(F.array_position("fields", n), F.lit(0).cast("long")) for n in names]
    return F.try_element_at("v", F.coalesce(*at).cast("int"))


def rejected_events(files: DataFrame) -> DataFrame:
    """(media_id, at, row, reason): rows of event tables that are no lines."""
    x = _event_rows(files)
    reason = F.when(F.size("v") < F.size("fields"), "too few fields").when(_field("start").isNull() | _field("end").isNull() | _field("text").isNull(), "start, end or text not named")
    reason = reason.when(~_field("start").rlike(_TIME) | ~_field("end").rlike(_TIME), "no time")
    return x.withColumn("reason", reason).where("reason is not null").select("media_id", "at", "row", "reason")


def parse_cues(files: DataFrame, format: str) -> DataFrame:
    """lines of (media_id, doc); rows of event tables that are no lines are left out (``rejected_events``)."""
    body = _body()
    if format in ("ass", "ssa"):
        x = _event_rows(files).where((F.size("v") >= F.size("fields")) & _field("start").rlike(_TIME) & _field("end").rlike(_TIME) & _field("text").isNotNull())
        speaker = _field("name", "actor")
        x = x.select("media_id", "at", _ms(_field("start")).alias("start_ms"), _ms(_field("end")).alias("end_ms"), F.coalesce(F.trim(_field("style")), F.lit("Default")).alias("style"), _field("text").alias("text"), F.when(speaker != "", speaker).otherwise("Unknown").alias("speaker"))
    else:
        arrow = r"(?m)^" + _TIME + (r"\s*,\s*" if format == "sbv" else r"\s*-->\s*") + _TIME
        x = files.select("media_id", F.posexplode(F.split(body, r"\n[ \t]*\n+")).alias("at", "cue")).where(F.col("cue").rlike(arrow))
        time = F.regexp_extract("cue", r"(?m)^([^\n]*?" + (r"\d,\d" if format == "sbv" else "-->") + r"[^\n]*)$", 1)
        sides = F.split(time, r",\s*" if format == "sbv" else r"\s*-->\s*")
        text = F.regexp_replace("cue", r"(?s)^.*?" + (r"\d[.]\d+,[^\n]*" if format == "sbv" else r"-->[^\n]*") + r"\n?", "")
        x = x.select("media_id", "at", _ms(sides[0]).alias("start_ms"), _ms(sides[1]).alias("end_ms"), F.lit("Default").alias("style"), F.replace(F.regexp_replace(text, r"\n+$", ""), F.lit("\n"), F.lit("\\N")).alias("text"), F.lit("Unknown").alias("speaker"))
    w = Window.partitionBy("media_id").orderBy("at")
    return x.select("media_id", (F.row_number().over(w) - 1).cast("long").alias("line_ix"), "start_ms", "end_ms", "style", "text", "speaker")


def read_cues(spark: SparkSession, path: str, format: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(media_of_file().alias("media_id"), F.col("value").alias("doc"))
    return parse_cues(files, format)


def to_cues(lines: DataFrame, format: str) -> DataFrame:
    """(media_id, doc): the cue file of each media."""
    if format in ("ass", "ssa"):
        row = F.concat(F.lit("Dialogue: 0,"), _clock(F.col("start_ms"), ".", 2, 1), F.lit(","), _clock(F.col("end_ms"), ".", 2, 1), F.lit(","), F.col("style"), F.lit(",,0,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N")))
        head, between = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n", "\n"
    else:
        body = F.replace(F.col("text"), F.lit("\\N"), F.lit("\n"))
        mark, arrow, hours = {"srt": (",", " --> ", 2), "vtt": (".", " --> ", 2), "sbv": (".", ",", 1)}[format]
        time = F.concat(_clock(F.col("start_ms"), mark, 3, hours), F.lit(arrow), _clock(F.col("end_ms"), mark, 3, hours))
        row = F.concat((F.col("line_ix") + 1).cast("string"), F.lit("\n"), time, F.lit("\n"), body) if format == "srt" else F.concat(time, F.lit("\n"), body)
        head, between = ("WEBVTT\n\n" if format == "vtt" else ""), "\n\n"
    g = lines.select("media_id", "line_ix", row.alias("row")).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("line_ix", "row"))).alias("rows"))
    return g.select("media_id", F.concat(F.lit(head), F.array_join(F.transform("rows", lambda x: x["row"]), between), F.lit("\n")).alias("doc"))


def to_text(lines: DataFrame) -> DataFrame:
    """(media_id, doc): one text row for each line, in order."""
    g = lines.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("line_ix", "text"))).alias("rows"))
    return g.select("media_id", F.array_join(F.transform("rows", lambda x: x["text"]), "\n").alias("doc"))


def write_cues(lines: DataFrame, path: str, format: str) -> None:
    """``<media_id>.<format>`` for each media."""
    write_named(to_cues(lines, format), path, f".{format}")


def write_text(lines: DataFrame, path: str) -> None:
    """``<media_id>.txt`` for each media."""
    write_named(to_text(lines), path, ".txt")
