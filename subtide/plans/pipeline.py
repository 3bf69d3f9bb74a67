"""Whole runs over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import store as S
from subtide.operators import detect, repair, translate, words
from subtide.schema import Params

STAGES = ("convert", "retranscribe", "fix", "translate", "pad")

Table = DataFrame | Callable[..., DataFrame]


def _given(table: Table, *facts: DataFrame) -> DataFrame:
    return table(*facts) if callable(table) else table


def run_stage(stage: str, lines: DataFrame, tables: dict[str, Table], params: Params) -> DataFrame:
    """lines after one stage (for ``convert``, lines are the words).

    ``retranscribe`` needs ``seg_words``, new words of mistimed segments, and
    ``translate`` needs ``responses``; each is a table, or a function of what it
    depends on: ``seg_words(lines, cuts)``, ``responses(payload)``. With
    ``translation``, a function of the lines, that decides the whole stage.
    """
    if stage == "convert":
        return words.convert(lines, params, tables.get("suggestions"))
    if stage == "retranscribe":
        cuts = repair.cut_plan(detect.segment_spans(lines, params, pad=True), lines)
        return repair.retranscribe(lines, cuts, _given(tables["seg_words"], lines, cuts), params)
    if stage == "fix":
        return repair.remove_empty(repair.fix_mistimed(lines, params))
    if stage == "translate":
        if "translation" in tables:
            return _given(tables["translation"], lines)
        said = tables["responses"]
        if callable(said):
            batches = translate.plan_batches(lines, params.batch_lines, params.max_cont_lines)
            said = said(translate.batch_windows(lines, batches, params.discard_lines))
        return translate.translate(lines, said, params)
    if stage == "pad":
        return repair.apply_timing_standards(lines, params)
    raise ValueError(f"no such stage: {stage}")


def run_pipeline(tables: dict[str, Table], stages: Sequence[str], params: Params, keep: Callable[[DataFrame, str], DataFrame] = lambda lines, stage: lines) -> DataFrame:
    """lines after the chosen stages, in order.

    ``tables`` has ``words`` (for convert) or ``lines``, and what the other stages
    need (``run_stage``). ``keep`` (lines, stage) may write what a stage gives and
    return it as read back, as the next stage reads its lines many times over.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    lines = tables["words"] if "convert" in stages else tables["lines"]
    for stage in STAGES:
        if stage in stages:
            lines = keep(run_stage(stage, lines, tables, params), stage)
    return lines


class StageStore:
    """What each stage has given, by media, in a shared folder.

    A commit is a version: the rows of some media, and then the list of these
    media, which makes it count. Both are partitions that a repeated commit of the
    same version overwrites alone. Of a media the newest version holds; a media
    whose version is older than that of the stage before is pending again.
    """

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")

    def _events(self, stage: str) -> DataFrame | None:
        """(media_id, alive, version) of every commit and removal."""
        path = f"{self.home}/{stage}/media"
        if not any(x.startswith("version=") for x in S.folders(self.spark, path)):
            return None
        return self.spark.read.parquet(path).withColumn("version", F.col("version").cast("long"))

    def _next_version(self) -> int:
        seen = [int(v.split("=")[1]) for stage in S.folders(self.spark, self.home) for v in S.folders(self.spark, f"{self.home}/{stage}/media") if v.startswith("version=")]
        return max(seen, default=0) + 1

    def _add(self, rows: DataFrame, version: int, path: str) -> None:
        rows.withColumn("version", F.lit(version)).write.partitionBy("version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    def media(self, stage: str) -> DataFrame | None:
        """(media_id, version) of the media that the stage has done."""
        events = self._events(stage)
        if events is None:
            return None
        newest = events.groupBy("media_id").agg(F.max(F.struct("version", "alive")).alias("e"))
        return newest.where("e.alive").select("media_id", "e.version")

    def commit(self, stage: str, rows: DataFrame, media: DataFrame) -> None:
        """Keep rows as what the stage gives for ``media`` (a media may have no row)."""
        version = self._next_version()
        self._add(rows, version, f"{self.home}/{stage}/lines")
        self._add(media.select("media_id").distinct().withColumn("alive", F.lit(True)), version, f"{self.home}/{stage}/media")

    def remove(self, stage: str, media: DataFrame) -> None:
        """Make ``media`` pending again in the stage."""
        self._add(media.select("media_id").distinct().withColumn("alive", F.lit(False)), self._next_version(), f"{self.home}/{stage}/media")

    def read(self, stage: str) -> DataFrame:
        """The rows of the newest version of each media."""
        path = f"{self.home}/{stage}/lines"
        newest = self.media(stage)
        rows = self.spark.read.parquet(path)
        both = rows.join(newest.select("media_id", F.col("version").alias("newest")), "media_id").where(F.col("version") == F.col("newest"))
        return both.select(*[c for c in rows.columns if c != "version"])

    def pending(self, stage: str, wanted: DataFrame) -> DataFrame:
        """(media_id) of ``wanted`` (media_id[, version]) that the stage has not done, or has done from an older version."""
        done = self.media(stage)
        if done is None:
            return wanted.select("media_id").distinct()
        both = wanted.join(done.withColumnRenamed("version", "own_version"), "media_id", "left")
        stale = F.col("version") > F.col("own_version") if "version" in wanted.columns else F.lit(False)
        return both.where(F.col("own_version").isNull() | stale).select("media_id").distinct()


def run_stages(store: StageStore, tables: dict[str, Table], stages: Sequence[str], params: Params) -> DataFrame:
    """lines after the chosen stages, each of which does its pending media only and keeps what it gives in ``store``.

    A media of ``words`` (or ``lines``) is done by a stage once; where an earlier
    stage does it anew, so do those after it.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    source = tables["words"] if "convert" in stages else tables["lines"]
    before = None
    for stage in [x for x in STAGES if x in stages]:
        todo = store.pending(stage, source if before is None else store.media(before))
        # written, as what a commit adds would change it
        todo = S.keep(todo, f"{S.scratch_dir(store.spark)}/pending")
        if not todo.isEmpty():
            lines = source if before is None else store.read(before)
            store.commit(stage, run_stage(stage, lines.join(todo, "media_id", "left_semi"), tables, params), todo)
        before = stage
    return source if before is None else store.read(before)


def pending_media(manifest: DataFrame, stage_output: DataFrame) -> DataFrame:
    """Media that a stage has no output for."""
    return manifest.join(stage_output.select("media_id").distinct(), "media_id", "left_anti")
