"""Transcripts that keep landing, each file converted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from subtide.functions.columns import media_of_file
from subtide.operators import words
from subtide.schema import Params
from subtide.sources import transcripts


def incremental_convert(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, params: Params, dialect: str = "segmented", landed: str = "files") -> StreamingQuery:
    """Convert the files that are new in ``in_dir`` and append their lines to ``out_dir``.

    A file has one document and its media's name; with ``landed="rows"`` it has any number
    of them, a JSON object (media_id, doc) each on a line of its own. A file a media costs a
    look at the folder, an entry in the checkpoint and at least a disk block for each. A
    document's words and lines stay in its task, in order, so nothing is shuffled.
    Rejected documents go to ``<out_dir>_rejected`` with the reason. The checkpoint remembers files; a batch that is run again after a failure
    overwrites its own folder, so lines are never doubled.
    """
    if landed == "rows":
        docs = spark.readStream.schema("media_id string, doc string").json(in_dir)
    else:
        files = spark.readStream.format("text").option("wholetext", True).load(in_dir)
        docs = files.select(media_of_file().alias("media_id"), F.col("value").alias("doc"))

    def convert(batch: DataFrame, number: int) -> None:
        good, bad = transcripts.validate_transcripts(transcripts.parse_documents(batch, dialect), dialect)
        bad.select("media_id", "doc", "reason").write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}_rejected/batch={number}")
        timed = transcripts.align_words(transcripts.segment_words(good), dialect == "segmented_speakers")
        words.convert_in_order(timed, params).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return docs.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
