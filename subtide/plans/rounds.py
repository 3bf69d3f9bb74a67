"""Translation in rounds: each asks for the next batch of every media.

What a batch is asked depends on the lines translated before it, so the batches of
a media go one after another, and those of different media at once. A round takes
every media's open batch, makes its prompt from the last translated lines, asks
for what the answer store lacks, and writes one row a media to ``rounds/round=N``:
the batch's translated texts if the count is right or no attempt is left, or else
the entries to be put right in the next round. After ``translate_retries``
attempts the fallback model has as many; what it cannot do either is made to fit.

A round needs the rows of the round before only (they carry the last lines along),
so its work is that of the open media. A round whose folder has no commit marker
does not count; its answers do, so a run that is stopped goes on where it was and
asks nothing again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import store as S
from subtide.operators import translate as T
from subtide.operators.answers import AnswerStore
from subtide.schema import Params

KEYS = ("model", "system", "prompt", "attempt")
ROUND = "media_id {0}, batch_ix long, attempt int, model string, status string, n_said long, start_ix long, said array<string>, texts array<string>, tail array<string>"


def _tail(translated: DataFrame, batches: DataFrame, context_lines: int) -> DataFrame:
    """(media_id, tail): the last translated lines before each media's first batch."""
    first = batches.where("batch_ix = 0").select("media_id", "start_ix")
    near = translated.join(first, "media_id").where(f"line_ix between start_ix - {context_lines} and start_ix - 1")
    return near.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "text"))), lambda x: x["text"]).alias("tail"))


def translate_rounds(
    lines: DataFrame, home: str, call: Callable[[list[dict]], list[str]], params: Params, *, model: str, lang_from: str, lang_to: str,
    fallback_model: str | None = None, contexts: DataFrame | None = None, translated: DataFrame | None = None, mode: str = "intent", per_call: int = 16, **store_options,
) -> DataFrame:
    """lines with translated texts; ``call`` gets dicts of model, system, prompt and attempt, and returns as many answers.

    ``home`` is a folder of this run, shared by the driver and all executors: a
    second call with the same inputs takes up what the first has left.
    ``translated`` (media_id, line_ix, text) has lines done before; what they leave
    of a media must be without gaps.
    """
    spark = lines.sparkSession
    home = home.rstrip("/")
    left = lines if translated is None else T.pending_lines(lines, translated)
    batches = S.keep(T.plan_batches(left, params.batch_lines, params.max_cont_lines), f"{home}/batches")
    # one row a batch, in order of batches, so that a round reads little of it
    payload = T.batch_windows(left, batches, params.discard_lines)
    rows = payload.groupBy("media_id", "batch_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("rows"))
    asked = S.keep(rows.join(batches.select("media_id", "batch_ix", "start_ix", "n_lines"), ["media_id", "batch_ix"]).repartitionByRange("batch_ix", "media_id").sortWithinPartitions("batch_ix"), f"{home}/asked")
    models = [m for m in (model, fallback_model) if m]
    kind = ROUND.format(lines.schema["media_id"].dataType.simpleString())
    context = contexts.select("media_id", "context") if contexts is not None else None
    if translated is not None:
        before = S.keep(_tail(translated, batches, params.context_lines), f"{home}/tail")
    else:
        before = None
    n = 0
    while S.committed(spark, f"{home}/rounds/round={n}"):
        n += 1
    while _run_round(spark, _front(spark, home, n, asked, before, kind), context, home, n, call, params, models, lang_from, lang_to, mode, kind, per_call, store_options):
        n += 1
    done = finished(spark, home, kind)
    x = lines.join(done.withColumnRenamed("text", "new_text"), ["media_id", "line_ix"], "left")
    if translated is not None:
        x = x.join(translated.select("media_id", "line_ix", F.col("text").alias("old_text")), ["media_id", "line_ix"], "left")
        x = x.withColumn("new_text", F.coalesce("new_text", "old_text"))
    x = x.withColumn("text", F.coalesce("new_text", "text")).select(*lines.columns)
    return T.md_to_ass(x).select(*lines.columns)


def finished(spark: SparkSession, home: str, kind: str) -> DataFrame:
    """(media_id, line_ix, text) of all committed rounds."""
    names = [x for x in S.folders(spark, f"{home}/rounds") if S.committed(spark, f"{home}/rounds/{x}")]
    if not names:
        return spark.createDataFrame([], kind.split(",")[0] + ", line_ix long, text string")
    rows = spark.read.schema(kind).parquet(*[f"{home}/rounds/{x}" for x in names]).where("texts is not null")
    return rows.select("media_id", "start_ix", F.posexplode("texts").alias("pos", "text")).select("media_id", (F.col("start_ix") + F.col("pos")).alias("line_ix"), "text")


def _front(spark: SparkSession, home: str, n: int, asked: DataFrame, before: DataFrame | None, kind: str) -> DataFrame:
    """The open batch of each media with what is known of it."""
    none = lambda x: F.lit(None).cast(x)
    if n == 0:
        front = asked.where("batch_ix = 0").withColumns({"attempt": F.lit(0), "said": none("array<string>")})
        front = front.join(before, "media_id", "left") if before is not None else front.withColumn("tail", none("array<string>"))
    else:
        last = spark.read.schema(kind).parquet(f"{home}/rounds/round={n - 1}")
        over = F.col("texts").isNotNull()
        nxt = last.select("media_id", (F.col("batch_ix") + over.cast("int")).alias("batch_ix"), F.when(over, 0).otherwise(F.col("attempt") + 1).alias("attempt"), F.when(~over, F.col("said")).alias("said"), "tail")
        span = nxt.agg(F.min("batch_ix").alias("a"), F.max("batch_ix").alias("b")).first()
        # batches lie in order, so only the parts that can be open are read
        front = asked.where(F.col("batch_ix").between(span["a"] or 0, span["b"] or 0)).join(nxt, ["media_id", "batch_ix"])
    return front


def _run_round(spark, front, context, home, n, call, params, models, lang_from, lang_to, mode, kind, per_call, store_options) -> bool:
    """Ask for the batches in ``front`` and commit the round's rows; False if no batch is open."""
    most = params.translate_retries
    last_attempt = most * len(models) - 1
    numbered = lambda c: F.array_join(F.transform(c, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    past = F.when(F.size("tail") > 0, F.slice("tail", F.greatest(F.size("tail") - params.context_lines + 1, F.lit(1)), params.context_lines))
    x = front.withColumns({"n_entries": F.size("rows").cast("long"), "entries": numbered(F.transform("rows", T.one_row)), "n_past": F.coalesce(F.size(past), F.lit(0)), "past": F.array_join(past, "\n")})
    x = x.join(context, "media_id", "left") if context is not None else x.withColumn("context", F.lit(""))
    n_said = F.size("said").cast("long")
    again = F.col("said").isNotNull() & (F.abs(n_said - F.col("n_entries")) <= T.MOST_OFF)
    prompt = F.when(again, T.retry_text(lang_from, lang_to, n_said, F.col("n_entries"), F.col("entries"), numbered(F.col("said")))).otherwise(T.prompt_text(lang_from, lang_to))
    which = F.element_at(F.array(*[F.lit(m) for m in models]), F.least(F.floor(F.col("attempt") / most) + 1, F.lit(len(models))).cast("int"))
    requests = T.with_system(x.select(*front.columns, which.alias("model"), prompt.alias("prompt")), lang_from, lang_to)
    # written, so that the round's batches are met and its prompts made once
    front = requests = S.keep(requests, f"{home}/requests/round={n}")
    if not requests.count():
        return False
    store = AnswerStore(spark, f"{home}/answers/round={n}", KEYS, per_call=per_call, retries=params.server_retries, **store_options)
    said = store.ask(requests.select("media_id", "batch_ix", *KEYS), call).withColumn("response", F.coalesce("response", F.lit("")))
    entries = T.clean_ellipses(T.strip_numbering(T.split_responses(said)), mode)
    payload = front.select("media_id", "batch_ix", F.posexplode("rows").alias("pos", "text"))
    key = ["media_id", "batch_ix", "attempt"]
    status = T.check_counts(entries, payload, last_attempt + 1).select(*key, "n_said", F.col("status"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda r: r["entry"])
    as_said = entries.groupBy(*key).agg(in_order.alias("said"))
    fitted = T.force_counts(entries, payload).groupBy(*key).agg(in_order.alias("fitted"))
    over = F.col("status").isin("ok", "fallback")
    texts = F.when(over, F.slice("fitted", F.lit(1), F.col("n_lines").cast("int")))
    out = front.select(*key, "start_ix", "n_lines", "tail", "model").join(status, key).join(as_said, key).join(fitted, key)
    tail = F.coalesce("tail", F.array().cast("array<string>"))
    grown = F.concat(tail, F.coalesce("texts", F.array().cast("array<string>")))
    out = out.withColumn("texts", texts)
    out = out.withColumn("tail", F.slice(grown, F.greatest(F.size(grown) - params.context_lines + 1, F.lit(1)), max(1, params.context_lines)))
    out = out.withColumn("said", F.when(~over, F.col("said"))).withColumn("status", F.when(F.col("status") == "fallback", "forced").otherwise(F.col("status")))
    out.select(*[f.strip().split(" ")[0] for f in kind.split(", ")]).write.mode("overwrite").parquet(f"{home}/rounds/round={n}")
    return True
