"""Translation with model calls as tables of requests and responses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subtide.functions.columns import strip
from subtide.operators.answers import AnswerStore, Overloaded, patiently  # noqa: F401
from subtide.schema import CONTINUE_FLAG, MISSING_TRANSLATION, Params

#: A response whose count is off by more is asked for anew, not put right.
MOST_OFF = 10
NUMBER = r"^\s*([0-9]+)\s*\. "
# Patterns in model names, in the order in which they are tried, and the services that have them.
LLM_ROUTES = (("/", "openrouter"), ("gemini", "gemini"), ("claude", "claude"), ("grok", "grok"), ("o1", "openai"), ("o3", "openai"), ("o4", "openai"), ("gpt", "openai"), ("deepseek", "deepseek"))
SPEECH_ROUTES = (("scribe", "elevenlabs"), ("whisper-1", "openai"), ("whisper-v3", "fireworks"))
# English names of languages, scripts and regions by their tags; tables of one's own can be given instead.
LANGUAGES = (
    ("ar", "Arabic"), ("bg", "Bulgarian"), ("bn", "Bangla"), ("ca", "Catalan"), ("cs", "Czech"), ("da", "Danish"), ("de", "German"), ("el", "Greek"), ("en", "English"), ("es", "Spanish"),
    ("et", "Estonian"), ("fa", "Persian"), ("fi", "Finnish"), ("fil", "Filipino"), ("fr", "French"), ("he", "Hebrew"), ("hi", "Hindi"), ("hr", "Croatian"), ("hu", "Hungarian"), ("id", "Indonesian"),
    ("it", "Italian"), ("ja", "Japanese"), ("ko", "Korean"), ("lt", "Lithuanian"), ("lv", "Latvian"), ("ms", "Malay"), ("nb", "Norwegian Bokmål"), ("nl", "Dutch"), ("no", "Norwegian"), ("pl", "Polish"),
    ("pt", "Portuguese"), ("ro", "Romanian"), ("ru", "Russian"), ("sk", "Slovak"), ("sl", "Slovenian"), ("sr", "Serbian"), ("sv", "Swedish"), ("sw", "Swahili"), ("ta", "Tamil"), ("te", "Telugu"),
    ("th", "Thai"), ("tr", "Turkish"), ("uk", "Ukrainian"), ("ur", "Urdu"), ("vi", "Vietnamese"), ("yue", "Cantonese"), ("zh", "Chinese"),
)
SUBTAGS = (
    ("cyrl", "Cyrillic"), ("hans", "Simplified"), ("hant", "Traditional"), ("latn", "Latin"),
    ("ar", "Argentina"), ("at", "Austria"), ("au", "Australia"), ("be", "Belgium"), ("br", "Brazil"), ("ca", "Canada"), ("ch", "Switzerland"), ("cn", "China"), ("de", "Germany"), ("es", "Spain"),
    ("fr", "France"), ("gb", "United Kingdom"), ("hk", "Hong Kong SAR China"), ("in", "India"), ("it", "Italy"), ("jp", "Japan"), ("kr", "South Korea"), ("mx", "Mexico"), ("nl", "Netherlands"), ("pt", "Portugal"),
    ("rs", "Serbia"), ("ru", "Russia"), ("se", "Sweden"), ("sg", "Singapore"), ("tw", "Taiwan"), ("us", "United States"), ("419", "Latin America"),
)


def plan_batches(lines: DataFrame, batch_lines: int, max_cont_lines: int) -> DataFrame:
    """batches (media_id, batch_ix, start_ix, end_ix, n_lines): ``batch_lines`` lines, and on while the last is continued.

    Where a batch ends decides where the next begins. A media's lines stream by in
    order with one flag each; only where the open batch began is held.
    """
    w = Window.partitionBy("media_id").orderBy("line_ix")
    # the window puts a media's lines into one task and in order
    flags = lines.select("media_id", "line_ix", F.coalesce(F.col("text").endswith(CONTINUE_FLAG), F.lit(False)).alias("more"), F.lag("line_ix").over(w).isNull().alias("opens"))
    kind = f"media_id {lines.schema['media_id'].dataType.simpleString()}, batch_ix long, start_ix long, end_ix long, n_lines long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the media at hand: its id, lines before this piece, first line's number, batches so far, first line of the open one
        media, seen, base, nth, begin = None, 0, 0, 0, 0

        def ended() -> list[tuple]:
            return [(media, nth, base + begin, base + seen - 1, seen - begin)] if seen > begin else []

        for batch in batches:
            out = []
            ids, line = batch.column("media_id"), batch.column("line_ix").to_numpy()
            more, opens = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("more", "opens"))
            starts = np.flatnonzero(opens)
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows], strict=True):
                if b <= a:
                    continue
                if opens[a]:
                    out += ended()
                    media, seen, base, nth, begin = ids[a].as_py(), 0, int(line[a]), 0, 0
                own = more[a:b]
                while True:
                    # the last line that the batch must have, and those that it goes on to
                    last = begin + batch_lines - 1
                    at = max(last - seen, 0)
                    while at < len(own) and own[at] and seen + at - last < max_cont_lines:
                        at += 1
                    if at >= len(own):
                        break
                    out.append((media, nth, base + begin, base + seen + at, seen + at - begin + 1))
                    nth, begin = nth + 1, seen + at + 1
                seen += len(own)
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, (ids.type, *[pa.int64()] * 4), strict=True)], names=["media_id", "batch_ix", "start_ix", "end_ix", "n_lines"])
        if out := ended():
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (ids.type, *[pa.int64()] * 4), strict=True)], names=["media_id", "batch_ix", "start_ix", "end_ix", "n_lines"])

    return flags.mapInArrow(cut, kind)


def batch_windows(lines: DataFrame, batches: DataFrame, discard_lines: int) -> DataFrame:
    """payload: each batch's lines and up to ``discard_lines`` more after it (``is_ahead``), with ``pos`` from 0."""
    span = batches.select("media_id", "batch_ix", "start_ix", "end_ix", F.explode(F.sequence("start_ix", F.col("end_ix") + discard_lines)).alias("line_ix"))
    x = span.join(lines, ["media_id", "line_ix"])
    return x.select("media_id", "batch_ix", (F.col("line_ix") - F.col("start_ix")).alias("pos"), "line_ix", (F.col("line_ix") > F.col("end_ix")).alias("is_ahead"), "text")


def batch_sizes(batches: DataFrame, discard_lines: int) -> DataFrame:
    """(media_id, batch_ix, n_asked): how many entries each batch's payload has, without its lines."""
    last = F.max("end_ix").over(Window.partitionBy("media_id"))
    return batches.select("media_id", "batch_ix", (F.least(F.col("end_ix") + discard_lines, last) - F.col("start_ix") + 1).alias("n_asked"))


def _asked(payload: DataFrame) -> DataFrame:
    """(media_id, batch_ix, n_asked) of a payload, or of ``batch_sizes``."""
    if "n_asked" in payload.columns:
        return payload.select("media_id", "batch_ix", "n_asked")
    return payload.groupBy("media_id", "batch_ix").agg(F.count("*").alias("n_asked"))


def one_row(text: Column) -> Column:
    """text with its line ends as override tags."""
    return F.replace(text, F.lit("\n"), F.lit("\\N"))


def _numbered_list(pos: str, text: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(pos, text.alias("t"))))
    return F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n")


def language_names(codes: DataFrame, dim: DataFrame, code: str = "code", subtags: tuple[tuple[str, str], ...] = SUBTAGS) -> DataFrame:
    """Add ``name``: the English name of the language tag, or the tag itself.

    A tag is cut from the right until ``dim`` (code, name) has it, whatever its
    letters' case; what is cut off follows in parentheses, by name where it is in
    ``subtags``.
    """
    tags = codes.select(F.col(code).alias("tag")).where("tag is not null").distinct().withColumn("parts", F.split("tag", "[-_]"))
    cut = tags.select("tag", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n")).withColumn("head", F.lower(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "-")))
    names = dim.select(F.lower("code").alias("head"), F.col("name").alias("dim_name"))
    known = cut.join(names, "head").groupBy("tag", "parts").agg(F.max(F.struct("n", "dim_name")).alias("hit"))
    by_tag = F.create_map(*[F.lit(x) for pair in subtags for x in pair])
    rest = F.transform(F.slice("parts", F.col("hit.n") + 1, F.size("parts")), lambda p: F.coalesce(F.try_element_at(by_tag, F.lower(p)), p))
    named = known.select(F.col("tag").alias("named_tag"), F.when(F.size(rest) > 0, F.concat("hit.dim_name", F.lit(" ("), F.array_join(rest, ", "), F.lit(")"))).otherwise(F.col("hit.dim_name")).alias("tag_name"))
    x = codes.join(named, F.col(code) == F.col("named_tag"), "left")
    return x.withColumn("name", F.coalesce("tag_name", F.col(code))).drop("named_tag", "tag_name")


def build_prompts(payload: DataFrame, contexts: DataFrame, translations: DataFrame, lang_from: str, lang_to: str, context_lines: int) -> DataFrame:
    """(media_id, batch_ix, n_entries, prompt): numbered entries, context and the last translated lines before the batch."""
    g = payload.groupBy("media_id", "batch_ix").agg(F.min("line_ix").alias("start_ix"), F.count("*").alias("n_entries"), _numbered_list("pos", one_row(F.col("text"))).alias("entries"))
    near = g.select("media_id", "batch_ix", F.explode(F.sequence(F.col("start_ix") - context_lines, F.col("start_ix") - 1)).alias("line_ix")).where("line_ix >= 0")
    past = near.join(translations.select("media_id", "line_ix", F.col("text").alias("said")), ["media_id", "line_ix"])
    past = past.groupBy("media_id", "batch_ix").agg(F.count("*").alias("n_past"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "said"))), lambda x: x["said"]), "\n").alias("past"))
    x = g.join(past, ["media_id", "batch_ix"], "left").join(contexts, "media_id", "left")
    return x.select("media_id", "batch_ix", "n_entries", prompt_text(lang_from, lang_to).alias("prompt"))


def prompt_text(lang_from: str, lang_to: str) -> Column:
    """The prompt of a row with ``context``, ``n_past`` and ``past`` (translated lines before it), ``n_entries`` and ``entries``."""
    before = F.when(F.col("n_past") > 0, F.format_string("The last %d translated entries were:\n%s\n\nGo on from there. ", "n_past", "past")).otherwise("")
    ask = F.format_string(f"Translate these %d {lang_from} subtitle entries to {lang_to}, as many and in this order:\n\n%s", "n_entries", "entries")
    return F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\n"), before, ask)


def system_prompt(lang_from: str, lang_to: str) -> str:
    """What a model is told about its role, for all batches alike."""
    return (
        f"You translate {lang_from} subtitles into natural spoken {lang_to}, freely and briefly, but keep what is meant. "
        "Answer with the translated entries alone: exactly as many as you are given, in the same order, none merged.\n"
        f"- {CONTINUE_FLAG} at the end of an entry says that its sentence goes on in the next one; leave it out of the translation.\n"
        "- Write a line break within an entry as \\N.\n"
        "- Emphasis, where needed, is written with tags such as {\\i1}italics{\\i0}.\n"
        f"- No {lang_to} word may run over from one entry into the next."
    )


def with_system(prompts: DataFrame, lang_from: str, lang_to: str) -> DataFrame:
    """prompts with ``system``."""
    return prompts.withColumn("system", F.lit(system_prompt(lang_from, lang_to)))


def build_context_prompts(lines: DataFrame, manifest: DataFrame, lang_from: str, lang_to: str) -> DataFrame:
    """(media_id, prompt): the whole transcript, for a summary and a glossary."""
    g = lines.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "text"))), lambda x: x["text"]), "\n").alias("body"))
    x = g.join(manifest.select("media_id", "path"), "media_id")
    head = f"Say in one sentence what this is and how good the transcript is, sum it up in four sentences, and list names and terms from {lang_from} to {lang_to} under the heading 'Glossary'.\n\nTranscript of "
    return x.select("media_id", F.concat(F.lit(head), "path", F.lit(":\n"), "body").alias("prompt"))


def build_retry_prompts(bad: DataFrame, payload: DataFrame, prompts: DataFrame, lang_from: str, lang_to: str, most_off: int = MOST_OFF) -> DataFrame:
    """(media_id, batch_ix, attempt, prompt): both numbered lists if the count is off by at most ``most_off``, else the first prompt again.

    ``bad`` has the entries (media_id, batch_ix, attempt, pos, entry) of responses with a wrong count.
    """
    said = bad.groupBy("media_id", "batch_ix", "attempt").agg(F.count("*").alias("n_said"), _numbered_list("pos", F.col("entry")).alias("said"))
    asked = payload.groupBy("media_id", "batch_ix").agg(F.count("*").alias("n_asked"), _numbered_list("pos", one_row(F.col("text"))).alias("asked"))
    x = said.join(asked, ["media_id", "batch_ix"]).join(prompts.select("media_id", "batch_ix", "prompt"), ["media_id", "batch_ix"])
    fix = retry_text(lang_from, lang_to, F.col("n_said"), F.col("n_asked"), F.col("asked"), F.col("said"))
    return x.select("media_id", "batch_ix", "attempt", F.when(F.abs(F.col("n_said") - F.col("n_asked")) <= most_off, fix).otherwise(F.col("prompt")).alias("prompt"))


def retry_text(lang_from: str, lang_to: str, n_said: Column, n_asked: Column, asked: Column, said: Column) -> Column:
    """The prompt that asks for the right count, from both numbered lists."""
    return F.format_string(f"Your translation had %d entries; exactly %d are needed.\n\n{lang_from} entries:\n%s\n\nYour {lang_to} entries:\n%s\n\nGive the same content in exactly %d entries.", n_said, n_asked, asked, said, n_asked)


def split_responses(responses: DataFrame) -> DataFrame:
    """entries (media_id, batch_ix, attempt, pos, entry): a response's lines."""
    return responses.select("media_id", "batch_ix", "attempt", F.posexplode(F.split(strip(F.col("response")), "\n")).alias("pos", "entry"))


def strip_numbering(entries: DataFrame) -> DataFrame:
    """Drop "N. " from the lines of responses whose first two lines are numbered 1 and 2."""
    number = F.regexp_extract("entry", NUMBER, 1).try_cast("long")
    w = Window.partitionBy("media_id", "batch_ix", "attempt")
    right = F.when((F.col("pos") < 2) & (number == F.col("pos") + 1), 1).otherwise(0)
    bare = F.when(F.col("entry").rlike(NUMBER), strip(F.regexp_replace("entry", NUMBER, ""))).otherwise(F.col("entry"))
    x = entries.withColumn("n_right", F.sum(right).over(w))
    return x.withColumn("entry", F.when(F.col("n_right") == 2, bare).otherwise(F.col("entry"))).drop("n_right")


def clean_ellipses(entries: DataFrame, mode: str = "intent") -> DataFrame:
    """Take out redundant "..." between adjacent lines.

    ``intent``: a pair at a line's end and the next one's start goes, and every
    line but the first loses a leading one. ``compat``: as a loop over
    neighbours that, where a line starts with "...", puts its rest in place of the
    next line.
    """
    key = ["media_id", "batch_ix", "attempt"]
    e = F.col("entry")
    if mode == "intent":
        w = Window.partitionBy(*key).orderBy("pos")
        pair = e.endswith("...") & F.coalesce(F.lead("entry").over(w).startswith("..."), F.lit(False))
        cut = F.expr("case when pos > 0 and startswith(entry, '...') then substring(entry, 4) else entry end")
        x = entries.withColumn("pair", pair).withColumn("entry", cut)
        return x.withColumn("entry", F.when(F.col("pair") & e.endswith("..."), F.expr("left(entry, length(entry) - 3)")).otherwise(e)).drop("pair")
    if mode != "compat":
        raise ValueError(mode)
    g = entries.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("rows"))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.element_at("rows", 1).alias("cur"))

    def step(s: Column, following: Column) -> Column:
        cur = s["cur"]
        pair = cur.endswith("...") & following.startswith("...")
        left = F.when(pair, F.substring(cur, F.lit(1), F.length(cur) - 3)).otherwise(cur)
        nxt = F.when(pair, F.substring(following, 4, 1 << 30)).otherwise(following)
        nxt = F.when(cur.startswith("..."), F.substring(cur, 4, 1 << 30)).otherwise(nxt)
        nxt = F.when(following.startswith("..."), F.substring(following, 4, 1 << 30)).otherwise(nxt)
        return F.struct(F.concat(s["out"], F.array(left)).alias("out"), nxt.alias("cur"))

    folded = F.aggregate(F.slice("rows", 2, 1 << 30), start, step, lambda s: F.concat(s["out"], F.array(s["cur"])))
    return g.select(*key, F.posexplode(folded).alias("pos", "entry"))


def check_counts(entries: DataFrame, payload: DataFrame, retries: int, most_off: int = MOST_OFF) -> DataFrame:
    """(media_id, batch_ix, attempt, n_said, n_asked, status, is_used) of each attempt.

    ``ok``; ``retry_fix`` (off by at most ``most_off``) or ``retry_plain``; after
    the last allowed attempt ``fallback``. The first ok attempt is used.
    """
    said = entries.groupBy("media_id", "batch_ix", "attempt").agg(F.count("*").alias("n_said"))
    x = said.join(_asked(payload), ["media_id", "batch_ix"])
    off = F.abs(F.col("n_said") - F.col("n_asked"))
    status = F.when(off == 0, "ok").when(F.col("attempt") + 1 >= retries, "fallback").when(off <= most_off, "retry_fix").otherwise("retry_plain")
    w = Window.partitionBy("media_id", "batch_ix").orderBy(F.when(off == 0, 0).otherwise(1), "attempt")
    return x.withColumn("status", status).withColumn("is_used", (F.row_number().over(w) == 1) & (F.col("status") == "ok"))


def force_counts(entries: DataFrame, payload: DataFrame) -> DataFrame:
    """Exactly as many entries as asked: what is over goes into the last, what lacks is marked as missing."""
    key = ["media_id", "batch_ix"]
    asked = _asked(payload).withColumnRenamed("n_asked", "n")
    had = entries.select(*key, "attempt").distinct()
    places = had.join(asked, key).select(*key, "attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    x = entries.join(asked, key).withColumn("slot", F.least(F.col("pos").cast("long"), F.col("n") - 1))
    x = x.groupBy(*key, "attempt", F.col("slot").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda r: r["entry"]), "\\N").alias("entry"))
    return places.join(x, [*key, "attempt", "pos"], "left").select(*key, "attempt", "pos", F.coalesce("entry", F.lit(MISSING_TRANSLATION)).alias("entry"))


def drop_lookahead(entries: DataFrame, batches: DataFrame) -> DataFrame:
    """(media_id, line_ix, text): a batch's own entries at their lines."""
    x = entries.join(batches.select("media_id", "batch_ix", "start_ix", "n_lines"), ["media_id", "batch_ix"]).where("pos < n_lines")
    return x.select("media_id", (F.col("start_ix") + F.col("pos")).alias("line_ix"), F.col("entry").alias("text"))


def pending_lines(lines: DataFrame, translations: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Lines still to be translated, in the range if one is given."""
    x = lines.join(translations.select("media_id", "line_ix"), ["media_id", "line_ix"], "left_anti").select(*lines.columns)
    if ranges is not None:
        x = x.join(ranges, "media_id").where("line_ix between lo_ix and hi_ix").select(*lines.columns)
    return x


def replace_lines(lines: DataFrame, texts: DataFrame, idx: int = 0) -> DataFrame:
    """Overwrite texts from line ``idx`` on with (media_id, pos, text); more texts than lines is an error."""
    n = lines.groupBy("media_id").agg(F.count("*").alias("n_all"))
    new = texts.join(n, "media_id").select("media_id", F.when(F.col("pos") + idx >= F.col("n_all"), F.raise_error(F.lit("more texts than lines")).cast("long")).otherwise(F.col("pos") + idx).alias("line_ix"), F.col("text").alias("new_text"))
    x = lines.join(new, ["media_id", "line_ix"], "left")
    return x.withColumn("text", F.coalesce("new_text", "text")).select(*lines.columns)


# Marks of emphasis and the tags that stand for them.
_MARKDOWN = (("bold_italic", r"\*\*\*(.+?)\*\*\*", r"{\\b1}{\\i1}$1{\\i0}{\\b0}"), ("bold", r"\*\*(.+?)\*\*", r"{\\b1}$1{\\b0}"), ("italic", r"(?<!\*)\*([^*]+?)\*(?!\*)", r"{\\i1}$1{\\i0}"))


def md_to_ass(lines: DataFrame) -> DataFrame:
    """Markdown emphasis to override tags, with the numbers of replacements; texts that have tags are left."""
    done = F.contains(F.col("text"), F.lit("{\\i1}")) | F.contains(F.col("text"), F.lit("{\\b1}"))
    x = lines.withColumn("tagged", done)
    for name, pattern, tags in _MARKDOWN:
        n = F.when(F.col("tagged"), 0).otherwise(F.regexp_count("text", F.lit(pattern)))
        x = x.withColumn(f"n_{name}", n.cast("long")).withColumn("text", F.when(F.col("tagged"), F.col("text")).otherwise(F.regexp_replace("text", pattern, tags)))
    return x.drop("tagged")


def text_to_lines(texts: DataFrame, lines: DataFrame, prepend: DataFrame | None = None) -> DataFrame:
    """Lines with the times of ``lines`` and the texts (media_id, pos, text) of the same position, after those of ``prepend``."""
    new = lines.drop("text").join(texts.select("media_id", F.col("pos").alias("line_ix"), "text"), ["media_id", "line_ix"]).select(*lines.columns)
    if prepend is None:
        return new
    both = prepend.withColumn("after", F.lit(0)).unionByName(new.withColumn("after", F.lit(1)))
    w = Window.partitionBy("media_id").orderBy("after", "line_ix")
    return both.withColumn("line_ix", (F.row_number().over(w) - 1).cast("long")).select(*lines.columns)


def apply_model(requests: DataFrame, call: Callable[[list[str]], list[str]], retries: int = 20, partitions: int | None = None, batch: int = 16, sleep: Callable[[float], None] = time.sleep, store: AnswerStore | None = None) -> DataFrame:
    """requests with ``response``: each distinct prompt is asked once.

    A lost connection is tried again after ``min(5 * attempt, 65)`` seconds, an
    overloaded service after 2; other errors fail the job. With a ``store`` answers
    are kept before they are joined, and only missing ones are asked for (its own
    settings then hold); without one a plan that is run twice asks twice.
    """
    if store is not None:
        return store.ask(requests, lambda rows: call([r["prompt"] for r in rows]))
    asked = requests.select("prompt").distinct()
    asked = asked.repartition(partitions or max(1, requests.sparkSession.sparkContext.defaultParallelism), "prompt")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said: list[str] = []
            prompts = part["prompt"].tolist()
            for at in range(0, len(prompts), batch):
                said += patiently(lambda at=at, prompts=prompts: call(prompts[at : at + batch]), retries, sleep)
            yield part.assign(response=said)

    return requests.join(asked.mapInPandas(run, "prompt string, response string"), "prompt", "left").select(*requests.columns, "response")


def route_models(requests: DataFrame, routes: tuple[tuple[str, str], ...] = LLM_ROUTES) -> tuple[DataFrame, DataFrame]:
    """(requests with ``provider``, requests that no pattern fits): the first pattern in the model's name decides."""
    model = F.lower("model")
    provider = F.lit(None).cast("string")
    for pattern, name in reversed(routes):
        provider = F.when(F.contains(model, F.lit(pattern)), name).otherwise(provider)
    x = requests.withColumn("provider", provider)
    return x.where("provider is not null"), x.where("provider is null").drop("provider")


def translate(lines: DataFrame, responses: DataFrame, params: Params, mode: str = "intent") -> DataFrame:
    """lines with the texts of the responses: batches, clean-up, counts, placing, emphasis."""
    batches = plan_batches(lines, params.batch_lines, params.max_cont_lines)
    payload = batch_sizes(batches, params.discard_lines)
    entries = clean_ellipses(strip_numbering(split_responses(responses)), mode)
    status = check_counts(entries, payload, params.translate_retries)
    # the first good attempt of a batch, or else its last, made to fit
    w = Window.partitionBy("media_id", "batch_ix").orderBy(F.desc("is_used"), F.desc("attempt"))
    chosen = status.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("media_id", "batch_ix", "attempt")
    fitted = force_counts(entries.join(chosen, ["media_id", "batch_ix", "attempt"], "left_semi"), payload)
    texts = drop_lookahead(fitted, batches).withColumnRenamed("text", "new_text")
    x = lines.join(texts, ["media_id", "line_ix"], "left").withColumn("text", F.coalesce("new_text", "text")).select(*lines.columns)
    return md_to_ass(x).select(*lines.columns)
