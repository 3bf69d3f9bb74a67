"""The library's tables derived from the driver's tables by whole-number arithmetic, in Spark and (for SQL) in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.schema import CONTINUE_FLAG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media a user; short gaps, five styles, whole texts, one in nine empty."""
    return spark.sql(
        """SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1L AS line_ix,
             unix_micros(CAST(ts AS timestamp)) DIV 1000 AS start_ms,
             unix_micros(CAST(ts AS timestamp)) DIV 1000 + CAST(floor(value * 10) AS bigint) AS end_ms,
             event_type AS style, CASE WHEN event_id % 9 = 0 THEN '' ELSE props END AS text, 'Unknown' AS speaker
           FROM {events}""",
        events=table(spark, sf_dir, "events"),
    )


def talk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media a conversation; real texts."""
    return spark.sql(
        """WITH b AS (SELECT conv_id AS media_id, CAST(turn AS bigint) AS line_ix, role AS style, text,
               CASE WHEN (conv_id*7 + turn*13) % 5 < 2 THEN (turn*17) % 101 ELSE length(text)*60 END AS dur,
               (conv_id*31 + turn*19) % 4 * 700 AS gap FROM {conversations}),
           q AS (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY media_id ORDER BY line_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b)
           SELECT media_id, line_ix, CAST(s + gap AS bigint) AS start_ms, CAST(s + gap + dur AS bigint) AS end_ms, style, text, 'Unknown' AS speaker FROM q""",
        conversations=table(spark, sf_dir, "conversations"),
    )


def continued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk_lines(spark, sf_dir).withColumn("text", F.when((F.col("media_id") + F.col("line_ix")) % 3 == 0, F.concat("text", F.lit(CONTINUE_FLAG))).otherwise(F.col("text")))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media a document, one segment a line; words and spacing in turn, some long pauses.

    Texts are dealt out by media before they fall into words: that takes a tenth of what
    words with their times take, and what follows by media, segment or chunk finds them
    where they belong. Parts that are small as texts are large as words, so there are
    four times as many as else: sorted as words, a part then fits the memory of its task.
    """
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(
        r"""WITH t AS (SELECT doc_id AS media_id, seg_ix, word_ix, word AS text, CASE WHEN trim(word) = '' THEN 'spacing' ELSE 'word' END AS type
              FROM (SELECT doc_id, seg_ix, posexplode(regexp_extract_all(seg, '(\\S+|\\s+)', 1)) AS (word_ix, word)
                    FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (seg_ix, seg) FROM {documents}))),
            v AS (SELECT *, CASE WHEN type='spacing' THEN 0 ELSE length(text)*60 + (word_ix*7)%50 END AS d,
                     CASE WHEN type='spacing' THEN 0 WHEN (media_id*3 + seg_ix*5 + word_ix)%23 = 0 THEN 2500 WHEN (media_id + word_ix)%7 = 0 THEN 300 ELSE 0 END AS g FROM t),
            w AS (SELECT *, coalesce(sum(d + g) OVER (PARTITION BY media_id ORDER BY seg_ix, word_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v)
            SELECT media_id, seg_ix AS segment_ix, word_ix, text, CAST(b + g AS bigint) / 1000.0D AS start, CAST(b + g + d AS bigint) / 1000.0D AS `end`, type,
                   concat('S', CAST((media_id + seg_ix) % 3 AS string)) AS speaker, CAST(NULL AS double) AS confidence FROM w""",
        documents=table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts, "doc_id"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page: paths with all kinds of suffixes, codecs, sizes."""
    return spark.sql(
        """SELECT page_id AS media_id,
             CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN concat('/in/m', page_id, '.MP4') WHEN 2 THEN concat('/in/m', page_id, '.flac') WHEN 3 THEN concat('/in/m', page_id, '.raw.json')
               WHEN 4 THEN concat('/in/m', page_id, '.fixed.en.ass') WHEN 5 THEN concat('/in/m', page_id, '.context.txt') WHEN 6 THEN concat('/in/m', page_id, '.jpeg')
               WHEN 7 THEN concat('/in/m', page_id, '.tr_custom.srt') WHEN 8 THEN concat('/in/m', page_id) ELSE concat('/in/a.b/m', page_id, '.padded.xyz') END AS path,
             CASE page_id % 7 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' WHEN 2 THEN 'pcm_s16le' WHEN 3 THEN 'mp3' WHEN 4 THEN 'eac3' WHEN 5 THEN 'wmav2' ELSE 'vorbis' END AS codec,
             length(html) * 50000L AS size_bytes, length(html) * 6 / 100.0D AS duration_s
           FROM {pages}""",
        pages=table(spark, sf_dir, "pages"),
    )


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of five lines in each conversation; some reach past the end."""
    return talk_lines(spark, sf_dir).select("media_id").distinct().select("media_id", (F.col("media_id") % 3).alias("lo_ix"), (F.col("media_id") % 3 + 4).alias("hi_ix"))


def raised(text: str) -> Column:
    """Vowels in upper case, the same in every engine."""
    return F.translate(text, "aeiou", "AEIOU")


def replies(payload: DataFrame) -> DataFrame:
    """Two attempts of a response for each batch: texts with raised vowels, numbered, short or long by batch."""
    row = F.replace(raised("text"), F.lit("\n"), F.lit("\\N"))
    g = payload.groupBy("media_id", "batch_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("t")))), lambda x: x["t"]).alias("rows"))
    numbered = F.transform("rows", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    kind = F.col("batch_ix") % 4
    first = F.when(kind == 1, numbered).when(kind == 2, F.slice("rows", F.lit(1), F.greatest(F.size("rows") - 1, F.lit(1)))).when(kind == 3, F.concat("rows", F.array(F.lit("ONE MORE")))).otherwise(F.col("rows"))
    again = F.when(F.col("media_id") % 2 == 0, F.col("rows")).otherwise(first)
    two = F.array(F.struct(F.lit(0).alias("attempt"), first.alias("r")), F.struct(F.lit(1).alias("attempt"), again.alias("r")))
    return g.select("media_id", "batch_ix", F.explode(two).alias("x")).select("media_id", "batch_ix", "x.attempt", F.array_join("x.r", "\n").alias("response"))


_RAISE = str.maketrans("aeiou", "AEIOU")


def flawed_model(rows: list[dict]) -> list[str]:
    """A translator with raised vowels that errs by the length of a batch's first entry.

    Of four lengths one is answered as it should be, one numbered, one an entry
    short and one an entry over. Asked again, the first model keeps to its error
    at two lengths in eight, the second one at two in sixteen.
    """
    said = []
    for r in rows:
        prompt = r["prompt"]
        if " entries; exactly " in prompt:
            asked = prompt.split(" entries:\n", 1)[1].split("\n\nYour ", 1)[0]
        else:
            asked = prompt.rsplit("\n\n", 1)[1]
        first = asked.split("\n", 1)[0].split(". ", 1)[1]
        texts = [x.split(". ", 1)[1].replace(CONTINUE_FLAG, "").translate(_RAISE) for x in asked.split("\n")]
        kind = len(first) % 4 if r["attempt"] == 0 else len(first) % 8 if r["model"] == "first" else len(first) % 16
        if kind == 1 and r["attempt"] == 0:
            texts = [f"{i + 1}. {x}" for i, x in enumerate(texts)]
        elif kind == 2:
            texts = texts[: max(len(texts) - 1, 1)]
        elif kind == 3:
            texts.append("ONE MORE")
        said.append("\n".join(texts))
    return said


def talk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media a conversation, one segment a turn: words and spacing in turn, a tenth of a second each, some long pauses."""
    return spark.sql(
        r"""WITH t AS (SELECT conv_id AS media_id, CAST(turn AS int) AS segment_ix, posexplode(regexp_extract_all(text, '(\\S+|\\s+)', 1)) AS (word_ix, text) FROM {conversations}),
            v AS (SELECT *, CASE WHEN text RLIKE '^\\s' THEN 0 WHEN (media_id + segment_ix) % 4 = 0 THEN 1 ELSE length(text) * 60 END AS d, CASE WHEN (media_id + word_ix) % 37 = 0 THEN 2500 ELSE 0 END AS g FROM t),
            w AS (SELECT *, coalesce(sum(d + g) OVER (PARTITION BY media_id ORDER BY segment_ix, word_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v)
            SELECT media_id, segment_ix, word_ix, text, CAST(b + g AS bigint) / 1000.0D AS start, CAST(b + g + d AS bigint) / 1000.0D AS `end`,
                   CASE WHEN text RLIKE '^\\s' THEN 'spacing' ELSE 'word' END AS type, concat('S', CAST(segment_ix % 2 AS string)) AS speaker, CAST(NULL AS double) AS confidence FROM w""",
        conversations=table(spark, sf_dir, "conversations"),
    )


def words_again(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """What a speech service would give for each cut: the words of its lines, timed anew from 0."""
    rows = cuts.select("media_id", "group_ix", F.explode(F.sequence("start_ix", "end_ix")).alias("line_ix")).join(lines, ["media_id", "line_ix"])
    w = rows.select("media_id", "group_ix", F.col("line_ix").cast("int").alias("segment_ix"), "line_ix", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+|\s+)"))).alias("word_ix", "text"))
    at = F.col("word_ix") * 100 / F.lit(1000.0) + F.col("line_ix")
    return w.select("media_id", "group_ix", "segment_ix", "word_ix", "text", at.alias("start"), (at + 0.1).alias("end"), F.when(F.col("text").rlike(r"^\s"), "spacing").otherwise("word").alias("type"), F.lit("Default").alias("speaker"), F.lit(None).cast("double").alias("confidence"))


def segmented_docs(words: DataFrame) -> DataFrame:
    """Documents of the segmented dialect, segment texts with their spacing, as services give them; one in fifty lacks its words."""
    item = F.struct("word_ix", "text", "start", "end", "speaker", "type")
    seg = words.groupBy("media_id", "segment_ix").agg(F.array_sort(F.collect_list(item)).alias("ws"))
    spoken = F.filter("ws", lambda w: w["type"] == "word")
    seg = seg.select("media_id", "segment_ix", F.array_join(F.transform("ws", lambda w: w["text"]), "").alias("text"), F.transform(spoken, lambda w: F.struct(w["text"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["speaker"].alias("speaker_id"))).alias("ws"))
    row = F.struct("segment_ix", F.element_at("ws", 1)["start"].alias("start"), F.element_at("ws", -1)["end"].alias("end"), "text", "ws")
    media = seg.where(F.size("ws") > 0).groupBy("media_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    segments = F.transform("s", lambda x: F.struct(x["segment_ix"].cast("long").alias("id"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    named = F.when(F.col("media_id") % 50 != 49, F.flatten(F.transform("s", lambda x: x["ws"])))
    doc = F.struct(F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), F.element_at("s", -1)["end"].alias("duration"), segments.alias("segments"), named.alias("words"))
    return media.select("media_id", F.to_json(doc).alias("doc"))


def diarised_docs(words: DataFrame) -> DataFrame:
    """Documents of the diarised dialect; even media have the segmented form in them."""
    w = lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["speaker"].alias("speaker_id"), F.lit(-0.5).alias("logprob"))
    seg = words.groupBy("media_id", "segment_ix").agg(F.array_sort(F.collect_list(F.struct("word_ix", "text", "start", "end", "type", "speaker"))).alias("ws"))
    g = seg.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("segment_ix", "ws"))).alias("s"))
    content = F.to_json(F.struct(F.transform("s", lambda s: F.struct(F.transform(s["ws"], w).alias("words"))).alias("segments")))
    extra = F.when(F.col("media_id") % 2 == 0, F.array(F.struct(F.lit("segmented_json").alias("requested_format"), content.alias("content"))))
    return g.select("media_id", F.to_json(F.struct(F.transform(F.flatten(F.transform("s", lambda s: s["ws"])), w).alias("words"), extra.alias("additional_formats"))).alias("doc"))


# DuckDB forms of the same tables, as WITH entries.
EVENT_LINES_SQL = """lines AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_ix,
  epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 10) AS bigint) AS end_ms,
  event_type AS style, CASE WHEN event_id % 9 = 0 THEN '' ELSE props END AS text, 'Unknown' AS speaker FROM events)"""
TALK_LINES_SQL = """lines AS (SELECT media_id, line_ix, CAST(s + gap AS bigint) AS start_ms, CAST(s + gap + dur AS bigint) AS end_ms, style, text, 'Unknown' AS speaker FROM (
  SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY media_id ORDER BY line_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
    SELECT conv_id AS media_id, CAST(turn AS bigint) AS line_ix, role AS style, text, CASE WHEN (conv_id*7 + turn*13) % 5 < 2 THEN (turn*17) % 101 ELSE length(text)*60 END AS dur,
           (conv_id*31 + turn*19) % 4 * 700 AS gap FROM conversations) b) q)"""
CONTINUED_LINES_SQL = TALK_LINES_SQL.replace("style, text, 'Unknown'", "style, CASE WHEN (media_id + line_ix) % 3 = 0 THEN text || '%%CONT%%' ELSE text END AS text, 'Unknown'", 1)
WORDS_SQL = r"""words AS (SELECT media_id, CAST(seg_ix AS int) AS segment_ix, CAST(word_ix AS int) AS word_ix, text, CAST(b + g AS bigint) / 1000.0::DOUBLE AS start, CAST(b + g + d AS bigint) / 1000.0::DOUBLE AS "end", type,
    concat('S', CAST((media_id + seg_ix) % 3 AS varchar)) AS speaker
  FROM (SELECT *, coalesce(sum(d + g) OVER (PARTITION BY media_id ORDER BY seg_ix, word_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
    FROM (SELECT *, CASE WHEN type='spacing' THEN 0 ELSE length(text)*60 + (word_ix*7)%50 END AS d,
                 CASE WHEN type='spacing' THEN 0 WHEN (media_id*3 + seg_ix*5 + word_ix)%23 = 0 THEN 2500 WHEN (media_id + word_ix)%7 = 0 THEN 300 ELSE 0 END AS g
      FROM (SELECT doc_id AS media_id, seg_ix, word_ix, word AS text, CASE WHEN trim(word) = '' THEN 'spacing' ELSE 'word' END AS type
        FROM (SELECT doc_id, seg_ix - 1 AS seg_ix, unnest(range(len(w))) AS word_ix, unnest(w) AS word
          FROM (SELECT doc_id, seg_ix, regexp_extract_all(seg, '(\S+|\s+)') AS w
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS seg, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seg_ix FROM documents)))) y) x) v)"""
TALK_WORDS_SQL = r"""words AS (SELECT media_id, segment_ix, word_ix, text, CAST(b + g AS bigint) / 1000.0::DOUBLE AS start, CAST(b + g + d AS bigint) / 1000.0::DOUBLE AS "end", CASE WHEN trim(text, ' ' || chr(9) || chr(10)) = '' THEN 'spacing' ELSE 'word' END AS type,
    concat('S', CAST(segment_ix % 2 AS varchar)) AS speaker
  FROM (SELECT *, coalesce(sum(d + g) OVER (PARTITION BY media_id ORDER BY segment_ix, word_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
    FROM (SELECT *, CASE WHEN trim(text, ' ' || chr(9) || chr(10)) = '' THEN 0 WHEN (media_id + segment_ix) % 4 = 0 THEN 1 ELSE length(text) * 60 END AS d, CASE WHEN (media_id + word_ix) % 37 = 0 THEN 2500 ELSE 0 END AS g
      FROM (SELECT media_id, segment_ix, CAST(unnest(range(len(w))) AS int) AS word_ix, unnest(w) AS text
        FROM (SELECT conv_id AS media_id, CAST(turn AS int) AS segment_ix, regexp_extract_all(text, '(\S+|\s+)') AS w FROM conversations))) x) v)"""
MANIFEST_SQL = """manifest AS (SELECT page_id AS media_id,
  CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN concat('/in/m', page_id, '.MP4') WHEN 2 THEN concat('/in/m', page_id, '.flac') WHEN 3 THEN concat('/in/m', page_id, '.raw.json')
    WHEN 4 THEN concat('/in/m', page_id, '.fixed.en.ass') WHEN 5 THEN concat('/in/m', page_id, '.context.txt') WHEN 6 THEN concat('/in/m', page_id, '.jpeg')
    WHEN 7 THEN concat('/in/m', page_id, '.tr_custom.srt') WHEN 8 THEN concat('/in/m', page_id) ELSE concat('/in/a.b/m', page_id, '.padded.xyz') END AS path,
  CASE page_id % 7 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' WHEN 2 THEN 'pcm_s16le' WHEN 3 THEN 'mp3' WHEN 4 THEN 'eac3' WHEN 5 THEN 'wmav2' ELSE 'vorbis' END AS codec,
  length(html) * 50000 AS size_bytes, length(html) * 6 / 100.0::DOUBLE AS duration_s FROM pages)"""
RANGES_SQL = "ranges AS (SELECT DISTINCT media_id, media_id % 3 AS lo_ix, media_id % 3 + 4 AS hi_ix FROM lines)"
