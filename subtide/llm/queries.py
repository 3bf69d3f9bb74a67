"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import contamination, language_id, line_dedup, mixing, ngram_jaccard, packing, periodic_runs, quality, substring_dedup, token_counts, topk, toxicity, whitening


#: Lengths are counted with this public tokenizer.
TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_: Column, n: int) -> Column:
    return F.crc32(id_.cast("string")) % n


def held_out(id_: Column, n: int, rest: int) -> Column:
    """Whether a row is kept from learning; a row without an id is in no fold that learns."""
    return F.coalesce(fold(id_, n) == rest, F.lit(True)).alias("held_out")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are tokens."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)
    return packing.pack_lengths(counts, F.col("n_tokens"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = language_id.identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0), "lang_pred", "score", "n_spans", "spans")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled rows of docs outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id"), 3) != 1)
    # at most about LABEL_ROWS labels, so the documents stay where they are
    return toxicity.train(docs.select("doc_id", "text").join(F.broadcast(toxicity.sample_labels(labels)), "doc_id"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_sentences", "n_offending", "offending")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, TOKENIZER, limit=4096)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_passages(table(spark, sf_dir, "documents"), keep_text=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.sha2("text", 256).alias("kept_sha256"), "n_lines_removed", "n_words_removed", "emptied")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), keep_text=False)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
b AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
g AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
              length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
              translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l1 WHERE k > 0),
l3 AS (SELECT *, dup OR 10 * symbols > chars OR position(right(s, 1) IN 'TERMINAL') = 0
              OR (k <= NAV_WORDS AND regexp_matches(low, 'NAV_PATTERN')) OR regexp_matches(low, 'BOILERPLATE_PATTERN') AS fails FROM l2),
l AS (SELECT doc_id, CAST(sum(CASE WHEN dup THEN 1 ELSE 0 END) AS BIGINT) AS n_dup_lines, CAST(sum(CASE WHEN fails THEN k ELSE 0 END) AS BIGINT) AS n_lost_words,
             CAST(sum(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS n_lost_lines FROM l3 GROUP BY doc_id),
f AS (SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(n_lost_words, 0) AS n_lost_words, coalesce(n_lost_lines, 0) AS n_lost_lines
      FROM b LEFT JOIN rw ON b.doc_id = rw.doc_id LEFT JOIN l ON b.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept, n_lost_words, n_lost_lines FROM f
""".replace("TERMINAL", quality.TERMINAL.replace("'", "''")).replace("NAV_WORDS", str(quality.NAV_WORDS)).replace("NAV_PATTERN", quality.NAV_PATTERN).replace("BOILERPLATE_PATTERN", quality.BOILERPLATE_PATTERN)

def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(g, ' ')) AS g FROM (
        SELECT doc_id, w[i:i+3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
        UNION ALL SELECT doc_id, list_append(w, 'fewer') AS g FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON d.doc_id = c.node
"""

def planted(id_: Column, text: Column) -> Column:
    """text, of which in one document in ten (by crc32 of the id) the words from a certain one on repeat with a certain period."""
    h = F.crc32(id_.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), again), " ")).otherwise("")

    # a lambda over one value, so that the words are found once
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), repeat), 1)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = periodic_runs.find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), keep_text=False)
    # least first: greater length / period, compared crosswise, then smaller start, then smaller period
    order = lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).when(x["length"] * y["period"] < y["length"] * x["period"], 1).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    best = F.try_element_at(F.array_sort("runs", order), F.lit(1))
    lists = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lists = F.when(F.size("runs") > 0, F.concat(lists, F.lit("\n"))).otherwise("")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lists, 256).alias("runs_sha256"), "collapsed_sha256")
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontamination": op12_decontamination,
    "op13_embedding_whitening": op13_embedding_whitening,
}
SQL = {"op12_decontamination": contamination.HITS_SQL, "op7_line_dedup": line_dedup.LINES_SQL, "op10_ngram_jaccard": OP10_SQL, "op6_substring_dedup": substring_dedup.PASSAGES_SQL, "op5_exact_top_k": topk.TOP_K_SQL, "op8_source_mixing": mixing.MIX_SQL, "op9_quality_rules": OP9_SQL}
