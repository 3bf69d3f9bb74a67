"""Mix sources to target weights by systematic sampling (DataFrame functions only).

A source's target is its share of the total size by weight, at most
``max_repeat`` times the source's size; the excess goes to the other sources by
weight until none is above. Within a source every document expects
``target / source_size`` copies. Those are prefix-summed in order of size, one
random offset a source is added, and a document is emitted once for each integer
boundary that its step crosses. In order of size every range of sizes gets its
share, so the words taken come near the target.

Rows are numbered in cells (source, size, salt) of about ``cell_rows`` rows, so
no source, and no common size, is sorted in one task; only the cells' counts are
prefix-summed over a source. Salts are ranges of the digest, so the numbers are
the same for any ``cell_rows``. Sources themselves (one row each) are ranked in one
window.

Defined results: a null text has size 0; sources go by code point with null
last; a source of size 0 has target 0 and gives no copies; repeated rows and
equal or null ids are rows of their own, in order of a hash of all their columns
where sizes and ids are equal; an empty table gives an empty table;
other columns pass through ``mix_rows``, and helper columns avoid their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subtide.llm._tables import fits, unused, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
CELL_ROWS = 50_000
BROADCAST_CELLS = 200_000


def n_words(text: Column) -> Column:
    """Number of runs outside [\\x20\\x09-\\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source with a mark before it, so that null is a value too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(key, source_size, target) from (key, size): one row a source.

    Caps in closed form: by rising cap a unit of weight, a source is capped if
    its cap is at most its share of what is left once those before it have theirs.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("key") == "null", "key")
    pick = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_repeat)
    every = Window.partitionBy()
    below = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
    per = per.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
    per = per.withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_size"))
    free_size = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    share = (F.col("weight") * free_size).cast("double") / free_weight.cast("double")
    return per.select("key", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def offset_of(key: Column, seed: int) -> Column:
    """One offset in [0, 1) for a source, the same at each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def row_digest(id_: Column) -> Column:
    return F.md5(F.coalesce(id_.cast("string"), F.lit("")))


def salt_of(digest: Column, n_salts: Column) -> Column:
    """The range of digests, of ``n_salts`` equal ones, so that order by (salt, digest) is order by digest."""
    return F.shiftrightunsigned(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * n_salts, 32)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast where it has few enough rows."""
    return F.broadcast(df) if fits(df, BROADCAST_CELLS) else df


def salted(rows: DataFrame, hot: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """rows with ``c_salt``: 0, or in the (key, size) of ``hot`` the range of the row's digest."""
    side = small(hot).withColumnsRenamed({"key": "h_key", "size": "h_size"})
    rows = rows.join(side, (rows[key] == side["h_key"]) & (rows[size] == side["h_size"]), "left")
    salt = F.coalesce(salt_of(F.col(digest), F.col("n_salts")), F.lit(0).cast("long"))
    return rows.withColumn("c_salt", salt).drop("h_key", "h_size", "n_salts")


def cell_facts(light: DataFrame, weights: tuple[int, ...], max_repeat: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """What each row needs to know, from (key, size, digest).

    The first table, (key, size, n_salts), has the sizes that are split. The second,
    (f_key, f_size, f_salt, before, source_size, target), has one row a cell:
    ``before`` is the number of rows of the source that stand before it.
    """
    sizes = written(light.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-counts")
    targets = source_targets(sizes.select("key", (F.col("size") * F.col("n")).alias("size")), weights, max_repeat)
    hot = written(sizes.where(F.col("n") > cell_rows).select("key", "size", F.ceil(F.col("n") / cell_rows).cast("long").alias("n_salts")), "mix-hot")
    split = salted(light.join(small(hot.drop("n_salts")), ["key", "size"], "left_semi"), hot, "key", "size", "digest")
    split = split.groupBy("key", "size", "c_salt").agg(F.count("*").alias("n"))
    whole = sizes.where(F.col("n") <= cell_rows).select("key", "size", F.lit(0).cast("long").alias("c_salt"), "n")
    order = Window.partitionBy("key").orderBy("size", "c_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = whole.unionByName(split).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    cells = cells.join(targets, "key").withColumnsRenamed({"key": "f_key", "size": "f_size", "c_salt": "f_salt"})
    return hot, written(cells, "mix-cells")


def with_copies(rows: DataFrame, hot: DataFrame, facts: DataFrame, key: str, size: str, digest: str, seed: int) -> DataFrame:
    """rows with the facts of their cell and ``c_copies``; ``rows`` has the three named columns."""
    rows = salted(rows, hot, key, size, digest)
    side = small(facts)
    rows = rows.join(side, (rows[key] == side["f_key"]) & (rows[size] == side["f_size"]) & (rows["c_salt"] == side["f_salt"]))
    number = F.row_number().over(Window.partitionBy(key, size, "c_salt").orderBy(digest))
    rows = rows.withColumn("c_at", F.col("before") + number)
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset_of(F.col(key), seed)
    return rows.withColumn("c_copies", (F.floor(u + step * F.col("c_at")) - F.floor(u + step * (F.col("c_at") - 1))).cast("long"))


def mix_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 7, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, size, source_size, target, taken) for each document, without its text."""
    light = written(docs.select(F.col(id_col).alias("id"), n_words(F.col(text_col).cast("string")).alias("size"), source_key(F.col(source_col)).alias("key")).withColumn("digest", row_digest(F.col("id"))), "mix-sizes")
    hot, facts = cell_facts(light, weights, max_repeat, cell_rows)
    out = with_copies(light, hot, facts, "key", "size", "digest", seed)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("c_copies")).alias("taken"))


def mix_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 7, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, with the columns of docs."""
    names = [unused(docs, x) for x in ("mix_id", "mix_size", "mix_key", "mix_digest")]
    nested = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias(names[0]), n_words(docs[text_col].cast("string")).alias(names[1]), source_key(docs[source_col]).alias(names[2]))
    # rows of one id go by their contents, so that reruns agree on the copies
    nested = nested.withColumn(names[3], F.concat(row_digest(F.col(names[0])), F.md5(F.to_json("row"))))
    light = written(nested.select(F.col(names[1]).alias("size"), F.col(names[2]).alias("key"), F.col(names[3]).alias("digest")), "mix-sizes")
    hot, facts = cell_facts(light, weights, max_repeat, cell_rows)
    out = with_copies(nested, hot, facts, names[2], names[1], names[3], seed)
    out = out.where("c_copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c_copies"))).alias("c_nth"))
    return out.select("row.*")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'null') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY k = 'null', k) - 1) % 3] AS w FROM d GROUP BY k),
q AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS left_size, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w
      FROM p WINDOW b AS (ORDER BY (3 * source_size) / CAST(w AS DOUBLE), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, cap * left_w <= w * left_size AS capped FROM q),
t AS (SELECT k, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
        CAST(w * (sum(source_size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0)) AS DOUBLE) / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target,
        CAST(('0x' || substr(md5('7:' || k), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM r),
n AS (SELECT doc_id, size, source_size, target, u, target / source_size AS f, row_number() OVER (PARTITION BY d.k ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), ''))) AS i
      FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size, source_size, target, CAST(size * (floor(u + f * i) - floor(u + f * (i - 1))) AS BIGINT) AS taken FROM n
"""
