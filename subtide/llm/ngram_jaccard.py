"""Exact Jaccard join of word n-gram sets through a token-group matrix.

Equal sets are one set with members. A set's shingles that no other set has
bound what it can share, so sets with too few shared ones leave first: by an
extended prefix of all sets, then by all shingles of those that remain. The
shared shingles are then ordered, rarest first.

Sets that share a rare shingle are compared with the most typical of them, and
those that link form a group; those that have half of their union in common, a
family. Near copies of one text that are too far from each other to link would
all meet in its tokens, so within a family sets are told by their differences
from its hub, the tokens that most of its sets have: sets that link without a
common difference link with the set nearest to the hub, and others share one of
their first differences, rarest first. The sets that share one are again compared
with one of them first, and join its group if they link.

The matrix has a row for each (token, group). A set and a group that is not its
own meet if, within a family, the set's first differences and the group's share
one, or else its first shared tokens and the group's, at sizes that can reach the
threshold. For each such meeting
the tokens of the set in the group's union (the tokens of the group's centre, and
those of its other sets that the centre lacks) are counted: that bounds its
overlap with any set of the group, and only groups whose bound reaches the
threshold are opened. In an opened group a set meets the members that it can reach within
the group's centre, and those with which it shares a token outside of the centre;
these pairs are compared exactly.

Links are between different sets; a group of thousands of near copies is a star
around one set and a few rows in the matrix, not all its pairs.

Defined results: texts that are null or without words have an empty set and
link with nothing, not even each other; a text of fewer than ``n`` words has its
word sequence as its one shingle; equal texts, and repeated rows, link; rows
with null ids take part and get the least id of their component, null if it has
none; ids are whole numbers (others raise an error on the cast); shingles are
64-bit hashes; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X
from subtide.llm._graph import components
from subtide.llm._tables import fits, forget, unused, written

#: Rows of a table that is broadcast at most; above, it is shuffled.
BROADCAST_ROWS = 400_000
LAST_ID = (1 << 63) - 1
#: Percent of a set's size by which its first prefix is longer than what a linked set may lack.
EXTRA_PCT = 8
#: Sets that have this percent of their union in common with the most typical of those with one rare shingle are of its family.
KIN_PCT = 50


def shingles(t: X.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each shingle, hash): distinct within a text, sorted by text and hash."""
    low = X.Texts(X.LOWER[t.buf], t.off)
    w = X.words_of(low)
    h = X.span_hashes(low.buf, w.starts, w.ends)
    ok = X.full_windows(w, n)
    owner = w.owner()
    counts = w.counts
    own, grams = owner[: len(ok)][ok], X.gram_hashes(h, n)[ok]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        one = np.array([_sequence(h[w.first[i] : w.first[i + 1]]) for i in short], np.uint64)
        own, grams = np.concatenate([own, short]), np.concatenate([grams, one])
    order = np.lexsort((grams, own))
    own, grams = own[order], grams[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
    return own[new], grams[new]


def _sequence(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence shorter than a shingle; its length counts."""
    return X.gram_hashes(np.concatenate([h, np.array([len(h)], np.uint64)]), len(h) + 1)[0] ^ np.uint64(0xA5A5A5A5A5A5A5A5)


def need(n: Column, pct: int) -> Column:
    """The least overlap of a set of n shingles with any that links to it."""
    return F.ceil(n * pct / F.lit(100)).cast("long")


def reach(overlap: Column, n_a: Column, n_b: Column, pct: int) -> Column:
    """Whether sets of these sizes with so many shared shingles link."""
    return overlap * (100 + pct) >= (n_a + n_b) * pct


def signatures(docs: DataFrame, n: int, pct: int) -> DataFrame:
    """(id, row, size, digest, prefix) of each text; the prefix is its first shingles by hash."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text"):
                own, grams = shingles(t, n)
                first = np.searchsorted(own, np.arange(len(t) + 1))
                size = np.diff(first)
                data = grams.tobytes()
                digest = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                most = np.minimum(size, size - -(-size * pct // 100) + asked(size))
                rank = np.arange(len(own)) - np.repeat(first[:-1], size)
                kept = grams[rank < np.repeat(most, size)].view(np.int64)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]), pa.int32()), pa.array(kept))
                yield pa.record_batch([part.column("id"), part.column("row"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), prefix], names=["id", "row", "size", "digest", "prefix"])

    return docs.mapInArrow(sign, "id long, row long, size long, digest binary, prefix array<long>")


def asked(n: np.ndarray) -> np.ndarray:
    """Prefix shingles that a set of n has beside those it may miss, and of which a linked set has as many."""
    return np.where(n > 0, np.maximum(1, n * EXTRA_PCT // 100), 0)


def hopeful(sets: DataFrame, pct: int) -> DataFrame:
    """(uid, id, row) of the sets whose prefix has enough shingles in common with any other prefixes.

    If two sets share ``o`` shingles, their first ``size - o + e`` ones share
    ``e``. So a set of which fewer prefix shingles stand in any other prefix than
    the least set that may link with it asks for links with none.
    """
    tokens = sets.select("uid", F.explode("prefix").alias("token"))
    several = tokens.groupBy("token").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo < hi").select("token")
    # written, so that the join reads two plain shuffles, of which Spark splits skewed partitions
    several = written(several, "jaccard-several")
    found = tokens.join(several, "token", "left_semi").groupBy("uid").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(1), F.floor(need(F.col("size"), pct) * EXTRA_PCT / F.lit(100)))
    return sets.select("uid", "id", "row", "size").join(found, "uid").where(F.col("n") >= least).select("uid", "id", "row")


def gram_arrays(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(uid, n, grams) of the chosen texts."""
    side = F.broadcast(chosen) if fits(chosen, BROADCAST_ROWS) else chosen
    texts = docs.join(side, ["id", "row"]).select("uid", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text"):
                own, grams = shingles(t, n)
                first = np.searchsorted(own, np.arange(len(t) + 1))
                arrays = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.record_batch([part.column("uid"), pa.array(np.diff(first), pa.int64()), arrays], names=["uid", "n", "grams"])

    # rows of one id and one text are one set
    return texts.mapInArrow(spell, "uid long, n long, grams array<long>").dropDuplicates(["uid"])


def with_shared(grams: DataFrame, pct: int) -> DataFrame:
    """(uid, n, c, shared) of the sets that others have enough shingles of: those c ones, rarest first."""
    tokens = grams.select("uid", "n", F.explode("grams").alias("token"))
    several = written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-several")
    shared = tokens.join(several, "token").groupBy("uid", "n").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    return shared.where(F.col("c") >= need(F.col("n"), pct))


def overlaps(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, k) of each pair of sets: their sizes and the number of shingles in both."""
    pairs = pairs.distinct()
    for side in ("a", "b"):
        pairs = pairs.join(grams.toDF(side, f"n_{side}", f"grams_{side}"), side)
    return pairs.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("k"))


def linked(pairs: DataFrame, pct: int) -> DataFrame:
    """Those (a, b) of ``overlaps`` that reach a threshold."""
    return pairs.where(reach(F.col("k"), F.col("n_a"), F.col("n_b"), pct)).select("a", "b")


def bands(n: Column, pct: int) -> Column:
    """Two bands of sizes: sets that may link have one of them in common."""
    at = F.log(n.cast("double")) / (2.02 * log(100 / min(pct, 95)))
    return F.array(F.floor(at) * 2, F.floor(at + 0.5) * 2 + 1)


def ranked(sets: DataFrame, first: Column, *columns: str) -> DataFrame:
    """One row for each of a set's ``first`` rarest shared shingles."""
    return sets.where(first > 0).select(*columns, F.explode(F.slice("shared", F.lit(1), first.cast("int"))["token"]).alias("token"))


def differences(live: DataFrame, families: DataFrame, pct: int) -> DataFrame:
    """(fam, uid, n, e, diff) of the sets in families: what tells them from the hub.

    The hub of a family is the tokens that more than half of its sets have. ``diff``
    has the tokens that just one of set and hub has, if other sets of the family
    differ in them too, rarest first. The distance of two sets is the sum of theirs
    from the hub, less twice their common differences; so with
    ``e = (100 + pct) * distance - (100 - pct) * n`` two sets link if and only if
    ``2 * (100 + pct) * common >= e_a + e_b``.
    """
    kin = written(live.join(families.toDF("uid", "fam"), "uid").select("fam", "uid", "n", "c", F.col("shared.token").alias("tokens")), "jaccard-kin")
    votes = kin.select("fam", F.explode("tokens").alias("token")).groupBy("fam", "token").agg(F.count("*").alias("votes"))
    most = votes.join(kin.groupBy("fam").agg(F.count("*").alias("sets")), "fam").where("2 * votes > sets")
    hubs = written(most.groupBy("fam").agg(F.collect_list("token").alias("hub")), "jaccard-hubs")
    own = F.concat(F.array_except("tokens", F.coalesce("hub", F.array().cast("array<long>"))), F.array_except(F.coalesce("hub", F.array().cast("array<long>")), "tokens"))
    away = kin.join(hubs, "fam", "left").withColumn("own", own)
    e = (F.size("own") + F.col("n") - F.col("c")) * (100 + pct) - F.col("n") * (100 - pct)
    away = written(away.select("fam", "uid", "n", e.cast("long").alias("e"), "own"), "jaccard-away")
    each = away.select("fam", "uid", F.explode("own").alias("token"))
    several = written(each.groupBy("fam", "token").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-several")
    diff = each.join(several, ["fam", "token"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("df", "token")))["token"].alias("diff"))
    return away.drop("own").join(diff, "uid", "left").select("fam", "uid", "n", "e", F.coalesce("diff", F.array().cast("array<long>")).alias("diff"))


def first_differences(diffs: DataFrame, pct: int) -> DataFrame:
    """(fam, uid, n, e, token, cap): each difference, and the greatest e of a set with which it can be the first in common."""
    each = diffs.select("fam", "uid", "n", "e", F.size("diff").alias("d"), F.posexplode("diff").alias("pos", "token"))
    return each.select("fam", "uid", "n", "e", "token", ((F.col("d") - F.col("pos")) * (2 * (100 + pct)) - F.col("e")).cast("long").alias("cap"))


def links_by_hub(diffs: DataFrame, pct: int) -> DataFrame:
    """(a, b) of linked sets of a family: with the set nearest to the hub, and with the nearest one of a first difference.

    Two sets that link without a common difference both link with the nearest one.
    """
    nearest = diffs.groupBy("fam").agg(F.min(F.struct("e", "uid")).alias("m")).select("fam", F.col("m.e").alias("e_b"), F.col("m.uid").alias("b"))
    sure = diffs.join(nearest, "fam").where("e + e_b <= 0 and uid <> b").select(F.col("uid").alias("a"), "b")
    first = first_differences(diffs, pct).where("cap >= e")
    star = written(first.groupBy("fam", "token").agg(F.min(F.struct("e", "uid")).alias("m"), F.count("*").alias("sets")).where("sets > 1").select("fam", "token", F.col("m.uid").alias("b")), "jaccard-stars")
    tried = first.join(star, ["fam", "token"]).where("uid <> b").select(F.col("uid").alias("a"), "b").distinct()
    for side in ("a", "b"):
        tried = tried.join(diffs.select(F.col("uid").alias(side), F.col("e").alias(f"e_{side}"), F.col("diff").alias(f"diff_{side}")), side)
    return sure.unionByName(tried.where(F.size(F.array_intersect("diff_a", "diff_b")) * (2 * (100 + pct)) >= F.col("e_a") + F.col("e_b")).select("a", "b"))


def asked_within(diffs: DataFrame, owned: DataFrame, pct: int) -> DataFrame:
    """(uid, grp): a set and another group of its family with a set no farther from the hub that it may link with."""
    each = first_differences(diffs, pct).join(owned.select("uid", "grp"), "uid")
    cells = each.where("cap >= e").groupBy("fam", "token", "grp").agg(F.min("e").alias("e"), F.max("cap").alias("cap"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = each.alias("x"), written(cells, "jaccard-matrix").alias("y")
    met = x.join(y, (F.col("x.fam") == F.col("y.fam")) & (F.col("x.token") == F.col("y.token"))).where("x.grp <> y.grp and y.e <= least(x.e, x.cap) and y.cap >= x.e")
    return met.where((F.col("y.hi") * 100 >= F.col("x.n") * pct) & (F.col("x.n") * 100 >= F.col("y.lo") * pct)).select("x.uid", "y.grp")


def asked_across(owned: DataFrame, probe: Column, index: Column, pct: int) -> DataFrame:
    """(uid, grp): a set and a group of another family whose first shared tokens have one in common."""
    cells = ranked(owned, index, "fam", "grp", "n", "c").groupBy("token", "fam", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("c").alias("most"))
    cells = written(cells, "jaccard-matrix")
    # by family first, so that sets do not meet all groups of their own one
    wide = written(cells.groupBy("token", "fam").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("most").alias("most")), "jaccard-matrix")
    x = ranked(owned, probe, "uid", "fam", "n", "c")

    def may(x_: str, y_: str) -> Column:
        n, lo, hi = F.col(f"{x_}.n"), F.col(f"{y_}.lo"), F.col(f"{y_}.hi")
        return (lo <= n) & (hi * 100 >= n * pct) & reach(F.least(f"{x_}.c", f"{y_}.most"), n, F.greatest(lo, need(n, pct)), pct)

    met = x.alias("x").join(wide.alias("y"), F.col("x.token") == F.col("y.token")).where("x.fam <> y.fam").where(may("x", "y"))
    met = met.select("x.uid", "x.n", "x.c", "x.token", "y.fam")
    return met.alias("m").join(cells.alias("z"), (F.col("m.token") == F.col("z.token")) & (F.col("m.fam") == F.col("z.fam"))).where(may("m", "z")).select("m.uid", "z.grp")


def link_sets(docs: DataFrame, n: int = 4, pct: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, sets with uid, uid to root): components of linked sets.

    ``docs`` has (id long, row long, text string); (id, row) names a text.
    """
    signed = written(signatures(docs, n, pct), "jaccard-signed")
    # rows of one digest have one set, and so one size and prefix
    per = signed.where("size > 0").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("s"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    sets = written(per.select("digest", "s.*", "size", "prefix", F.monotonically_increasing_id().alias("uid")), "jaccard-sets")
    chosen = written(hopeful(sets, pct), "jaccard-hopeful")
    grams = written(gram_arrays(docs, chosen, n), "jaccard-grams")
    live = written(with_shared(grams, pct), "jaccard-live")
    n_, c = F.col("n"), F.col("c")
    # first shared shingles that a linked set of any size has one of, and one of no smaller size
    probe, index = c - need(n_, pct) + 1, c - F.ceil(n_ * (2 * pct) / F.lit(100 + pct)) + 1
    typical = F.struct((c * 1000 / n_).cast("long").alias("share"), (-F.col("uid")).alias("nuid"), "n", "c")

    # groups: sets that share a rare shingle and are of like sizes, around the most typical of them; among
    # near copies of one text that is the text itself, or the least changed of them
    stars = ranked(live, probe, "uid", "n", "c").withColumn("band", F.explode(bands(n_, pct)))
    centre = written(stars.groupBy("token", "band").agg(F.max(typical).alias("t"), F.count("*").alias("sets")).where("sets > 1").select("token", "band", (-F.col("t.nuid")).alias("b"), F.col("t.n").alias("n_b"), F.col("t.c").alias("c_b")), "jaccard-centres")
    kin = min(pct, KIN_PCT)
    tried = stars.join(centre, ["token", "band"]).where(F.col("uid") != F.col("b")).where(reach(F.least("c", "c_b"), n_, F.col("n_b"), kin))
    tried = written(overlaps(tried.select(F.col("uid").alias("a"), "b"), grams), "jaccard-tried")
    # families hold whole groups, as a link is kin
    families = written(components(linked(tried, kin)), "jaccard-families")
    diffs = written(differences(live, families, pct), "jaccard-diffs")
    near = written(linked(tried, pct).unionByName(links_by_hub(diffs, pct)), "jaccard-near")
    grouped = written(components(near), "jaccard-groups")
    owned = live.join(families.toDF("uid", "fam"), "uid", "left").join(grouped.toDF("uid", "grp"), "uid", "left")
    owned = written(owned.withColumn("fam", F.coalesce("fam", "uid")).withColumn("grp", F.coalesce("grp", "uid")), "jaccard-owned")

    # the matrix, rare end: by token and group, what its sets can reach
    asking = written(asked_within(diffs, owned, pct).unionByName(asked_across(owned, probe, index, pct)).distinct(), "jaccard-asking")
    if asking.isEmpty():
        forget(chosen, live, centre, tried, families, diffs, near, owned, asking, grams)
        return signed, sets, grouped

    # each group asked: its centre's shingles, and those of its other sets that the centre lacks, are its union
    tokens = owned.select("uid", "grp", "n", "c", F.col("shared.token").alias("tokens"))
    facts = owned.join(asking.select("grp").distinct(), "grp").groupBy("grp").agg(F.min("n").alias("lo"), F.count("*").alias("members"), (-F.max(typical)["nuid"]).alias("b"))
    facts = written(facts.join(tokens.select(F.col("uid").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("centre")), "b"), "jaccard-facts")
    inside, outside = F.size(F.array_intersect("tokens", "centre")).cast("long"), F.array_except("tokens", "centre")
    queries = asking.join(tokens.drop("grp"), "uid").join(facts, "grp")
    queries = written(queries.select(F.col("uid").alias("a"), "grp", "b", F.col("n").alias("n_a"), F.col("c").alias("c_a"), inside.alias("i_a"), outside.alias("out_a"), "n_b", "lo", "members"), "jaccard-queries")
    # the union of a group of one is the set itself, so its bound is the overlap
    ones = queries.where("members = 1").where(reach(F.col("i_a"), F.col("n_a"), F.col("n_b"), pct)).select("a", "b")

    held = tokens.join(facts.where("members > 1").select("grp", "centre"), "grp")
    held = written(held.select("grp", F.col("uid").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"), inside.alias("i_b"), outside.alias("out_b")), "jaccard-held")
    union = written(held.select("grp", F.explode("out_b").alias("token")).distinct().withColumn("has", F.lit(1)), "jaccard-union")
    counted = queries.where("members > 1").select("a", "grp", "n_a", "c_a", "i_a", "lo", F.explode_outer("out_a").alias("token")).join(union, ["grp", "token"], "left")
    bound = counted.groupBy("a", "grp", "n_a", "c_a", "i_a", "lo").agg(F.count("has").alias("k"))
    opened = bound.where(reach(F.col("i_a") + F.col("k"), F.col("n_a"), F.greatest("lo", need(F.col("n_a"), pct)), pct)).select("a", "grp", "n_a", "c_a", "i_a")
    opened = written(opened, "jaccard-opened")

    # open them. What two sets share is within the group's centre, or it is not: sets that do not reach
    # each other within it must share a shingle outside it
    fit = reach(F.least("c_a", "c_b"), F.col("n_a"), F.col("n_b"), pct)
    within = opened.join(held.drop("out_b"), "grp").where(fit).where(reach(F.least("i_a", "i_b"), F.col("n_a"), F.col("n_b"), pct)).select("a", "b")
    # only the tokens of opened meetings become rows, not those of all that were asked
    far_a = opened.join(queries.select("a", "grp", "out_a"), ["a", "grp"]).select("a", "grp", "n_a", "c_a", "i_a", F.explode("out_a").alias("token"))
    far_b = held.join(opened.select("grp").distinct(), "grp").select("grp", "b", "n_b", "c_b", "i_b", F.explode("out_b").alias("token"))
    both = far_a.join(far_b, ["grp", "token"]).where(fit).groupBy("a", "b", "n_a", "n_b", "i_a", "i_b").agg(F.count("*").alias("k"))
    beyond = both.where(reach(F.least("i_a", "i_b") + F.col("k"), F.col("n_a"), F.col("n_b"), pct)).select("a", "b")
    far = written(linked(overlaps(within.unionByName(beyond), grams), pct).unionByName(ones), "jaccard-far")
    roots = written(components(near.unionByName(far)), "jaccard-roots")
    forget(chosen, live, centre, tried, families, diffs, near, grouped, owned, asking, facts, queries, held, union, opened, far, grams)
    return signed, sets, roots


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("raw_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.select(F.coalesce("raw_id", F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, pct: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the least id reachable by links."""
    signed, sets, roots = link_sets(keyed(docs, id_col, text_col), n, pct)
    comp = sets.select("digest", "uid", "id").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = comp.groupBy("root").agg(F.min("id").alias("component_id"))
    comp = comp.join(least, "root").select("digest", "component_id")
    rows = signed.select("id", "size", F.when(F.col("size") > 0, F.col("digest")).alias("digest"))
    out = rows.join(comp, "digest", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(real("id").alias(id_col), F.col("size").alias("n_shingles"), real("component_id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, pct: int = 85) -> DataFrame:
    """The rows of docs, of each component only the one with the least (id, text hash); empty sets all stay."""
    names = [unused(docs, x) for x in ("set_id", "set_row")]
    key = [F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias(names[0]), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias(names[1])]
    rows = docs.select(*[docs[c] for c in docs.columns], *key)
    signed, sets, roots = link_sets(keyed(docs, id_col, text_col), n, pct)
    # a set's first row is named in sets; that of its component is the least of these
    named = sets.select("digest", "uid", "id", "row").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    first = named.groupBy("root").agg(F.min(F.struct("id", "row")).alias("s")).select("s.*")
    seen = signed.where("size > 0").groupBy("id", "row").agg(F.count("*").alias("n"))
    gone = written(seen.join(first, ["id", "row"], "left_anti").select("id", "row").toDF(*names), "jaccard-gone")
    rows = rows.join(F.broadcast(gone) if fits(gone, BROADCAST_ROWS) else gone, names, "left_anti")
    twice = written(seen.where("n > 1").select("id", "row").toDF(*names), "jaccard-twice")
    if not twice.isEmpty():  # rows with one id and one text: one of them stays
        again = rows.join(twice, names, "left_semi").dropDuplicates(names)
        rows = rows.join(twice, names, "left_anti").unionByName(again)
    return rows.select(*docs.columns)
