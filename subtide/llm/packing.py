"""Best-fit packing into bins of several permitted lengths.

Texts longer than the largest capacity are cut into pieces of that length and a
rest. Pieces are dealt by hash to shards of about ``shard_pieces`` pieces, and
each shard is packed by itself, longest piece first: a piece goes to the open
bin that it leaves least room in. If none has room, a bin is opened whose
capacity has the least cost a token, reckoned with what is still to be packed;
when all is packed, each bin shrinks to the least capacity that holds its
contents. Shards know only lengths, so memory is bounded; a waste of a few bins
a shard is the price.

Lengths are words, or tokens of a public tokenizer where the texts go with them
(``pack_texts``).

Defined results: a null, empty or wordless text has one piece of length 0, which
takes no room but has a bin; equal rows are packed as rows of their own, and
spread by their place in the input, so another layout of the files may give
other bins; ties go by id and piece; null ids stay null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X
from subtide.llm._tables import written
from subtide.llm.mixing import n_words
from subtide.llm.token_counts import CHUNK_CHARS, cut_pieces, tokenizer

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_PIECES = 20_000
#: Tokens of a shard that carries its texts, about.
SHARD_TOKENS = 4_000_000
#: Cost of a bin: its capacity and a fixed charge for each sequence.
BIN_CHARGE = 16.0


def pack(lengths: np.ndarray, capacities: tuple[int, ...], charge: float = BIN_CHARGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin, final capacity of the bin) of each piece, best fit, longest first."""
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    n = len(lengths)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    filled: list[int] = []
    ordered = lengths[order].astype(np.int64)
    rest = np.concatenate([np.cumsum(ordered[::-1])[::-1], [0]])  # still to be packed from i on
    for i, (at, k) in enumerate(zip(order.tolist(), ordered.tolist(), strict=True)):
        j = bisect.bisect_left(room, (k, -1))
        if j < len(room):
            left, b = room.pop(j)
        else:
            # what can still join the piece: everything after it that is no longer than the room
            best, left = None, 0
            for c in caps:
                if c < k:
                    continue
                first_small = max(i + 1, int(np.searchsorted(-ordered, -(c - k), "left")))
                expect = k + min(c - k, int(rest[first_small]))
                price = (c + charge) / max(expect, 1)
                if best is None or price < best:
                    best, left = price, c
            b = len(filled)
            filled.append(0)
        bin_of[at], offset[at] = b, filled[b]
        filled[b] += k
        if left - k > 0:
            bisect.insort(room, (left - k, b))
        elif k == 0:
            bisect.insort(room, (left, b))
    final = np.array([caps[bisect.bisect_left(caps, x)] for x in filled], np.int64)
    return bin_of, offset, final[bin_of] if n else final


def _dealt(pieces: DataFrame, capacities: tuple[int, ...], shard_pieces: int, charge: float, shard_total: int | None = None) -> DataFrame:
    """``pieces`` (length, key, ...) with shard, bin, bin_offset and capacity in place of the key; each shard is packed by itself."""
    facts = pieces.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    shards = max(1, -(-facts["n"] // shard_pieces), -(-(facts["total"] or 0) // shard_total) if shard_total else 1)
    kept = [c for c in pieces.columns if c != "key"]
    dealt = pieces.withColumn("shard", F.pmod("key", F.lit(shards)))
    kind = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in [*kept, "shard"]) + ", bin long, bin_offset long, capacity int"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a task come sorted by shard, so a shard is complete when the next one begins
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if to > at:
                    if held and now != shard[at]:
                        yield from one(held)
                        held = []
                    now = shard[at]
                    held.append(batch.slice(at, to - at))
        if held:
            yield from one(held)

    def one(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        g = pa.Table.from_batches(held).combine_chunks().select([*kept, "shard"])
        b, o, c = pack(g["length"].to_numpy(), capacities, charge)
        for name, values in (("bin", b), ("bin_offset", o), ("capacity", c.astype(np.int32))):
            g = g.append_column(name, pa.array(values))
        return g.to_batches()

    sort = [c for c in kept if c not in ("length", "text")]
    return dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), *sort, "key").mapInArrow(packed, kind)


def pack_lengths(docs: DataFrame, length: Column, *, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES, charge: float = BIN_CHARGE) -> DataFrame:
    """(id, piece, piece_start, length, shard, bin, bin_offset, capacity): one row a piece; a bin is (shard, bin)."""
    top = max(capacities)
    rows = docs.select(docs[id_col].alias("id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / top), F.lit(1)).cast("long") - 1
    pieces = rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * top).alias("piece_start"), F.least(F.col("n") - F.col("piece") * top, F.lit(top)).alias("length"))
    # equal rows differ by their place in the input, so one repeated row still spreads over all shards
    place = F.monotonically_increasing_id() % 4096
    # written, so that texts are measured once
    pieces = written(pieces.withColumn("key", F.xxhash64("id", "piece", "length", place)), "pack-pieces")
    return _dealt(pieces, capacities, shard_pieces, charge).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``pack_lengths`` by the number of words of each text."""
    return pack_lengths(docs, n_words(docs[text_col].cast("string")), id_col=id_col, **options)


def pack_texts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES, charge: float = BIN_CHARGE) -> DataFrame:
    """(id, row, piece, text, length, shard, bin, bin_offset, capacity): whole texts in pieces, by tokens of the tokenizer at ``path``.

    ``row`` tells rows of one id apart. The texts of a row's pieces, in order, are
    the row's text; those of a bin, by ``bin_offset``, are its sequence, of at most
    ``capacity`` tokens.
    """
    top = max(capacities)
    rows = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), docs[text_col].cast("string").alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, row long, piece long, text string, length long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part, _ in X.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                short = [i for i, x in enumerate(texts) if len(x or "") <= CHUNK_CHARS]
                size = dict(zip(short, tok.counts([texts[i] or "" for i in short]), strict=True))
                out: tuple[list, list, list, list] = [], [], [], []
                for i, x in enumerate(texts):
                    own = [(x, size[i])] if size.get(i, top + 1) <= top else cut_pieces(tok, x, top)
                    for k, (piece, n) in enumerate(own):
                        for col, v in zip(out, (i, k, piece, n), strict=True):
                            col.append(v)
                at = pa.array(out[0], pa.int64())
                yield pa.record_batch([part.column("id").take(at), part.column("row").take(at), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["id", "row", "piece", "text", "length"])

    pieces = written(rows.mapInArrow(cut, kind).withColumn("key", F.xxhash64("id", "row", "piece")), "pack-texts")
    return _dealt(pieces, capacities, shard_pieces, charge, SHARD_TOKENS).withColumnRenamed("id", id_col)
