"""Benchmark decontamination with a generalised suffix automaton of test items.

Items and texts are cut into words: A-Z lower-cased, then runs of digits, letters
and characters beyond ASCII. The automaton holds every stretch of words of every
item; a text's words are streamed through it, which gives after each word the
longest stretch of some item that ends there. A text word is hit if it lies in an
occurrence of a window: ``window`` consecutive words of an item, or a whole item
of fewer words. A state knows the items of its windows, so a hit names them.

Longer matches than ``window`` words are never needed, so a text is streamed in
lanes of words that each start ``window - 1`` words early; all lanes of a slice
step together, through sorted transitions.

Long items are cut into pieces that overlap by ``window - 1`` words, and pieces are
dealt to blocks of about ``block_words`` words. Each block's automaton is built in
a Spark task; blocks go to the texts by broadcast, at most ``broadcast_bytes`` at
a time, each time in one pass over the texts. Usually one pass does; further ones
give rows of hit texts only, which are merged with the first by id and text. Texts
are never shuffled to be counted.

Defined results: a null text or item has no words, an item without words no
window; items with null ids hit words but are not named; equal item ids are one
item; rows with null ids and repeated rows are rows of their own; windows that
overlap or repeat count once for a word; empty tables give no rows, or rows
without hits; words are compared by 64-bit hashes; other columns pass through
``decontaminate`` and are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X
from subtide.llm._tables import fits, forget, unused, written

WINDOW = 10
BLOCK_WORDS = 200_000
PIECE_WORDS = 20_000
BROADCAST_BYTES = 128 << 20
#: Spans of texts that are broadcast at most; above, they are shuffled.
BROADCAST_SPANS = 250_000
LANE = 64
SLICE_BYTES = 2 << 20
#: Hit spans of so many words go; a text goes if more than so many percent of its words are hit.
MIN_SPAN = 10
MAX_PCT = 50

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPANS = "array<struct<a: int, b: int, from_byte: long, to_byte: long>>"


def words_of(t: X.Texts) -> tuple[X.Words, np.ndarray]:
    """Normalised words of each text, and their hashes."""
    low = X.LOWER[t.buf]
    w = X.runs_of(IS_WORD[low], t.off)
    return w, X.span_hashes(low, w.starts, w.ends)


@dataclass
class Automaton:
    """A generalised suffix automaton of word sequences, in flat arrays; state 0 is the empty stretch."""

    vocabulary: np.ndarray  # sorted hashes of the items' words
    length: np.ndarray  # longest stretch of each state
    link: np.ndarray  # the state of the longest stretch that is in another state
    moves: np.ndarray  # sorted: state << 32 | word
    target: np.ndarray
    window: int
    at_window: np.ndarray  # of each state, the one that holds its last ``window`` words; -1 if it has fewer
    at_short: np.ndarray  # of each state, the nearest one by links that is a whole short item; -1 if none
    named: np.ndarray  # sorted: state << 32 | item, of windows and short items
    items: list[str]

    def step(self, state: np.ndarray, n: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and match lengths after one more word in each lane; word -1 is in no item."""
        state, n = state.copy(), n.copy()
        todo = np.flatnonzero(word >= 0)
        out = word < 0
        state[out], n[out] = 0, 0
        while len(todo):
            key = state[todo] << 32 | word[todo]
            at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            found = self.moves[at] == key
            state[todo[found]] = self.target[at[found]]
            n[todo[found]] += 1
            todo = todo[~found]
            stuck = state[todo] == 0
            n[todo[stuck]] = 0
            todo = todo[~stuck]
            state[todo] = self.link[state[todo]]
            n[todo] = self.length[state[todo]]
        return state, n

    def stream(self, w: X.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, match length) after each word; lengths from ``window`` on are exact up to it only."""
        state, n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if not len(h) or not len(self.vocabulary):
            return state, n
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[at] == h, at, -1)
        lanes = -(-w.counts // LANE)
        text = np.repeat(np.arange(len(w.counts)), lanes)
        begin = w.first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(begin + LANE, w.first[text + 1])
        early = np.maximum(begin - (self.window - 1), w.first[text])
        order = np.argsort(early - stop, kind="stable")
        begin, stop, early = begin[order], stop[order], early[order]
        steps = stop - early
        s, k = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for t in range(int(steps.max())):
            m = int(np.searchsorted(-steps, -t, "left"))
            at = early[:m] + t
            s, k = self.step(s[:m], k[:m], word[at])
            own = at >= begin[:m]
            state[at[own]], n[at[own]] = s[own], k[own]
        return state, n

    def occurrences(self, state: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last word, words, state) of each window that ends at a word."""
        end = np.flatnonzero(n >= self.window)
        out = [(end, np.full(len(end), self.window), self.at_window[state[end]])]
        # a short item may be any shorter ending; only the longest stretch of a state can be one
        end = np.flatnonzero(n > 0)
        u = np.where(n[end] < self.length[state[end]], self.link[state[end]], state[end])
        u = self.at_short[u]
        while len(end):
            some = u >= 0
            end, u = end[some], u[some]
            out.append((end, self.length[u], u))
            u = self.at_short[self.link[u]]
        a, b, c = zip(*out, strict=True)
        return np.concatenate(a), np.concatenate(b), np.concatenate(c)

    def items_of(self, text: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) of windows (text, state), sorted."""
        both = np.unique(text << 32 | state)
        text, state = both >> 32, both & 0xFFFFFFFF
        a, b = np.searchsorted(self.named, state << 32), np.searchsorted(self.named, (state + 1) << 32)
        size = b - a
        which = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        both = np.unique(np.repeat(text, size) << 32 | self.named[which] & 0xFFFFFFFF)
        return both >> 32, both & 0xFFFFFFFF


def build(pieces: list[tuple[str | None, bool, np.ndarray]], window: int) -> Automaton:
    """The automaton of pieces (item id, whether it is a whole item, word hashes), one after another."""
    vocabulary = np.unique(np.concatenate([h for _, _, h in pieces])) if pieces else np.zeros(0, np.uint64)
    moves: list[dict[int, int]] = [{}]
    length, link = [0], [-1]

    def split(p: int, word: int) -> int:
        """The state of (longest stretch of p) + word, where p has the move: cut off from longer ones if need be."""
        q = moves[p][word]
        if length[q] == length[p] + 1:
            return q
        c = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        moves.append(dict(moves[q]))
        link[q] = c
        while p >= 0 and moves[p].get(word) == q:
            moves[p][word] = c
            p = link[p]
        return c

    numbers: dict[str, int] = {}
    named: list[tuple[int, int]] = []
    short = []
    for item, whole, h in pieces:
        number = -1 if item is None else numbers.setdefault(item, len(numbers))
        last, path = 0, []
        for word in np.searchsorted(vocabulary, h).tolist():
            if word in moves[last]:
                last = split(last, word)
            else:
                new = len(length)
                length.append(length[last] + 1)
                link.append(0)
                moves.append({})
                p = last
                while p >= 0 and word not in moves[p]:
                    moves[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, word)
                last = new
            path.append(last)
        if len(path) >= window:
            named += [(s, number) for s in path[window - 1 :]]
        elif whole and path:
            short.append(last)
            named.append((last, number))
    size, up = np.array(length, np.int64), np.array(link, np.int64)
    up[0] = 0
    is_short = np.zeros(len(size), bool)
    is_short[short] = True
    at_window, at_short = np.full(len(size), -1, np.int64), np.full(len(size), -1, np.int64)
    for v in np.argsort(size, kind="stable")[1:].tolist():
        at_window[v] = -1 if length[v] < window else v if length[link[v]] < window else at_window[link[v]]
        at_short[v] = v if is_short[v] else at_short[link[v]]
    pairs = np.array([(s if at_window[s] < 0 else at_window[s], i) for s, i in named if i >= 0], np.int64).reshape(-1, 2)
    flat = sorted((s << 32 | word, q) for s, m in enumerate(moves) for word, q in m.items())
    key, target = (np.array([x[i] for x in flat], np.int64) for i in (0, 1))
    return Automaton(vocabulary, size, up, key, target, window, at_window, at_short, np.unique(pairs[:, 0] << 32 | pairs[:, 1]), list(numbers))


def automata(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int, piece_words: int) -> DataFrame | None:
    """(block, n_bytes, data): a pickled automaton for each block of item pieces, as a written table; None without any word."""
    rows = items.select(items[id_col].cast("string").alias("item"), items[text_col].cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text"):
                w, h = words_of(t)
                out: tuple[list, list, list] = [], [], []
                for item, a, b in zip(part.column(0).to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    step = max(1, piece_words - window + 1)
                    for at in range(a, max(a + 1, b - window + 1), step):
                        own = h[at : min(b, at + step + window - 1)]
                        if len(own):
                            for x, y in zip(out, (item, b - a == len(own), own.tobytes()), strict=True):
                                x.append(y)
                yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary())], names=["item", "whole", "words"])

    pieces = written(rows.mapInArrow(cut, "item string, whole boolean, words binary"), "items-pieces")
    total = pieces.agg(F.sum(F.length("words"))).first()[0]
    if not total:
        return None
    n_blocks = -(-total // (8 * block_words))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, bool, np.ndarray]] = []
        now = None

        def one() -> pa.RecordBatch:
            data = pickle.dumps(build(held, window), 5)
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["block", "n_bytes", "data"])

        for batch in batches:
            for block, item, whole, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and block != now:
                    yield one()
                    held = []
                now = block
                held.append((item, whole, np.frombuffer(words, np.uint64)))
        if held:
            yield one()

    dealt = pieces.select(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)).alias("block"), "item", "whole", "words").distinct()
    dealt = dealt.repartition(min(n_blocks, 10_000), "block").sortWithinPartitions("block", "item", "words")
    return written(dealt.mapInArrow(made, "block long, n_bytes long, data binary"), "items-automata")


def _rounds(blocks: DataFrame | None, most: int, window: int) -> Iterator[list[Automaton]]:
    """Automata in groups of at most ``most`` bytes (one at least)."""
    if blocks is None:
        yield [build([], window)]
        return
    sizes = sorted((r["block"], r["n_bytes"]) for r in blocks.select("block", "n_bytes").collect())
    at = 0
    while at < len(sizes):
        group, n = [], 0
        while at < len(sizes) and (not group or n + sizes[at][1] <= most):
            group.append(sizes[at][0])
            n += sizes[at][1]
            at += 1
        yield [pickle.loads(r["data"]) for r in blocks.where(F.col("block").isin(group)).select("data").collect()]


def _matched(rows: DataFrame, group: list[Automaton], only_hit: bool) -> DataFrame:
    """(id, row, n_words, spans, items) of rows (id, row, text), of those with hits or of all."""
    kind = f"id {rows.schema['id'].dataType.simpleString()}, row long, n_words long, spans {SPANS}, items array<string>"
    shared = rows.sparkSession.sparkContext.broadcast(group)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text", SLICE_BYTES):
                out = matched(part, t)
                yield out.filter(pa.array(np.diff(out.column(3).offsets.to_numpy()) > 0)) if only_hit else out

    def matched(part: pa.RecordBatch, t: X.Texts) -> pa.RecordBatch:
        w, h = words_of(t)
        owner = w.owner()
        change = np.zeros(len(h) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(len(t))]
        for auto in shared.value:
            end, size, state = auto.occurrences(*auto.stream(w, h))
            np.add.at(change, end - size + 1, 1)
            np.add.at(change, end + 1, -1)
            text, item = auto.items_of(owner[end], state)
            for i, k in zip(text.tolist(), item.tolist(), strict=True):
                found[i].add(auto.items[k])
        hit = X.runs_of(np.cumsum(change[:-1]) > 0, w.first)
        own = np.repeat(np.arange(len(t)), hit.counts)
        a, b = hit.starts, hit.ends
        cols = [(a - w.first[own]).astype(np.int32), (b - w.first[own]).astype(np.int32), w.starts[a] - t.off[own], w.ends[b - 1] - t.off[own]]
        spans = pa.StructArray.from_arrays([pa.array(x) for x in cols], names=["a", "b", "from_byte", "to_byte"])
        spans = pa.ListArray.from_arrays(pa.array(hit.first.astype(np.int32)), spans)
        items = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
        return pa.record_batch([part.column(0), part.column(1), pa.array(w.counts.astype(np.int64)), spans, items], names=["id", "row", "n_words", "spans", "items"])

    return rows.mapInArrow(match, kind)


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["a"], s["b"])):
        if out and s["a"] <= out[-1]["b"]:
            if s["b"] > out[-1]["b"]:
                out[-1] = {**out[-1], "b": s["b"], "to_byte": s["to_byte"]}
        else:
            out.append(s)
    return out


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, row, n_words, spans, items) of every text: hit spans (words a to b, bytes from_byte to to_byte, ends not included) and named items; ``row`` is a hash of the text."""
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("row"), docs[text_col].cast("string").alias("text"))
    blocks = automata(items, item_id_col, item_text_col, window, block_words, piece_words)
    out, more = None, []
    for group in _rounds(blocks, broadcast_bytes, window):
        if out is None:
            out = _matched(rows, group, False)
        else:
            more.append(written(_matched(rows, group, True).distinct(), "items-hits"))
    if more:
        kind = out.schema["spans"].dataType

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("spans")
                cols = batch.columns
                cols[at] = pa.array([_merged(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
                yield pa.record_batch(cols, schema=batch.schema)

        hits = more[0]
        for x in more[1:]:
            hits = hits.unionByName(x)
        hits = hits.groupBy(F.col("id").alias("hit_id"), F.col("row").alias("hit_row")).agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
        both = out.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")), "left")
        spans = F.concat("spans", F.coalesce("more_spans", F.lit(None).cast(kind), F.array().cast(kind)))
        named = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))))
        both = both.select("id", "row", "n_words", spans.alias("spans"), named.alias("items"))
        out = both.mapInArrow(merge, both.schema)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_span: int = MIN_SPAN, max_pct: int = MAX_PCT, **options) -> DataFrame:
    """docs without hit spans of at least ``min_span`` words, and without texts of which more than ``max_pct`` percent of the words are hit."""
    found = contamination(docs, items, id_col=id_col, text_col=text_col, **options)
    found = written(found.where(F.size("spans") > 0).select(F.col(id_col).alias("id"), "row", "n_words", "spans").distinct(), "items-spans")
    names = [unused(docs, x) for x in ("hit_id", "hit_row", "hit_words", "hit_spans")]
    side = found.toDF(*names)
    side = F.broadcast(side) if fits(found, BROADCAST_SPANS, 1 + F.size("spans")) else side
    key = unused(docs, "text_row")
    both = docs.withColumn(key, F.xxhash64(docs[text_col].cast("string")))
    both = both.join(side, both[id_col].eqNullSafe(side[names[0]]) & (both[key] == side[names[1]]), "left")
    n_hit = F.aggregate(F.col(names[3]), F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    both = both.where(F.col(names[3]).isNull() | (100 * n_hit <= max_pct * F.col(names[2])))
    columns, at = docs.columns, docs.columns.index(text_col)
    both = both.select(*[both[c] for c in columns], both[names[3]])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(len(columns)).to_pylist()):
                if spans:
                    data, kept, end = texts[i].encode(), [], 0
                    for s in spans:
                        if s["b"] - s["a"] >= min_span:
                            kept.append(data[end : s["from_byte"]])
                            end = s["to_byte"]
                    texts[i] = b"".join([*kept, data[end:]]).decode()
            cols = batch.columns[: len(columns)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.record_batch(cols, names=columns)

    return both.mapInArrow(strip, docs.schema)


HITS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM g),
s AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM t, m WHERE len(w) >= m)),
h AS (SELECT s.doc_id, s.k, s.m, g.item_id FROM s JOIN g ON s.g = g.g AND s.m = g.m),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS j FROM (SELECT DISTINCT doc_id, k, m FROM h)) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN x ON t.doc_id = x.doc_id
"""
