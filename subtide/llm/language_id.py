"""Language of mixed-language text: script ranges, word scores, Viterbi.

Words are runs of letters and their marks, cut where the script changes and, in
scripts that leave no space between words, every ``CUT`` letters. Training counts character trigrams of words (edges marked) by language in
hashed buckets, and letters by script and language. A word's score for a
language is its trigrams' mean log probability times a capped length; languages
never seen in the word's script are out, unless no language has that script
(then the word tells nothing). Viterbi over a text's words with ``switch``
nats for a change of language labels spans; the text's language is the one with
the most letters, its score that share of the text's letters.

Defined results: a null text, and one without a letter, is ``und`` with score 0
and no spans (marks without a letter before them, such as those of emoji, are no
letters); ties go to the first language by code point; rows whose label is
null do not train; without training rows every text is ``und``; texts of any
length are read whole; repeated rows are labelled alike; other columns are not
read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X

BUCKETS = 1 << 16
#: Rows of a language that train at most; chosen by hash over all its rows.
TRAIN_ROWS = 5_000
SWITCH = 8.0
SLICE_CHARS = 1 << 20
#: Texts that step through Viterbi together; the longest of them decides the steps.
SLICE_BYTES = 4 << 20
#: First and last code points by script; letters elsewhere count as one more script.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
N_SCRIPTS = len(SCRIPTS) + 1
#: Scripts that leave no space between words, and letters of one piece of them.
UNSPACED = ("thai", "kana", "han")
CUT = 8
#: Numbers held at a time while letters are summed over words.
BLOCK = 1 << 22


@functools.cache
def script_table() -> np.ndarray:
    """Script number of each code point: 0 no letter, 1.. as in SCRIPTS, last: any other letter or mark."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000) | mark_table()
    out = np.where(letter, N_SCRIPTS, 0).astype(np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            out[a : b + 1][letter[a : b + 1]] = k + 1
    return out


@functools.cache
def mark_table() -> np.ndarray:
    """Marks that join the letter before them: vowel signs, accents."""
    return np.fromiter((unicodedata.category(chr(c)) in ("Mn", "Mc") for c in range(0x110000)), bool, 0x110000)


@functools.cache
def unspaced_table() -> np.ndarray:
    names = [name for name, _ in SCRIPTS]
    return np.isin(np.arange(N_SCRIPTS + 1), [names.index(x) + 1 for x in UNSPACED])


@dataclass
class Scanned:
    """Letter runs of one string of code points."""

    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    bucket: np.ndarray  # one for each letter, in order
    first: np.ndarray  # index of each word's first letter


def scan(code: np.ndarray) -> Scanned:
    s = script_table()[code]
    # a mark counts only where a letter stands before it, with nothing but marks between
    mark = mark_table()[code]
    base = np.maximum.accumulate(np.where(mark, -1, np.arange(len(code))))
    s = np.where(mark & ((base < 0) | (s[base] == 0)), 0, s)
    w = X.runs_of(s > 0, np.array([0, len(code)]))
    at = np.flatnonzero(s > 0)
    # cut runs where the script changes, and pieces of scripts without spaces
    mark = mark_table()[code[at]]
    fresh = np.zeros(len(at), bool)
    first = np.searchsorted(at, w.starts)
    fresh[first] = True
    script = s[at][np.maximum.accumulate(np.where(~mark | fresh, np.arange(len(at)), 0))]
    fresh[1:] |= script[1:] != script[:-1]
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    fresh |= unspaced_table()[script] & (place % CUT == 0)
    starts = at[fresh]
    ends = np.append(np.append(at, 0)[np.flatnonzero(fresh)[1:] - 1] + 1, at[-1:] + 1)
    padded = np.zeros(len(code) + 2, np.uint64)
    padded[1:-1][at] = code[at]
    h = X.mix(padded[at] * np.uint64(0x1F1F1F1F1F1F1F) + padded[at + 1] * np.uint64(0x9E3779B97F4A7C15) + padded[at + 2])
    return Scanned(starts, ends, script[fresh], (h & np.uint64(BUCKETS - 1)).astype(np.int64), np.flatnonzero(fresh))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(code: np.ndarray, most: int = SLICE_CHARS) -> Iterator[tuple[int, np.ndarray]]:
    """Long code point strings in parts that end after a letter run."""
    at = 0
    while at < len(code):
        to = min(len(code), at + most)
        while to < len(code):
            gap = np.flatnonzero(script_table()[code[to : to + most]] == 0)
            if len(gap):
                to += int(gap[0])
                break
            to = min(len(code), to + most)
        yield at, code[at:to]
        at = to


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # (scripts + 1) x languages

    def word_scores(self, s: Scanned) -> np.ndarray:
        """Words x languages."""
        if not len(s.starts) or not self.languages:
            return np.zeros((len(s.starts), len(self.languages)), np.float32)
        total = np.zeros((len(s.starts), len(self.languages)), np.float32)
        step = max(1, BLOCK // len(self.languages))
        for at in range(0, len(s.bucket), step):
            a, b = np.searchsorted(s.first, at, "right") - 1, np.searchsorted(s.first, at + step, "left")
            total[a:b] += np.add.reduceat(self.log_p[s.bucket[at : at + step]], np.maximum(s.first[a:b] - at, 0), axis=0)
        k = (s.ends - s.starts).astype(np.float32)[:, None]
        score = total / k * np.minimum(k, 8)
        ok = self.allowed[s.script]
        none = ~ok.any(1)
        score = np.where(ok, score, np.float32(-200))
        score[none] = 0
        return score - score.max(1, keepdims=True)


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Label of each word; ``first`` bounds the texts. All texts step together."""
    n, k = score.shape
    out = np.zeros(n, np.int16)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
    best = np.zeros((len(order), k), np.float32)
    back = np.zeros((n, k), np.int16)
    own = np.arange(k, dtype=np.int16)
    for t, m in enumerate(alive):
        at = first[order[:m]] + t
        v = best[:m]
        if t:
            top = v.argmax(1)
            moved = v[np.arange(m), top] - switch
            stay = v >= moved[:, None]
            back[at] = np.where(stay, own, top[:, None])
            v = np.where(stay, v, moved[:, None])
        best[:m] = v + score[at]
        # longer texts only ever grow; shift to keep float32 exact enough
        best[:m] -= best[:m].max(1, keepdims=True)
    label = best.argmax(1).astype(np.int16)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = first[order[:m]] + t
        now = label[:m].copy()
        out[at] = now
        if t:
            label[:m] = back[at, now]
    return out


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = TRAIN_ROWS) -> Model:
    """Fit on every language, each on at most about ``rows_per_language`` rows, chosen by a hash of the id."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(lang_col)).alias("h"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS + 1, 0), bool))
    languages = sorted(n)
    shares = labelled.sparkSession.createDataFrame([(x, min(1.0, rows_per_language / n[x])) for x in languages], "lang string, share double")
    rows = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.col("h"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        script = np.zeros((N_SCRIPTS + 1, len(languages)), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = number[lang]
                mine = grams.setdefault(k, np.zeros(BUCKETS, np.int64))
                for _, code in pieces(code_points(text.lower())):
                    s = scan(code)
                    mine += np.bincount(s.bucket, minlength=BUCKETS)
                    script[:, k] += np.bincount(s.script, weights=s.ends - s.starts, minlength=N_SCRIPTS + 1).astype(np.int64)
        for k, mine in grams.items():
            at = np.flatnonzero(mine)
            yield pa.record_batch([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(mine[at], pa.int64())], names=["k", "bucket", "n"])
        k, c = np.nonzero(script)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(-k, pa.int32()), pa.array(script[k, c], pa.int64())], names=["k", "bucket", "n"])

    table = rows.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    k, b, c = (table.column(x).to_numpy() for x in ("k", "bucket", "n"))
    grams, script = np.zeros((BUCKETS, len(languages))), np.zeros((N_SCRIPTS + 1, len(languages)))
    is_script = b < 0
    grams[b[~is_script], k[~is_script]] = c[~is_script]
    script[-b[is_script], k[is_script]] = c[is_script]
    p = (grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)
    return Model(languages, np.log(p).astype(np.float32), script > 0.001 * script.sum(0))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """(id, lang_pred, score, n_spans[, spans]) of every text; a span is (start, end, lang) in code points."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_kind = rows.schema["id"].dataType.simpleString()
    kind = f"id {id_kind}, lang_pred string, score double, n_spans int" + (", spans array<struct<start: long, end: long, lang: string>>" if spans else "")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, _ in X.slices(batch, "text", SLICE_BYTES):
                yield labelled(part, m)

    def labelled(part: pa.RecordBatch, m: Model) -> pa.RecordBatch:
        texts = part.column(1).to_pylist()
        lows = [(x or "").lower() for x in texts]
        same = [len(a) == len(b or "") for a, b in zip(lows, texts, strict=True)]
        lows = [a if ok else "".join(c.lower()[:1] for c in b) for a, b, ok in zip(lows, texts, same, strict=True)]
        joined = code_points("\n".join(lows))
        off = np.cumsum([0] + [len(x) + 1 for x in lows])
        starts, ends, score = [], [], []
        for at, code in pieces(joined):
            s = scan(code)
            starts.append(s.starts + at)
            ends.append(s.ends + at)
            score.append(m.word_scores(s))
        start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        first = np.searchsorted(start, off)
        n, k = len(lows), len(m.languages)
        lang, share, count = ["und"] * n, np.zeros(n), np.zeros(n, np.int32)
        found: list[list] = [[] for _ in range(n)]
        if len(start) and k:
            label = viterbi(np.concatenate(score), first, switch)
            owner = np.repeat(np.arange(n), np.diff(first))
            letters = np.zeros((n, k))
            np.add.at(letters, (owner, label), end - start)
            has = letters.sum(1) > 0
            top = letters.argmax(1)
            share[has] = letters.max(1)[has] / letters.sum(1)[has]
            change = np.ones(len(label), bool)
            change[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
            a = np.flatnonzero(change)
            b = np.append(a[1:], len(label)) - 1
            count = np.bincount(owner[a], minlength=n).astype(np.int32)
            for i in np.flatnonzero(has):
                lang[i] = m.languages[top[i]]
            if spans:
                for i, j in zip(a, b, strict=True):
                    o = owner[i]
                    found[o].append((int(start[i] - off[o]), int(end[j] - off[o]), m.languages[label[i]]))
        out = [part.column(0), pa.array(lang), pa.array(share), pa.array(count)]
        if spans:
            out.append(pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x] for x in found], span_type))
        return pa.record_batch(out, names=[f.split(" ")[0] for f in ("id x, lang_pred x, score x, n_spans x" + ", spans x" * spans).split(", ")])

    return rows.mapInArrow(label, kind).withColumnRenamed("id", id_col)
