"""Toxic sentences from document labels: multiple-instance learning with noisy-or.

A text's sentences are its instances. A sentence has the probability
``sigmoid(bias + sum of its features' weights)``; a text that of any sentence,
``1 - prod(1 - p)``. Weights are trained on text labels alone. Features are
words and their first four to six bytes, lower-cased, hashed into ``BUCKETS``;
every bucket trains that texts of label 1 have clearly more often (``MIN_Z``, ``MIN_RATIO``),
counted over about ``LABEL_ROWS`` labelled rows at most (``sample_labels``), with
about ``train_rows`` of these rows at most. Both samples are chosen by hash of
the id, label 0 and label 1 alike.

Words are runs of letters (ASCII letters, and all beyond ASCII but common
punctuation); a sentence goes from its first word to its last, and ends at
``. ! ?``, their forms in other scripts, or a line end.

Defined results: null and empty texts have the score of no sentence, 0; labels
that are null do not train, a repeated id has the highest of its labels, null
ids have none; without rows of both labels every score is 0; texts are read
whole, and a very long one is worked on by itself; repeated rows are scored
alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X
from subtide.llm._tables import forget, written

#: Hashed features; the model has one weight for each.
BUCKETS = 1 << 18
#: Standard errors by which a feature must lead in label-1 texts to be trained, and times that it must be as frequent there.
MIN_Z = 2.0
MIN_RATIO = 2.0
TRAIN_ROWS = 20_000
#: Labelled rows that features are counted in at most, chosen by hash of the id; bounds the join's broadcast.
LABEL_ROWS = 200_000
#: Label-1 texts that a feature must stand in, or a third of them where they are few.
MIN_TEXTS = 5
PREFIXES = (4, 5, 6)
EPOCHS = 500
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
#: Sentence ends beyond ASCII.
_STOPS = tuple(c.encode() for c in "。！？।؟…")


@dataclass
class Model:
    weight: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = -30.0


@dataclass
class Sentences:
    """Sentences of a slice of texts, and the features that stand in each (not yet distinct)."""

    text: np.ndarray  # the text that each sentence is of
    start: np.ndarray  # first byte, and end
    end: np.ndarray
    sentence: np.ndarray  # for each feature
    bucket: np.ndarray


def lowered(column: pa.Array) -> X.Texts:
    """Lower-case texts, code point by code point, so that places count alike."""
    return X.texts_of(pc.utf8_lower(column.cast(pa.large_string())))


def _marks(buf: np.ndarray, letter: np.ndarray, stop: np.ndarray) -> None:
    """Take punctuation beyond ASCII out of the letters, and put sentence ends beyond ASCII to the stops."""
    lead = np.flatnonzero((buf[:-1] >= 0xC2) & (buf[:-1] <= 0xEF))
    one, two = buf[lead], buf[lead + 1]
    short = lead[(one == 0xC2) | ((one == 0xD8) & (two == 0x9F))]
    wide = lead[((one == 0xE2) & (two <= 0x81)) | ((one == 0xE3) & (two == 0x80)) | ((one == 0xEF) & (two == 0xBC)) | ((one == 0xE0) & (two == 0xA5))]
    third = buf[np.minimum(wide + 2, len(buf) - 1)]
    # of the last two blocks only marks, not letters
    mark = (buf[wide] != 0xEF) & (buf[wide] != 0xE0) | (buf[wide] == 0xEF) & ((third <= 0x8F) | (third >= 0x9A) & (third <= 0xA0)) | (buf[wide] == 0xE0) & ((third == 0xA4) | (third == 0xA5))
    wide = wide[mark]
    for at, n in ((short, 2), (wide, 3)):
        for k in range(n):
            letter[np.minimum(at + k, len(buf) - 1)] = False
    for s in _STOPS:
        at = short if len(s) == 2 else wide
        hit = np.ones(len(at), bool)
        for k, b in enumerate(s):
            hit &= buf[np.minimum(at + k, len(buf) - 1)] == b
        stop[at[hit]] = True


def sentences_of(t: X.Texts) -> Sentences:
    letter, stop = _LETTER[t.buf], _STOP[t.buf]
    if len(t.buf):
        _marks(t.buf, letter, stop)
    w = X.runs_of(letter, t.off)
    owner, nth = w.owner(), np.cumsum(stop)[w.starts] if len(t.buf) else np.zeros(0, np.int64)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (nth[1:] != nth[:-1])
    first = np.flatnonzero(fresh)
    of_word = np.cumsum(fresh) - 1
    last = np.append(first[1:], len(owner))[: len(first)] - 1
    at, found = [of_word], [X.span_hashes(t.buf, w.starts, w.ends)]
    for k in PREFIXES:
        long = w.ends - w.starts > k
        at.append(of_word[long])
        found.append(X.mix(X.span_hashes(t.buf, w.starts[long], w.starts[long] + k) + np.uint64(k)))
    bucket = (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return Sentences(owner[first], w.starts[first], w.ends[last], np.concatenate(at), bucket)


def _distinct(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owner * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def _choose(rows: DataFrame, min_texts: int, min_z: float) -> np.ndarray:
    """Buckets that lead in label-1 texts, by the log of the ratio of shares and how many texts say so."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part, _ in X.slices(batch, "text"):
                y = part.column("y").to_numpy()
                s = sentences_of(lowered(part.column("text")))
                owner, bucket = _distinct(s.text[s.sentence], s.bucket)
                np.add.at(seen, (y[owner], bucket), 1)
                texts += np.bincount(y, minlength=2)
        at = np.flatnonzero(seen.sum(0))
        # the number of texts themselves goes under bucket -1
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(seen[0, at], texts[0])), pa.array(np.append(seen[1, at], texts[1]))], names=["f", "n0", "n1"])

    table = rows.select("text", "y").mapInArrow(spread, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    f, n0, n1 = (table.column(c).to_numpy() for c in ("f", "n0", "n1"))
    if not len(f):
        return np.zeros(0, np.int64)
    t0, t1 = int(n0[f < 0][0]), int(n1[f < 0][0])
    if not t0 or not t1:
        return np.zeros(0, np.int64)
    lead = np.log((n1 + 0.5) / t1 * t0 / (n0 + 0.5))
    return np.sort(f[(f >= 0) & (n1 >= min(min_texts, t1 / 3)) & (lead * np.sqrt(n1) >= min_z) & (lead >= np.log(MIN_RATIO))])


def sample_labels(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", rows: int = LABEL_ROWS) -> DataFrame:
    """(id, label): about ``rows`` of the labels at most, by a hash of the id, one for each id."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    n = one.count()
    if n <= rows:
        return one
    return one.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(5)), F.lit(1_000_000)) < rows / n * 1_000_000)


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, min_texts: int = MIN_TEXTS, min_z: float = MIN_Z) -> Model:
    """Fit on labelled rows, which are read once and kept in the shared folder while it lasts."""
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col).cast("string"), F.lit(3)).alias("h"))
    rows = written(rows, "toxicity-sample")
    chosen = _choose(rows, min_texts, min_z)
    if not len(chosen):
        forget(rows)
        return Model()
    number = np.full(BUCKETS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    shared = labelled.sparkSession.sparkContext.broadcast(number)
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < min(1.0, train_rows / rows.count()) * 1_000_000)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in X.slices(batch, "text"):
                s = sentences_of(lowered(part.column("text")))
                known = shared.value[s.bucket]
                at, feature = _distinct(s.sentence[known >= 0], known[known >= 0].astype(np.int64))
                n_features = np.bincount(at, minlength=len(s.text))
                has = n_features > 0
                n = part.num_rows
                sentences = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_features[has])]), pa.int32()), pa.array(feature, pa.int32()))
                texts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(s.text[has], minlength=n))]), pa.int32()), sentences)
                yield pa.record_batch([part.column("y"), pa.array(np.bincount(s.text[~has], minlength=n).astype(np.int64)), texts], names=["y", "empty", "known"])

    table = sample.select("text", "y").mapInArrow(bags, "y int, empty long, known array<array<int>>").toArrow()
    forget(rows)
    if not table.num_rows:
        return Model()
    texts = table["known"].combine_chunks()
    sentences = texts.flatten()
    weight, bias = fit(table["y"].to_numpy(), table["empty"].to_numpy(), np.diff(texts.offsets), np.diff(sentences.offsets), sentences.flatten().to_numpy(), len(chosen))
    every = np.zeros(BUCKETS, np.float32)
    every[chosen] = weight
    return Model(every, float(bias))


def fit(y: np.ndarray, empty: np.ndarray, n_sentences: np.ndarray, n_features: np.ndarray, feat: np.ndarray, k: int, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Adam on the texts' log loss.

    A text has ``n_sentences`` sentences with features, which have ``n_features``
    of ``feat`` each, and ``empty`` without any, which count by their number.
    """
    text_of = np.repeat(np.arange(len(y)), n_sentences)
    sent_of = np.repeat(np.arange(len(n_features)), n_features)
    w, b = np.zeros(k), -8.0
    share = max(y.mean(), 1e-3)
    scale = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3)) ** 0.5
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, epochs + 1):
        z = b + np.bincount(sent_of, weights=w[feat], minlength=len(n_features))
        p = 1 / (1 + np.exp(-z))
        p0 = 1 / (1 + np.exp(-b))
        log_none = np.bincount(text_of, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + empty * np.log1p(-p0)
        q = np.clip(1 - np.exp(log_none), 1e-9, 1)
        # d loss / d log_none, with loss = -log q or -log_none
        d = np.where(y == 1, (1 - q) / q, -1.0) * scale
        dz = d[text_of] * -p
        grad = np.append(np.bincount(feat, weights=dz[sent_of], minlength=k), dz.sum() - (d * empty).sum() * p0) / len(y)
        grad[:k] += decay * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w + -move[:k], min(b - move[k], -4.0)
    return w, b


def judged(t: X.Texts, m: Model) -> tuple[np.ndarray, Sentences, np.ndarray]:
    """(score of each text, its sentences, probability of each sentence)."""
    s = sentences_of(t)
    known = m.weight[s.bucket] != 0
    at, bucket = _distinct(s.sentence[known], s.bucket[known])
    z = m.bias + np.bincount(at, weights=m.weight[bucket], minlength=len(s.text))
    p = np.minimum(1 / (1 + np.exp(-z)), 1 - 1e-12)
    return 1 - np.exp(np.bincount(s.text, weights=np.log1p(-p), minlength=len(t))), s, p


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", sentence_limit: float = 0.5) -> DataFrame:
    """(id, score, n_sentences, n_offending, offending): offending sentences as (start, end, score) in code points."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, score double, n_sentences int, n_offending int, offending array<struct<start: long, end: long, score: double>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in X.slices(batch, "text"):
                t = lowered(part.column("text"))
                got, s, p = judged(t, shared.value)
                hit = p >= sentence_limit
                points = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
                base = points[t.off[s.text[hit]]]
                n = np.bincount(s.text[hit], minlength=len(t))
                places = pa.StructArray.from_arrays([pa.array(points[s.start[hit]] - base, pa.int64()), pa.array(points[s.end[hit]] - base, pa.int64()), pa.array(p[hit])], names=["start", "end", "score"])
                found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), places)
                yield pa.record_batch([part.column(0), pa.array(got), pa.array(np.bincount(s.text, minlength=len(t)), pa.int32()), pa.array(n, pa.int32()), found], names=["id", "score", "n_sentences", "n_offending", "offending"])

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in X.slices(batch, text_col):
                yield part.filter(pa.array(judged(lowered(part.column(text_col)), shared.value)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
