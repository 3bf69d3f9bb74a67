"""Line-first cleaning: drop failing lines, then documents that lose too much.

Each line with a word is judged by the rules below; failing lines go, and a
document is kept when its base counts pass and at most ``max_lost_pct`` percent
of its words stood in failing lines.

* symbols: more than one character of ``#*$%&|<>`` to ten characters of words
* punctuation: the line's last character is none of ``TERMINAL``, the marks that end a line in scripts of many kinds
* navigation: at most ``NAV_WORDS`` words and a menu separator or menu word
* boilerplate: a phrase of site furniture or licence notices
* repeated: equal to an earlier line of the text

Defined results: a null or empty text has zero counts, fails the base rule
(fewer than ``min_words`` words) and has empty cleaned text; null ids are kept
as null; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X

SYMBOLS = "#*$%&|<>"
# Marks that end a line, of Latin, Chinese and Japanese, Devanagari, Arabic, Armenian, Ethiopic, Khmer, Tibetan and Burmese writing.
TERMINAL = ".!?:;,\"')]}…»”’" + "。！？：；，、．」』）】》〉" + "।॥" + "؟؛،۔" + "։" + "።" + "។" + "།" + "။"
NAV_WORDS = 8
NAV_PATTERN = r"( [|>»•] .* [|>»•] )|^(home|menu|next|previous|login|sign in|sign up|search|contact|about|share|back to top)$"
BOILERPLATE_PATTERN = r"(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept cookies|enable javascript|subscribe to our|click here|^licensed under the |this work is licensed under|public license)"

_nav = re.compile(NAV_PATTERN)
_boiler = re.compile(BOILERPLATE_PATTERN)
_A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_SPACE = " \t\n\r\x0b\x0c"


def line_fails(line: str, n_words: int, word_chars: int, n_symbols: int) -> str | None:
    """The first rule that a line with a word fails, or None."""
    if 10 * n_symbols > word_chars:
        return "symbols"
    line = line.strip(_SPACE)
    if line[-1] not in TERMINAL:
        return "punctuation"
    low = line.translate(_A_TO_Z)
    if n_words <= NAV_WORDS and _nav.search(low):
        return "navigation"
    if _boiler.search(low):
        return "boilerplate"
    return None


def repeated_words(w: X.Words, h: np.ndarray) -> np.ndarray:
    """Per text, the words in 3-word windows that the text has twice or more."""
    covered = np.zeros(len(h) + 1, np.int64)
    ok = X.full_windows(w, 3)
    at = np.flatnonzero(ok)
    if len(at):
        owner = w.owner()[at].astype(np.uint64)
        key = X.mix(X.gram_hashes(h, 3)[at] ^ X.mix(owner + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        k = key[order]
        twin = np.zeros(len(k), bool)
        same = k[1:] == k[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        hit = at[order[twin]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 3, -1)
    return X.per_text_sum(np.cumsum(covered[:-1]) > 0, w.first)


def repeated_lines(lines: X.Words, h: np.ndarray) -> np.ndarray:
    """Per line with a word, whether an earlier line of its text is equal."""
    key = X.mix(h ^ X.mix(lines.owner().astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    k = key[order]
    later[order[1:]] = k[1:] == k[:-1]
    return later


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_lost_pct: int = 50, keep_text: bool = True) -> DataFrame:
    """One row per document: counts, verdict, words lost, and the cleaned text (``keep_text``)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_kind = rows.schema["id"].dataType.simpleString()
    kind = f"id {id_kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_lost_lines long"
    kind += ", cleaned_text string" if keep_text else ""
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in X.slices(batch, "text"):
                yield judged(part, t)

    def judged(part: pa.RecordBatch, t: X.Texts) -> pa.RecordBatch:
        w = X.words_of(t)
        h = X.span_hashes(t.buf, w.starts, w.ends)
        n_words = w.counts
        inside = ~X.IS_SPACE[t.buf] & ((t.buf & 0xC0) != 0x80)
        acc_chars = np.concatenate([[0], np.cumsum(inside)])
        acc_symbols = np.concatenate([[0], np.cumsum(symbol[t.buf])])
        lines = X.runs_of(t.buf != 10, t.off)
        at_word = np.searchsorted(w.starts, lines.starts), np.searchsorted(w.starts, lines.ends)
        has = at_word[1] > at_word[0]
        owner = lines.owner()[has]
        ls, le = lines.starts[has], lines.ends[has]
        k = (at_word[1] - at_word[0])[has]
        worded = X.Words(ls, le, np.searchsorted(ls, t.off))
        dup = repeated_lines(worded, X.span_hashes(t.buf, ls, le))
        chars, symbols = acc_chars[le] - acc_chars[ls], acc_symbols[le] - acc_symbols[ls]
        data = t.buf.tobytes()
        fails = dup.copy()
        for i in np.flatnonzero(~dup):
            fails[i] = line_fails(data[ls[i] : le[i]].decode(), int(k[i]), int(chars[i]), int(symbols[i])) is not None
        n = len(t)
        lost = np.bincount(owner, weights=k * fails, minlength=n).astype(np.int64)
        repeat = repeated_words(w, h)
        base = (n_words < min_words) | (100 * repeat > max_repeat_pct * n_words)
        kept = ~base & (100 * lost <= max_lost_pct * n_words)
        out = [
            part.column(0), n_words, acc_chars[t.off[1:]] - acc_chars[t.off[:-1]], acc_symbols[t.off[1:]] - acc_symbols[t.off[:-1]],
            np.bincount(owner, weights=dup, minlength=n).astype(np.int64), repeat, base, kept, lost, np.bincount(owner, weights=fails, minlength=n).astype(np.int64),
        ]
        if keep_text:
            good: list[list[str]] = [[] for _ in range(n)]
            for i in np.flatnonzero(~fails):
                good[owner[i]].append(data[ls[i] : le[i]].decode())
            out.append(["\n".join(x) for x in good])
        names = [f.split(" ")[0] for f in kind.split(", ")]
        return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    return rows.mapInArrow(judge, kind).withColumnRenamed("id", id_col)
