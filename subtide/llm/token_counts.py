"""Token counts of whole texts with overlap resynchronisation for huge ones.

Texts up to ``chunk_chars`` go to the tokenizer library as they are. A longer
text is cut into overlapping chunks; each chunk is encoded with offsets and two
neighbours are spliced at a token boundary that both encodings have and that is
proven stable. For a sentencepiece model that leaves characters as they are, that
is any place whose two characters never stand next to each other inside a
vocabulary piece, so no merge crosses it whatever stands around; for others, a
space between letters or digits, if the tokenizer is known to split there before
it merges. The overlap reaches back to such a place; where a stretch has none it
grows to twice its length, up to the whole text. So counts are always those of
one whole encoding, and the work is in proportion to the text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
give repeated rows; an empty table gives an empty table; other columns of the
input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import _text as X

CHUNK_CHARS = 40_000
OVERLAP_CHARS = 400


#: Pre-tokenizers that always split at a space between letters or digits. Byte-level ones do if they use their pattern.
SPLITTERS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer", "Metaspace", "ByteLevel"}


class Tokenizer:
    """One public tokenizer file: ``counts`` tokens of texts, ``ends`` where they end."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
            self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
            model = sentencepiece_model_pb2.ModelProto()
            model.ParseFromString(self.sp.serialized_model_proto())
            rules = model.normalizer_spec
            self.as_is = rules.name == "identity" and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
            self.splits = True
        else:
            from tokenizers import Tokenizer as Hf

            self.hf = Hf.from_file(path)
            self.hf.no_padding()
            self.hf.no_truncation()
            self.inside, self.as_is = set(), False
            with open(path, encoding="utf-8") as f:
                first = json.load(f).get("pre_tokenizer") or {}
            parts = first.get("pretokenizers", [first])
            self.splits = any(x.get("type") in SPLITTERS and x.get("use_regex", True) for x in parts)

    def counts(self, texts: list[str]) -> list[int]:
        if hasattr(self, "sp"):
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        return [len(x.ids) for x in self.hf.encode_batch(texts, add_special_tokens=False)]

    def ends(self, text: str) -> list[int]:
        """Where each token ends in the text, in order."""
        if hasattr(self, "sp"):
            return [b for _, b in self.sp.encode(text, return_type="offset_mapping")["offsets"]]
        return [b for _, b in self.hf.encode(text, add_special_tokens=False).offsets]

    def stable(self, text: str, p: int) -> bool:
        """No token of any encoding crosses p."""
        if not 0 < p < len(text) - 1:
            return False
        if self.as_is:
            return text[p - 1 : p + 1].replace(" ", "▁") not in self.inside
        # a plain word ends and a single space begins the next
        return self.splits and text[p] == " " and text[p - 1].isalnum() and text[p + 1].isalnum() and text[p - 1] + "▁" not in self.inside


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def splice(tok: Tokenizer, text: str, left: tuple[int, list[int]], right: tuple[int, list[int]]) -> tuple[int, int, int] | None:
    """(position, tokens of left up to it, tokens of right up to it) at the first stable boundary of both."""
    a, ends_a = left
    b, ends_b = right
    at_a = {a + e: i + 1 for i, e in enumerate(ends_a) if a + e >= b}
    for i, e in enumerate(ends_b[:-1]):
        p = b + e
        if p in at_a and at_a[p] < len(ends_a) and ends_b[i + 1] > e and tok.stable(text, p):
            return p, at_a[p], i + 1
    return None


def count_long(tok: Tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of one text, in chunks; equal to one encoding of the whole text."""
    n = len(text)
    if n <= chunk:
        return tok.counts([text])[0]
    a, b = 0, chunk
    ends, skip, total = tok.ends(text[:b]), 0, 0
    while b < n:
        found = None
        place = next((p for p in range(b - 1, a, -1) if tok.stable(text, p)), None)
        to = min(n, b + max(chunk, b - a if place is None else 0))
        wide = overlap + b - (place or b)
        while place is not None and found is None and b - wide > a:
            start = b - wide
            nxt = tok.ends(text[start:to])
            found = splice(tok, text, (a, ends), (start, nxt))
            if found is not None and found[1] < skip:
                found = None
            wide *= 2
        if found is None:  # no stable boundary in the stretch: one encoding goes on over the next, as long again
            to = min(n, b + max(chunk, b - a))
            ends = tok.ends(text[a:to])
        else:
            total += found[1] - skip
            a, ends, skip = start, nxt, found[2]
        b = to
    return total + len(ends) - skip


def cut_pieces(tok: Tokenizer, text: str, most: int, chunk: int = CHUNK_CHARS) -> list[tuple[str, int]]:
    """(part, tokens): the text in parts of at most ``most`` tokens each, cut before white space where a part has some."""
    out, a = [], 0
    while a < len(text):
        part = text[a : a + chunk]
        ends = tok.ends(part)
        if len(ends) > most:
            part = _before_space(part, ends[most - 1])
        k = tok.counts([part])[0]
        while k > most and len(part) > 1:  # a part by itself may have more tokens than in its place
            part = _before_space(part, len(part) - max(1, len(part) * (k - most) // k))
            k = tok.counts([part])[0]
        out.append((part, k))
        a += len(part)
    return out


def _before_space(text: str, end: int) -> str:
    at = max(text.rfind(" ", 1, end), text.rfind("\n", 1, end))
    return text[: at if at > 0 else max(end, 1)]


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_chunked) of every text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part, _ in X.slices(batch, "text"):
                texts = [x or "" for x in part.column(1).to_pylist()]
                short = [i for i, x in enumerate(texts) if len(x) <= chunk_chars]
                n = [0] * len(texts)
                for i, k in zip(short, tok.counts([texts[i] for i in short]), strict=True):
                    n[i] = k
                for i, x in enumerate(texts):
                    if len(x) > chunk_chars:
                        n[i] = count_long(tok, x, chunk_chars, overlap_chars)
                yield pa.record_batch(
                    [part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array([len(x) > chunk_chars for x in texts])],
                    names=["id", "n_bytes", "n_tokens", "over_limit", "chunked"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, chunked boolean").withColumnRenamed("id", id_col)
