"""Language identification, toxicity and exact search."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subtide.llm import language_id, queries, topk, toxicity

SF = "/root/testdata/sf0.001"


def sequential_viterbi(score, switch):
    n, k = score.shape
    best, back = score[0].astype(float), []
    for t in range(1, n):
        move = [max(range(k), key=lambda j: best[j] - (switch if j != i else 0)) for i in range(k)]
        back.append(move)
        best = np.array([best[move[i]] - (switch if move[i] != i else 0) for i in range(k)]) + score[t]
    path = [int(best.argmax())]
    for move in reversed(back):
        path.append(move[path[-1]])
    return path[::-1], best.max()


def test_viterbi():
    rng = np.random.default_rng(1)
    lengths = [1, 7, 0, 40, 3]
    first = np.cumsum([0, *lengths])
    score = rng.normal(size=(first[-1], 3)).astype(np.float32) * 3
    got = language_id.viterbi(score, first, 2.0)

    def total(path, s):
        return sum(s[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            path, best = sequential_viterbi(score[a:b], 2.0)
            assert abs(total(got[a:b], score[a:b]) - best) < 1e-3


def test_language_accuracy(spark):
    docs = queries.table(spark, SF.replace("0.001", "0.01"), "documents").select("doc_id", "lang")
    got = queries.op2_language_id(spark, SF.replace("0.001", "0.01")).join(docs, "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97


def test_language_spans(spark, odd, nothing):
    docs = queries.table(spark, SF, "documents")
    model = language_id.train(docs)
    english, german = ("the and of that with " * 40).strip(), ("der und die nicht einer " * 40).strip()
    df = spark.createDataFrame([(1, english + " " + german), (2, "12 34 !"), (3, None), (4, "日本語")], "doc_id long, text string")
    r = {x.doc_id: x for x in language_id.identify(df, model).collect()}
    assert [s.lang for s in r[1].spans] == ["en", "de"] and 0.4 < r[1].score < 0.6
    assert abs(r[1].spans[0].end - len(english)) < 30
    assert r[2].lang_pred == r[3].lang_pred == "und" and r[2].score == 0
    # a script of no known language tells nothing: the first language, by ties
    assert r[4].lang_pred == model.languages[0]
    assert language_id.identify(odd, model).count() == odd.count()
    assert language_id.identify(nothing, model).count() == 0
    untrained = language_id.train(nothing)
    assert {x.lang_pred for x in language_id.identify(odd, untrained).collect()} == {"und"}


def test_long_text_in_parts(spark, monkeypatch):
    model = language_id.train(queries.table(spark, SF, "documents"))
    code = language_id.code_points("the quick und der " * 200)
    whole = language_id.scan(code)
    parts = [(a + s.starts).tolist() for a, c in language_id.pieces(code, 100) for s in [language_id.scan(c)]]
    assert sum(parts, []) == whole.starts.tolist()
    scores = np.concatenate([model.word_scores(language_id.scan(c)) for _, c in language_id.pieces(code, 100)])
    assert np.allclose(scores, model.word_scores(whole), atol=1e-4)


def test_toxicity(spark, odd, nothing):
    rng = random.Random(2)
    plain = [f"w{i}word" for i in range(60)]
    rows = []
    for i in range(400):
        sentences = [" ".join(rng.choices(plain, k=6)) for _ in range(rng.randint(1, 6))]
        bad = i % 5 == 0
        if bad:
            sentences.insert(rng.randint(0, len(sentences)), "you " + rng.choice(["vilexa", "vilexbo", "rotten"]) + " thing")
        rows.append((i, ". ".join(sentences) + ".", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 300"))
    got = {r.doc_id: r for r in toxicity.score(df.drop("toxic"), model).collect()}
    right = sum((got[i].score >= 0.7) == bool(y) for i, _, y in rows if i >= 300)
    assert right >= 97
    for i, text, y in rows:
        if y and got[i].score >= 0.7:
            assert any(w in text[s.start : s.end] for s in got[i].offending for w in ("vilex", "rotten"))
    kept = {r.doc_id for r in toxicity.clean_rows(df, model).collect()}
    assert kept == {i for i in got if got[i].score < 0.7}
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(nothing, model).count() == 0
    assert toxicity.clean_rows(odd, model).columns == odd.columns
    assert {r.score for r in toxicity.score(odd.where("text is null or text = ''"), model).collect()} == {0.0}
    untrained = toxicity.train(df.where("toxic = 0"))
    assert toxicity.score(df, untrained).agg(F.max("score")).first()[0] < 1e-6


def test_unseen_suffix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=8)) + (f" grum{rng.randint(0, 999)}x".replace("0", "q").translate({ord(str(d)): chr(97 + d) for d in range(10)}) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    df = spark.createDataFrame([(1, "aa bb grumzzy cc"), (2, "aa bb cc")], "doc_id long, text string")
    r = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    assert r[1] > 0.7 > r[2]


def brute_top(rows, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, v + [0] * (width - len(v))) for i, v in usable]
    out = []
    for q, v in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in usable if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # one common vector: ties
    rows += [(2000, None), (2001, []), (2002, [None] + [0.0] * 7), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2100, [0.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    for bins, block, held in ((4096, 2048, topk.HELD), (16, 37, topk.HELD), (16, 37, 0)):
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, 10, bins=bins, candidate_rows=block, query_rows=2, most_held=held).collect()))
        assert got == brute_top(rows, 10)


def test_top_k_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, 10).collect())) == [(0, 1, 1, 1572864), (0, 2, 2, -1048576)]
    assert topk.top_k(df.where("vec_id < 0"), F.lit(True), 10).count() == 0
    assert topk.top_k(df, F.lit(False), 10).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.lit(True), 10).count() == 0
    large = spark.createDataFrame([(0, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="passes 63 bits"):
        topk.top_k(large, F.col("vec_id") == 0, 10).count()


def test_top_k_large(spark):
    """Components of any size: exact where the score fits a long, an error that names the pair where it does not."""
    kind = "vec_id long, embedding array<double>"
    rows = [(0, [1.0] * 64), (1, [1e12] + [0.0] * 63), (2, [-1e12] + [0.5] * 63), (3, [0.0] * 64), (100, [0.0, 1e300] + [0.0] * 62), (4, [7.0, 0.0, 3.0] + [0.0] * 61), (5, [1.0, 0.0, 2.0**-10] + [9.0] * 61)]
    top = lambda x: sorted(map(tuple, topk.top_k(spark.createDataFrame(x, kind), F.col("vec_id") % 100 == 0, 10).collect()))
    assert top(rows[:4]) == brute_top(rows[:4], 10) and top(rows[:4])[0][3] == 1024 * 1_024_000_000_000_000
    apart = [rows[3], *rows[4:]]
    assert top(apart) == brute_top(apart, 10)
    for a, b in ((-1e300, -1e300), (1e300, 1.0), (3e9, -3e12)):
        with pytest.raises(Exception, match="vectors 0 and 8 passes 63 bits"):
            top([(0, [a]), (8, [b])])
    edge = [(0, [2.0**21]), (1, [2.0**22]), (2, [-(2.0**22)])]  # 2^63 is too much, -2^63 is not
    assert top([edge[0], edge[2]]) == [(0, 1, 2, -(1 << 63))]
    with pytest.raises(Exception, match="passes 63 bits"):
        top(edge[:2])


def test_language_marks_without_letters(spark):
    model = language_id.train(queries.table(spark, SF, "documents"))
    texts = ["❤️ 12", "12 ́", "☺️☺️", "́", "7̈ ÷ ️", "नमस्ते", "e\u0301 ❤️", "x️y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = {x.doc_id: x for x in language_id.identify(df, model).collect()}
    assert [(r[i].lang_pred, r[i].score, r[i].n_spans) for i in range(5)] == [("und", 0.0, 0)] * 5
    assert all(r[i].lang_pred != "und" and r[i].score > 0 for i in (5, 6, 7))
    scanned = language_id.scan(language_id.code_points(" ".join(texts)))
    words = [" ".join(texts)[a:b] for a, b in zip(scanned.starts, scanned.ends, strict=True)]
    assert words == ["नमस्ते", "e\u0301", "x️y"]


def test_wide_products():
    big = np.array([[1 << 30, 3]], np.int64)
    assert topk.products(big, big)[0, 0] == (1 << 60) + 9


def test_language_every_value_is_learned(spark):
    rows = [(i, f"palabra{i % 210} wort{i % 210}", f"l{i % 210:03}") for i in range(420)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert model.languages == sorted({r[2] for r in rows})


def test_language_marks_and_unspaced(spark):
    hindi = "नमस्ते दुनिया यह हिन्दी वाक्य"
    assert len(language_id.scan(language_id.code_points(hindi)).starts) == 5
    mixed = "日本語のテキストとEnglish"
    s = language_id.scan(language_id.code_points(mixed))
    assert len(set(s.script.tolist())) == 3 and (s.ends - s.starts).max() <= language_id.CUT
    assert (s.starts[1:] >= s.ends[:-1]).all() and s.ends[-1] == len(mixed)


def test_language_long_run(spark):
    """One run of 5 million letters stays one word, with the score of one sum."""
    model = language_id.train(queries.table(spark, SF, "documents"))
    text = "abcdefghij" * 500_000
    code = language_id.code_points(text)
    assert len(list(language_id.pieces(code))) == 1
    s = language_id.scan(code)
    assert len(s.starts) == 1
    got = model.word_scores(s)[0]
    mean = model.log_p[s.bucket].astype(np.float64).mean(0) * 8
    assert np.allclose(got, mean - mean.max(), atol=1e-2)


def test_noisy_or_by_hand(spark, odd):
    """Scores and offending sentences are those of a plain reckoning with the model's weights."""
    import re

    rows = [(i, f"aa bb. {'grumf cc' if i % 3 == 0 else 'dd ee'}! bb cc", int(i % 3 == 0)) for i in range(120)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    text = "Aa GRUMF cc. bb\ncc dd? grumf grumf 12 ee"

    def bucket(word, k=None):
        t = toxicity.lowered(pa.array([word]))
        s = toxicity.sentences_of(t)
        return s.bucket.tolist()

    none, want = 1.0, []
    for m in re.finditer(r"[^.!?\n]+", text):
        features = {b for w in re.findall("[a-zA-Z]+", m[0]) for b in bucket(w)}
        p = 1 / (1 + np.exp(-(model.bias + sum(float(model.weight[b]) for b in features))))
        none *= 1 - p
        if p >= 0.5:
            want.append((text.index(m[0].strip()), round(p, 6)))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = toxicity.score(df, model).first()
    assert abs(r.score - (1 - none)) < 1e-6 and r.n_sentences == 4
    assert [(s.start, round(s.score, 6)) for s in r.offending] == want and len(want) == 2
