"""Periodic runs, decontamination and whitening against plain versions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from subtide.llm import contamination, periodic_runs, queries, whitening

SF = "/root/testdata/sf0.001"
BENCH = "item_id long, text string, doc_id long"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(ws, min_words=24, min_times=3):
    """Runs by comparing the words with themselves at each distance; of equal bounds the least period counts."""
    found = {}
    x = np.unique(np.array(ws, object).astype(str), return_inverse=True)[1] if ws else np.zeros(0, int)
    for p in range(1, len(ws) // min_times + 1):
        same = np.concatenate([[0], (x[:-p] == x[p:]).astype(int), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if b - a + p >= max(min_words, min_times * p):
                found.setdefault((int(a), int(b - a + p)), p)
    return sorted((a, n, p) for (a, n), p in found.items())


def collapsed(ws, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


@pytest.fixture(scope="module")
def repeats(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        ws = [rng.choice("ab" if i % 3 else "abcdefghij") for _ in range(rng.choice([0, 1, 30, 90]))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(ws))
            ws[at:at] = (unit * 30)[: rng.randint(2, 60)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    return spark.createDataFrame([*rows, (3, None), (None, rows[5][1]), (None, rows[5][1])], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("words", "times"), [(24, 3), (2, 2), (6, 4)])
def test_runs(repeats, words, times):
    got = periodic_runs.find_runs(repeats, min_words=words, min_times=times).collect()
    def wanted(r):
        ws = plain_words(r.text)
        runs = plain_runs(ws, words, times)
        return (str(r.doc_id), len(ws), [tuple(x) for x in runs], collapsed(ws, runs))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in got) == sorted(map(wanted, repeats.collect()))
    assert all(r.collapsed_sha256 == hashlib.sha256(r.collapsed_text.encode()).hexdigest() for r in got)


def test_runs_odd(odd, nothing, spark):
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs]) for r in periodic_runs.find_runs(odd).collect())
    assert got == sorted((str(r.doc_id), len(plain_words(r.text)), plain_runs(plain_words(r.text))) for r in odd.collect())
    assert periodic_runs.find_runs(nothing).count() == 0
    long = spark.createDataFrame([(1, " ".join(f"w{i % 1999}" for i in range(300_000)))], "doc_id long, text string")
    r = periodic_runs.find_runs(long).first()
    assert [tuple(x) for x in r.runs] == [(0, 300_000, 1999)] and len(r.collapsed_text.split()) == 1999


def planted_words(doc_id, text):
    ws = plain_words(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and ws:
        n, g = len(ws), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    return ws


def test_runs_query(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ws = planted_words(r.doc_id, r.text)
        runs = plain_runs(ws)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{p}\n" for a, n, p in sorted(runs, key=lambda x: (x[0], x[2])))), sha(collapsed(ws, runs))))
    got = queries.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == sorted(want)
    assert sum(x[1] for x in want) > 10


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_hits(docs, items, window=10):
    """By (id, text): number of words, words hit, items."""
    known = {}
    for item, text in items:
        ws = bench_words(text)
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            known.setdefault(tuple(ws[i : i + m]), set()).add(item)
    out = []
    for i, text in docs:
        ws, hit, named = bench_words(text), set(), set()
        for m in range(1, window + 1):
            for a in range(len(ws) - m + 1):
                if tuple(ws[a : a + m]) in known:
                    hit |= set(range(a, a + m))
                    named |= known[tuple(ws[a : a + m])]
        out.append((str(i), len(ws), sorted(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out)


@pytest.fixture(scope="module")
def test_items(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdef") + "!" for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 40])))) for i in range(25)]
    rows += [(None, "É é 7x"), (7, None), (3, rows[9][1]), (30, "A,b;C d")]
    docs = []
    for i in range(60):
        ws = [rng.choice("abcdefghij") for _ in range(rng.choice([0, 5, 200]))]
        for _ in range(rng.randint(0, 2)):
            ws[rng.randint(0, len(ws)) : 0] = bench_words(rng.choice(rows)[1])
        docs.append((i, rng.choice([" ", "--", "\n"]).join(ws)))
    docs += [(None, None), (5, docs[5][1]), (5, "É-É 7X é é 7x"), (None, docs[8][1])]
    return spark.createDataFrame([(*r, 1) for r in rows], BENCH), spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize(("block", "piece", "room"), [(200_000, 20_000, 1 << 27), (40, 20_000, 1), (40, 12, 1 << 27), (60, 15, 20_000)])
def test_hits(test_items, block, piece, room):
    items, docs = test_items
    got = contamination.contamination(docs, items, block_words=block, piece_words=piece, broadcast_bytes=room).collect()
    assert sorted((str(r.doc_id), r.n_words, [i for s in r.spans for i in range(s.a, s.b)], r["items"]) for r in got) == plain_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_hits_odd(odd, nothing, spark):
    none = spark.createDataFrame([], BENCH)
    assert contamination.contamination(nothing, odd, item_id_col="doc_id").count() == 0
    assert {len(r.spans) for r in contamination.contamination(odd, none).collect()} == {0}
    got = contamination.contamination(odd, odd.where("doc_id = 12 or doc_id = 9"), item_id_col="doc_id")
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.n_words, sum(s.b - s.a for s in r.spans), r["items"]))
    assert by[12] == [(6000, 6000, ["12"])] and by[10] == [(2, 2, ["9"])] and by[1] == [(0, 0, [])]


def test_decontaminate(spark, odd, nothing):
    item = "one two three four five six seven eight nine ten eleven"
    rest = " ".join(f"x{i}" for i in range(40))
    rows = [(1, f"{rest} - {item.upper()}, {rest}", 5), (2, f"{item} end", 6), (3, rest, 7), (None, f"{rest} {item}", 8), (4, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit_id int")
    out = contamination.decontaminate(docs, spark.createDataFrame([(1, item, 1)], BENCH))
    assert out.dtypes == docs.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(1, f"{rest} - , {rest}", 5), (3, rest, 7), (None, f"{rest} ", 8), (4, None, 9)], docs.schema).collect()))
    assert contamination.decontaminate(nothing, odd, item_id_col="doc_id").columns == nothing.columns


def test_hits_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = plain_hits([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    got = queries.op12_decontamination(spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == [(i, n, len(h), len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), bool(h)) for i, n, h, x in want]
    assert any(r.contaminated for r in got)


def plain_whitened(rows, scale=64, most=32):
    width = max(len(v) for _, v in rows)
    x = np.array([[np.floor(scale * c) for c in v] + [0.0] * (width - len(v)) for _, v in rows])
    z = x - x.mean(0)
    e, u = np.linalg.eigh(z.T @ z / len(x))
    keep = np.flatnonzero(e > 1e-9 * e.max())[::-1][:most]
    return z @ u[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum(), ((len(x) * x - x.sum(0)) ** 2).sum(1)


def compare(got, rows):
    w, share, far = plain_whitened(rows)
    assert len(got) == w.size
    table = {}
    for r in got:
        table.setdefault(r.component, []).append(r)
    for k in range(w.shape[1]):
        mine = sorted(table[k + 1], key=lambda r: r.vec_id)
        v = np.array([r.whitened for r in mine])
        assert np.allclose(v, w[:, k], atol=1e-8) or np.allclose(v, -w[:, k], atol=1e-8)
        assert {round(r.explained / share[k], 9) for r in mine} == {1.0} and max(r.identity_error for r in mine) < 1e-9
        assert [int(r.deviation) for r in mine] == far.astype(int).tolist() and {r.n for r in mine} == {len(rows)}


def test_whiten(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=9 if i % 7 else 6) * np.arange(1, 10)[: 9 if i % 7 else 6]]) for i in range(200)]
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 9), (903, [float("inf")] * 9)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows + odd], "vec_id long, embedding array<double>, component string").repartition(5)
    compare(whitening.whiten(df).collect(), rows)
    assert {r.component for r in whitening.whiten(df, most=4).collect()} == {1, 2, 3, 4}


def test_whiten_odd(spark):
    kind = "vec_id long, embedding array<float>"
    # equal roots, a root of 0, repeated rows and null ids
    rows = [(None if i < 2 else i, [float(x) for x in v]) for i, v in enumerate(np.vstack([np.eye(4, 5), -np.eye(4, 5)]).tolist() * 2)]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 64 and {round(r.explained, 12) for r in got} == {0.25} and max(r.identity_error for r in got) < 1e-12
    for few in ([], [(1, [1.0, 2.0])], [(1, [0.5]), (2, [0.5])], [(1, [])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(few, kind)).count() == 0
    wide = [(1, [1e15, 2.0]), (2, [3e15, -1.0]), (3, [5e15, 7.5])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()}
    assert abs(abs(got[1, 1].whitened) - 1.5**0.5) < 1e-9 and got[2, 1].deviation < 10**6 < 10**30 < got[1, 1].deviation
    with pytest.raises(Exception, match="62 bits"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>"))


def test_polynomial(spark):
    rng = random.Random(5)
    for d in (1, 2, 3, 6):
        x = [[rng.choice([0, 0, rng.randint(-9, 9)]) for _ in range(d)] for _ in range(d)]
        m = [[sum(x[k][i] * x[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
        c = whitening.characteristic_polynomial(spark, m)
        assert np.allclose(np.array(c[::-1], float), np.poly(np.array(m, float)), rtol=1e-6, atol=1e-3)
    # (t - 2)^2 (t - 5)
    c = [-20, 24, -9, 1]
    assert [whitening.kth_root(c, k, 100) for k in (1, 2, 3)] == [(5, 1, 1), (2, 2, 2), (2, 2, 2)]


def test_whiten_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    got = queries.op13_embedding_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(got.collect(), sorted(rows))
