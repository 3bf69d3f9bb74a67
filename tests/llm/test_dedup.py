"""Passages, lines, near duplicates and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from subtide.llm import _graph, line_dedup, ngram_jaccard, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def brute_passages(rows, k):
    """(id, n_words, n_removed, digest) by window tuples."""
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [LAST if i is None else i for i, _ in rows]
    first = {}
    for i, ws in zip(ids, words, strict=True):
        for o in range(len(ws) - k + 1):
            w = tuple(ws[o : o + k])
            first[w] = min(first.get(w, LAST), i)
    out = []
    for (raw, _), i, ws in zip(rows, ids, words, strict=True):
        gone = {j for o in range(len(ws) - k + 1) if first[tuple(ws[o : o + k])] < i for j in range(o, o + k)}
        kept = [w for j, w in enumerate(ws) if j not in gone]
        out.append((str(raw), len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def run_passages(df, k, m):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_passages(df, k=k, m=m, keep_text=False).collect())


def test_passages_odd(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run_passages(odd, 50, 8) == brute_passages(rows, 50)
    assert substring_dedup.remove_passages(nothing).count() == 0


def test_passages_random(spark):
    rng = random.Random(4)
    shared = [[rng.choice("abcdef") + str(rng.randint(0, 9)) for _ in range(rng.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(150):
        ws = []
        for _ in range(rng.randint(0, 5)):
            ws += rng.choice(shared)[rng.randint(0, 4) :] if rng.random() < 0.6 else [rng.choice("xyz") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 15))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run_passages(df, 10, 3) == brute_passages(rows, 10)


def test_bucket_in_parts(monkeypatch):
    rng = random.Random(5)
    strings = list({" ".join(rng.choice("ab") for _ in range(rng.randint(6, 12))).encode() for _ in range(40)})
    ids = [rng.randint(0, 9) for _ in strings]
    whole = substring_dedup.bucket_runs(strings, ids, 5)
    monkeypatch.setattr(substring_dedup, "SORT_WINDOWS", 17)
    assert substring_dedup.bucket_runs(strings, ids, 5) == whole


def brute_lines(rows, n, long_words):
    """Text of each row without later copies; rows with one id and text are one."""
    texts = {}
    for i, t in rows:
        texts.setdefault((LAST if i is None else i, t or ""), None)
    order = []
    for i, t in texts:
        worded = [x for x in t.split("\n") if WORD.search(x)]
        order.append(((i, t), worded))
    same_id = defaultdict(int)
    for (i, _), _ in order:
        same_id[i] += 1
    seen, gone = {}, defaultdict(set)
    for key, worded in sorted(order, key=lambda x: x[0][0]):
        for o in range(len(worded)):
            for k in {1, n}:
                run = tuple(worded[o : o + k])
                if len(run) < k or (k == 1 and k < n and len(WORD.findall(run[0])) < long_words):
                    continue
                if (k, run) in seen:
                    gone[key] |= set(range(o, o + k))
                seen.setdefault((k, run), (key, o))
    out = {}
    for key, _ in order:
        kept, at = [], 0
        for line in key[1].split("\n"):
            if WORD.search(line):
                if at not in gone[key]:
                    kept.append(line)
                at += 1
            else:
                kept.append(line)
        out[key] = "\n".join(kept)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_lines_random(spark, n):
    rng = random.Random(6)
    pool = [f"line {i} of words" for i in range(12)] + [" ".join(["long"] * 60 + [str(i)]) for i in range(2)]
    rows = [(i, "\n".join(rng.choice(pool + ["", " "]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows, n, 50)
    got = {(r.doc_id, dict(rows)[r.doc_id]): r.text for r in line_dedup.dedup_lines(df, min_lines=n).collect()}
    assert got == want
    kept = {r.doc_id for r in line_dedup.dedup_rows(df, min_lines=n).collect()}
    assert kept == {i for (i, t), x in want.items() if x == t or WORD.search(x)}


def test_maximal_runs(spark):
    """Planted runs of 2 to 40 lines are found whole, at their places, beside their first copies."""
    rng = random.Random(13)
    n = iter(range(100_000))
    fresh = lambda k: [f"only {next(n)} here" for _ in range(k)]
    rows, want = [], []
    for k in range(2, 41):
        run, before, after = [f"run {k} line {i}" for i in range(k)], rng.randint(0, 3), rng.randint(0, 3)
        rows.append((10 * k, fresh(before) + run + fresh(1)))
        rows.append((10 * k + 1, fresh(after) + [""] + run + fresh(2)))
        want.append((10 * k + 1, after, after + k, 10 * k, before))
        if k % 3 == 0:  # a third copy of the middle only
            rows.append((10 * k + 2, run[1:-1] if k > 3 else fresh(1)))
            want += [(10 * k + 2, 0, k - 2, 10 * k, before + 1)] * (k > 3)
    df = spark.createDataFrame([(i, i, "\n".join(ls)) for i, ls in rows], "id long, row long, text string")
    got = sorted((r.id, r.a, r.b, r.first_id, r.first_a) for r in line_dedup.repeated_runs(df).collect())
    assert got == sorted(want)


def brute_runs(texts, least):
    """Later copies by their longest match with any earlier suffix; (id, a, b, first id, first a)."""
    places = [(i, o) for i, ls in sorted(texts.items()) for o in range(len(ls))]
    out = []
    for n, (i, o) in enumerate(places):
        best = (0, None)
        for j, q in places[:n]:
            k = 0
            while o + k < len(texts[i]) and q + k < len(texts[j]) and texts[i][o + k] == texts[j][q + k]:
                k += 1
            if k > best[0]:
                best = (k, (j, q))
        if best[0] >= least:
            out.append((i, o, o + best[0], *best[1]))
    return sorted(x for x in out if not any(y[0] == x[0] and y != x and y[1] <= x[1] and y[2] >= x[2] for y in out))


@pytest.mark.parametrize(("seed", "letters", "least"), [(21, 3, 2), (22, 9, 2), (23, 5, 3)])
def test_runs_against_all_suffixes(spark, seed, letters, least):
    """Random texts, not planted runs: prefixes of any length, whose copies go on elsewhere for longer or shorter."""
    rng = random.Random(seed)
    stock = [rng.randint(1, letters) for _ in range(60)]
    texts = {}
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 3)):
            o = rng.randint(0, 50)
            lines += stock[o : o + rng.randint(1, 30)] if rng.random() < 0.7 else [rng.randint(1, letters) for _ in range(rng.randint(1, 6))]
        texts[i] = [f"line {x}" for x in lines]
    texts[50], texts[51], texts[52] = ["A", "B", "X"], ["A", "B", "C", "Y"], ["A", "B", "C", "Z"]
    df = spark.createDataFrame([(i, i, "\n".join(ls)) for i, ls in texts.items()], "id long, row long, text string")
    got = sorted((r.id, r.a, r.b, r.first_id, r.first_a) for r in line_dedup.repeated_runs(df, least).collect())
    assert got == brute_runs(texts, least)
    assert (52, 0, 3, 51, 0) in got and ((51, 0, 2, 50, 0) in got) == (least == 2)


def test_lines_odd(odd, nothing):
    rows = line_dedup.dedup_rows(odd)
    assert rows.columns == odd.columns
    got = rows.collect()
    # copies of the 120-word line go, but those of one id lose nothing to each other
    assert {r.doc_id for r in got if r.text and r.text.startswith("new line")} == {8}
    assert sum(r.doc_id == 4 for r in got) == 1 and not any(r.doc_id == 5 for r in got)
    assert any(r.doc_id == 1 and r.text is None for r in got) and any(r.text == "" for r in got)
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    assert line_dedup.dedup_rows(nothing).count() == 0 and line_dedup.dedup_lines(nothing).count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        line_dedup.later_copies(odd, min_lines=0)


def shingle_set(text, n=4):
    ws = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def brute_components(rows, pct=85, n=4):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= pct * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), LAST), LAST if d is None else d)
    return sorted((str(d), len(sets[i]), str(None if least[root(i)] == LAST else least[root(i)])) for i, (d, _) in enumerate(rows))


def run_components(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard.jaccard_components(df).collect())


def test_components_odd(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run_components(odd) == brute_components(rows)
    assert ngram_jaccard.jaccard_components(nothing).count() == 0


def test_components_random(spark):
    rng = random.Random(7)
    rows = []
    for g in range(8):
        base = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 120))]
        for _ in range(14):
            ws = list(base)
            for _ in range(rng.randint(0, 5)):
                if ws:
                    ws[rng.randrange(len(ws))] = f"W{rng.randint(0, 60)}"
            base = ws if rng.random() < 0.5 else base  # chains drift from their first text
            rows.append((len(rows) + g, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run_components(df) == brute_components(rows)


def test_keep_one(odd, nothing):
    got = ngram_jaccard.keep_one(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    # one of the copies 4, 5, 5 and null, and the near copy 6; empty sets all stay
    assert sum(1 for r in rows if r.text and r.text.startswith(odd.where("doc_id = 4").first().text[:40])) == 1
    assert sum(1 for r in rows if not (r.text or "").strip()) == 4
    assert ngram_jaccard.keep_one(nothing).count() == 0


def near_copies(rng, n, words=150):
    """Copies of one text with some words replaced, of a small vocabulary of replacements, and some cut short."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(words)] = f"x{rng.randint(0, 3)}"
        out.append(" ".join(ws[: rng.randint(words - 12, words)]))
    return out


@pytest.mark.parametrize(("n", "pct"), [(4, 85), (5, 80)])
def test_one_large_group(spark, n, pct):
    rng = random.Random(10)
    texts = near_copies(rng, 500) + [" ".join(f"y{rng.randint(0, 900)}" for _ in range(100)) for _ in range(20)]
    rows = list(enumerate(texts))
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, pct=pct)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows, pct, n)


def test_meetings_of_copies_too_far_apart(spark, monkeypatch):
    """Copies of a text that is not there, most of which do not link: they meet few others, not all."""
    rng = random.Random(14)
    base, texts = [f"w{i}" for i in range(63)], []
    for i in range(160):
        ws = list(base)
        ws[rng.randint(5, 57)] = f"x{i}"
        texts.append(" ".join(ws))
    asked, written = [], ngram_jaccard.written

    def counted(df, name):
        out = written(df, name)
        if name == "jaccard-asking":
            asked.append(out.count())
        return out

    monkeypatch.setattr(ngram_jaccard, "written", counted)
    rows = list(enumerate(texts))
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=5, pct=80)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows, 80, 5)
    assert asked[0] <= len(texts)


@pytest.mark.parametrize(("seed", "n", "pct", "most"), [(31, 5, 80, 3), (32, 4, 85, 4), (33, 2, 60, 9), (34, 3, 95, 2)])
def test_families(spark, seed, n, pct, most):
    """Copies around texts that are there or not, changed more or less, cut, longer, and mixed of two texts."""
    rng = random.Random(seed)
    bases = [[f"{b}{i}" for i in range(rng.randint(50, 90))] for b in "abc"]
    bases.append(bases[0][:40] + bases[1][:40])
    texts = [" ".join(bases[0])]
    for i in range(260):
        ws = list(rng.choice(bases))
        for _ in range(rng.randint(0, most)):
            ws[rng.randrange(len(ws))] = rng.choice([f"x{i}", f"y{rng.randint(0, 5)}"])
        if rng.random() < 0.2:
            ws = ws[rng.randint(0, 9) : len(ws) - rng.randint(0, 9)]
        if rng.random() < 0.2:
            ws += [f"t{k}" for k in range(rng.randint(1, 12))]
        texts.append(" ".join(ws))
    rows = list(enumerate(texts))
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, pct=pct)
    want = brute_components(rows, pct, n)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == want
    assert len({c for _, _, c in want}) > 5


def test_graph(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
