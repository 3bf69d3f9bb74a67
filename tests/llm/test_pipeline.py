"""The stages of the corpus pipeline on small and odd input."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            seen.append(docs.count())
        else:
            assert out.count() >= seen[-1]
    assert seen[0] > seen[1] >= seen[2] > seen[3]
    assert 0.8 * seen[0] < seen[2]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empties, copies, long texts and clashing columns pass each stage; packed pieces give the texts back."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == odd.columns
        rows = out.collect()
        if name in ("toxicity", "line_dedup"):
            assert sum(not (r.text or "").strip() for r in rows) == 4
        docs = spark.createDataFrame(rows, out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {}
    for r in packed:
        texts.setdefault((r.doc_id, r.row), {})[r.piece] = r.text
    back = sorted((str(i), "".join(x[k] or "" for k in sorted(x))) for (i, _), x in texts.items())
    assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())


def brute_kept(texts, n, pct):
    """Least id of each component of texts linked by word n-grams."""
    sets = [{tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return set(root)


def test_near_copies_at_five_words(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(80, 120))]
        tail = [f"t{rng.randint(0, 400)}" for _ in range(len(base) // 5)]
        block = [f"b{rng.randint(0, 400)}" for _ in range(5)]
        apart = [f"c{i}" if i % 48 == 20 else w for i, w in enumerate(base)]
        for ws in (base, base + tail, base[:40] + block + base[45:], apart, base + tail + tail[::-1]):
            texts.append(" ".join(ws))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, df, SF).collect()}
    assert got == brute_kept(texts, 5, 80)
    assert got < brute_kept(texts, 4, 85)
