"""Token counts, mixing, packing and quality rules."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from subtide.llm import mixing, packing, quality, queries, token_counts

SF = "/root/testdata/sf0.001"

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_counts_equal_whole(name):
    tok = token_counts.tokenizer(public_tokenizers.path(name))
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "naïve", "ab" * 9, "x.y", "日本", "\n", "  ", "</s>", "<|endoftext|>"]) for _ in range(3000)), "ab" * 4000, " " * 5000, "a b  " * 2000]
    for text in texts:
        want = tok.counts([text])[0]
        for chunk, overlap in ((500, 20), (1500, 200)):
            assert token_counts.count_long(tok, text, chunk, overlap) == want


def test_token_counts(odd, nothing):
    tok = token_counts.tokenizer(MODEL)
    for chunk in (300, 40_000):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, MODEL, chunk_chars=chunk, overlap_chars=40).collect())
        want = sorted((str(r.doc_id), len((r.text or "").encode()), tok.counts([r.text or ""])[0]) for r in odd.collect())
        assert got == want
    assert token_counts.token_counts(nothing, MODEL).count() == 0


def sequential_targets(sizes):
    """Water filling by repeated capping."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * left / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        source = rng.choice(["big"] * 6 + ["b", "a", "é", "Z", None, "tiny"][: 6 if i % 50 == 0 else 5])
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)) or None, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = sequential_targets(dict(sizes))
    for cell_rows in (50_000, 20):
        got = mixing.mix_sizes(df, cell_rows=cell_rows).collect()
        again = mixing.mix_sizes(df.repartition(7), cell_rows=cell_rows).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))
        taken = Counter()
        by_id = {i: s for i, _, s in rows}
        for r in got:
            s = by_id[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
            taken[s] += r.taken
        for s in want:
            assert abs(taken[s] - want[s]) <= 130


def test_mixing_same_rows_when_salted(spark):
    rng = random.Random(14)
    df = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(0, 3)), rng.choice("abc")) for i in range(2000)], "doc_id long, text string, source string")
    whole, salted = (sorted(map(tuple, mixing.mix_sizes(df, cell_rows=n).collect())) for n in (50_000, 20))
    assert salted == whole


def test_mixing_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 3 + 1), "ab"[i % 2]) for i in range(120)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix_sizes(df, cell_rows=7).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", -1)
    assert sorted(map(tuple, mixing.mix_sizes(df, cell_rows=7).collect())) == want
    assert mixing.mix_rows(df, cell_rows=7).count() == sum(r[4] // r[1] for r in want)


def test_mixing_odd(odd, nothing):
    got = mixing.mix_sizes(odd).collect()
    assert len(got) == odd.count()
    rows = mixing.mix_rows(odd)
    assert rows.columns == odd.columns and rows.dtypes == odd.dtypes
    want = sum(r.taken for r in got)
    assert sum(len((r.text or "").split()) if " " not in (r.text or "") else len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows.collect()) == want
    assert mixing.mix_sizes(nothing).count() == 0 and mixing.mix_rows(nothing).count() == 0


def test_pack():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 4097, 3000)
    b, offset, cap = packing.pack(lengths, packing.CAPACITIES)
    used, bins = defaultdict(list), {}
    for i, k in enumerate(b):
        used[k].append((offset[i], lengths[i]))
        bins[k] = cap[i]
    for k, items in used.items():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= bins[k] and (bins[k] == 512 or at > bins[k] // 2)
    assert lengths.sum() / sum(bins.values()) > 0.97
    few = packing.pack(np.array([100, 90, 80]), packing.CAPACITIES)
    assert set(few[2]) == {512}


def test_pack_documents(odd, nothing):
    for shard in (20_000, 3):
        got = packing.pack_documents(odd, capacities=(64, 256), shard_pieces=shard).collect()
        total = sum(r.length for r in got)
        assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd.collect())
        room = defaultdict(int)
        for r in got:
            assert r.length <= 256 and r.bin_offset + r.length <= r.capacity
            room[r.shard, r.bin, r.capacity] += r.length
        assert all(n <= c for (_, _, c), n in room.items())
    assert packing.pack_documents(nothing).count() == 0


def brute_quality(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {j for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    base = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), base


def test_quality(odd, nothing):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.clean_lines(odd).collect())
    assert got == sorted((str(r.doc_id), *brute_quality(r.text)) for r in odd.collect())
    assert quality.clean_lines(nothing).count() == 0


def test_quality_lines(spark):
    good = "A plain sentence of words that ends as it should. " * 6 + "\n" + "Another line, with other words in it, says more of the same kind.\n"
    good += "\n".join(f"Line number {i} is new and has words {i * 7} to read." for i in range(8))
    bad = "Home | News | Sport | Contact\nAll rights reserved.\n" + good
    df = spark.createDataFrame([(1, good), (2, bad), (3, "word " * 80), (4, "%%% junk### " * 60 + ".")], "doc_id long, text string")
    r = {x.doc_id: x for x in quality.clean_lines(df, max_repeat_pct=100).collect()}
    assert r[1].kept and r[2].kept and r[2].n_lost_lines == 2 and "reserved" not in r[2].cleaned_text
    assert not r[3].kept and r[3].n_lost_words == 80 and not r[4].kept


def test_quality_other_scripts(spark):
    chinese = "\n".join(f"这是第{i}个句子，没有空格 但是有很多内容 和一些别的话 以及更多 的词。" for i in range(20))
    hindi = "\n".join(f"यह वाक्य संख्या {i} है और इसमें बहुत से शब्द हैं जो हर बार नए हैं।" for i in range(20))
    arabic = "\n".join(f"هل هذه هي الجملة رقم {i} وفيها كلمات كثيرة أخرى؟" for i in range(20))
    df = spark.createDataFrame([(1, chinese), (2, hindi), (3, arabic), (4, chinese.replace("。", ""))], "doc_id long, text string")
    r = {x.doc_id: x for x in quality.clean_lines(df, max_repeat_pct=100).collect()}
    assert all(r[i].kept and r[i].n_lost_words == 0 for i in (1, 2, 3)) and not r[4].kept


def test_mix_rows_by_contents(spark):
    """Rows of one id and size give the same copies however they are dealt."""
    rng = random.Random(17)
    rows = [(rng.choice([1, 2, None]), f"w{i} x{i % 7}", rng.choice("abc"), i) for i in range(300)]
    kind = "doc_id long, text string, source string, n long"
    want = None
    for parts in (1, 3, 8):
        rng.shuffle(rows)
        got = sorted(map(str, mixing.mix_rows(spark.createDataFrame(rows, kind).repartition(parts)).collect()))
        assert want is None or got == want
        want = got


def test_queries_run(spark):
    for name in ("op1_best_fit_packing", "op4_token_counts", "op8_source_mixing", "op9_quality_rules"):
        assert queries.QUERIES[name](spark, SF).count() >= 200


def plain_pack(lengths, caps, charge):
    """Best fit, longest first, by looking at every bin: (bin contents, final capacity), as a sorted list."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = []
    for at, i in enumerate(order):
        k = lengths[i]
        open_bins = [b for b in bins if b["size"] - b["used"] >= k and (b["size"] > b["used"])]
        if open_bins:
            b = min(open_bins, key=lambda b: (b["size"] - b["used"], b["nth"]))
        else:
            def price(c, at=at, k=k):
                rest = sum(lengths[j] for j in order[at + 1 :] if lengths[j] <= c - k)
                return (c + charge) / max(k + min(c - k, rest), 1)

            b = {"size": min((c for c in sorted(caps) if c >= k), key=price), "used": 0, "items": [], "nth": len(bins)}
            bins.append(b)
        b["items"].append(k)
        b["used"] += k
    return sorted((b["items"], min(c for c in caps if c >= b["used"])) for b in bins)


def test_pack_against_plain():
    rng = random.Random(14)
    for _ in range(60):
        lengths = [rng.choice([rng.randint(0, 16), rng.randint(1, 64)]) for _ in range(rng.randint(1, 60))]
        b, offset, cap = packing.pack(np.array(lengths, np.int64), (8, 16, 32, 64), 2.0)
        got = defaultdict(list)
        for i in np.lexsort((offset, b)):
            got[b[i]].append(int(i))
        found = sorted(([lengths[i] for i in sorted(items, key=lambda i: (-lengths[i], i))], int(cap[items[0]])) for items in got.values())
        assert found == plain_pack(lengths, (8, 16, 32, 64), 2.0)


def test_packed_texts_round_trip(odd, nothing):
    tok = token_counts.tokenizer(MODEL)
    got = packing.pack_texts(odd, MODEL, capacities=(64, 512), shard_pieces=7).collect()
    texts, bins = defaultdict(dict), defaultdict(list)
    for r in got:
        texts[(r.doc_id, r.row)][r.piece] = r.text
        bins[(r.shard, r.bin)].append((r.bin_offset, r.length, r.capacity))
        assert r.length == tok.counts([r.text or ""])[0] <= r.capacity
    back = Counter((i, None if x == {0: None} else "".join(x[k] for k in sorted(x))) for (i, _), x in texts.items())
    assert back == Counter((r.doc_id, r.text) for r in odd.collect())
    for items in bins.values():
        items.sort()
        assert [o for o, _, _ in items] == [sum(n for _, n, _ in items[:k]) for k in range(len(items))]
        assert sum(n for _, n, _ in items) <= items[0][2]
    assert packing.pack_texts(nothing, MODEL).count() == 0


def test_long_counts_in_proportion():
    """Texts without spaces, or without any stable place, take a few times the time of one encoding at most."""
    import time

    tok = token_counts.tokenizer(MODEL)
    rng = random.Random(15)
    for text in ("\n".join(f"line {rng.randint(0, 999)}" for _ in range(60_000)), "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(400_000)), "ab" * 200_000):
        began = time.perf_counter()
        want = tok.counts([text])[0]
        whole = time.perf_counter() - began
        assert token_counts.count_long(tok, text) == want
        assert time.perf_counter() - began - whole < 12 * whole + 2
