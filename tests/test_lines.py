"""Detection and repair against plain sequential descriptions, on random cases."""

import random

import pytest
from pyspark.sql import functions as F

from subtide.operators import detect, repair
from subtide.schema import Params

LINES = "media_id long, line_ix long, start_ms long, end_ms long, style string, text string, speaker string"


def frame(spark, rows):
    return spark.createDataFrame([(m, i, a, b, s, t, "Unknown") for m, i, a, b, s, t in rows], LINES)


def random_media(rng, m, negative=False):
    rows, at = [], 0
    for i in range(rng.randint(1, 40)):
        at += rng.choice([0, 0, 100, 900])
        dur = rng.choice([0, 40, 90, 100, 101, 700, 1500, 12000] + ([-300] if negative else []))
        rows.append((m, i, at, at + dur, rng.choice("AB"), rng.choice(["", " ", "x", "some words", "a much longer text that needs time"])))
        at += max(dur, 0)
    return rows


def sequential_mistimed(rows, p):
    n = len(rows)
    short = [(r[3] - r[2]) / 1000 <= p.mistimed_line_thresh_sec for r in rows]
    flags = {i for i in range(n) if short[i] or (0 < i < n - 1 and short[i - 1] and short[i + 1])}

    def groups_of(indices, least):
        out, run = [], []
        for i in sorted(indices):
            if run and i != run[-1] + 1:
                out.append(run)
                run = []
            run.append(i)
        if run:
            out.append(run)
        return [(g[0], g[-1]) for g in out if len(g) >= least]

    grown = []
    for a, b in groups_of(flags, p.seg_min_lines):
        for k in range(1, p.seg_backtrace_limit + 1):
            if a - k < 0:
                a = 0
                break
            if rows[a - k][3] - rows[a - k][2] > p.seg_min_delay_sec * 1000:
                a = a - k
                break
        for k in range(1, p.seg_foretrace_limit + 1):
            if b + k >= n:
                b = n - 1
                break
            if rows[b + k][3] - rows[b + k][2] > p.seg_min_delay_sec * 1000:
                b = b + k
                break
        grown.append((a, b))
    merged = []
    for a, b in grown:
        if merged and a - merged[-1][1] <= p.seg_max_gap + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return flags | {i for a, b in merged for i in range(a, b + 1)}, groups_of


def sequential_fix(rows, p):
    flags, groups_of = sequential_mistimed(rows, p)
    rows = [list(r) for r in rows]
    for a, b in groups_of(flags, 1):
        run = range(a, b + 1)
        if a == 0:
            if b + 1 < len(rows):
                rows[b + 1][5] = " ".join(rows[j][5] for j in run) + " " + rows[b + 1][5]
                rows[b + 1][2] = rows[0][2]
                for j in run:
                    rows[j][5] = ""
            continue
        members = [a - 1, *run]
        sizes = [len(rows[j][5]) for j in members]
        if not sum(sizes):
            continue
        at, whole = rows[a - 1][2], rows[b][3] - rows[a - 1][2]
        for j, k in zip(members, sizes, strict=True):
            rows[j][2] = at
            at += int(whole * (k / sum(sizes)))
            rows[j][3] = at
    return [tuple(r) for r in rows]


def sequential_pad(rows, p):
    rows = [list(r) for r in rows]
    for i, r in enumerate(rows):
        size = len(r[5])
        dur = max(size / p.max_cps * 1000, p.min_sec * 1000)
        until = min(r[2] + dur, r[3] + p.max_lead_out_sec * 1000)
        if not size or until <= r[3]:
            continue
        after = next((x for x in rows[i + 1 :] if x[4] == r[4]), None)
        before = next((x for x in reversed(rows[:i]) if x[4] == r[4]), None)
        if after:
            until = min(until, after[2])
        lack = dur - (until - r[2])
        if lack > 0:
            start = max(r[2] - min(lack, p.max_lead_in_sec * 1000), before[3] if before else 0)
            if start < r[2]:
                r[2] = int(start)
        end = max(r[3], until, r[2] + 1)
        if end > r[3]:
            r[3] = round(end)
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    media = {m: random_media(rng, m) for m in range(150)}
    return media, frame(spark, [r for rows in media.values() for r in rows]).cache()


def test_find_mistimed(corpus):
    media, df = corpus
    p = Params(seg_min_lines=3, seg_backtrace_limit=4, seg_foretrace_limit=3, seg_min_delay_sec=1.0, seg_max_gap=2)
    got = {(r[0], r[1]) for r in detect.find_mistimed(df, p).where("is_mistimed").select("media_id", "line_ix").collect()}
    want = {(m, i) for m, rows in media.items() for i in sequential_mistimed(rows, p)[0]}
    assert got == want


def test_fix_mistimed(corpus):
    media, df = corpus
    p = Params(seg_min_lines=3, seg_min_delay_sec=1.0)
    got = sorted(tuple(r)[:6] for r in repair.fix_mistimed(df, p).collect())
    assert got == sorted(x for rows in media.values() for x in sequential_fix(rows, p))


def test_timing_standards(corpus):
    media, df = corpus
    got = sorted(tuple(r)[:6] for r in repair.apply_timing_standards(df, Params()).collect())
    assert got == sorted(x for rows in media.values() for x in sequential_pad(rows, Params()))


def test_timing_standards_negative(spark):
    rng = random.Random(6)
    media = {m: random_media(rng, m, negative=True) for m in range(40)}
    df = frame(spark, [r for rows in media.values() for r in rows])
    got = sorted(tuple(r)[:6] for r in repair.apply_timing_standards(df, Params()).collect())
    assert got == sorted(x for rows in media.values() for x in sequential_pad(rows, Params()))


def test_one_exchange_for_media_windows(spark, corpus):
    flagged = detect.fill_single_gaps(detect.short_lines(corpus[1].repartition("media_id"), 0.1))
    text = flagged._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 1


def test_range_specs(spark):
    df = spark.createDataFrame([(1, "3-5"), (2, "4")], "media_id long, spec string")
    assert [tuple(r) for r in repair.parse_line_range(df).select("lo_ix", "hi_ix").orderBy("media_id").collect()] == [(2, 4), (3, 3)]
    with pytest.raises(Exception, match="not a line range"):
        repair.parse_line_range(spark.createDataFrame([(1, "a-b")], "media_id long, spec string")).collect()


def test_splice(spark):
    lines = frame(spark, [(1, i, i * 10, i * 10 + 5, "A", f"t{i}") for i in range(6)])
    new = spark.createDataFrame([(1, 0, 7, 8, "A", "n0", "Unknown", 2, 0), (1, 0, 8, 9, "A", "n1", "Unknown", 2, 1)], LINES + ", lo_ix long, new_ix long")
    ranges = spark.createDataFrame([(1, 2, 4)], "media_id long, lo_ix long, hi_ix long")
    assert [r.text for r in repair.splice(lines, ranges, new).orderBy("line_ix").collect()] == ["t0", "t1", "n0", "n1", "t5"]
    beyond = spark.createDataFrame([(1, 2, 9)], "media_id long, lo_ix long, hi_ix long")
    assert repair.splice(lines, beyond, new).count() == 6
    twice = spark.createDataFrame([(1, 2, 4), (1, 4, 5)], "media_id long, lo_ix long, hi_ix long")
    with pytest.raises(Exception, match="overlap"):
        repair.splice(lines, twice, new).collect()


def test_runs_by_time(spark):
    lines = frame(spark, [(1, i, 0, d, "A", "") for i, d in enumerate([900, 100, 700, 50, 50, 600, 9000])])
    groups = spark.createDataFrame([(1, 0, 3, 4, 2)], "media_id long, group_ix long, start_ix long, end_ix long, n_lines long")
    r = detect.expand_runs_by_time(groups, lines, 1.0, 0.5).first()
    assert (r.back_ix, r.fore_ix) == (2, 5)
    r = detect.expand_runs_by_time(groups, lines, 0.1, 0.5).first()
    assert (r.back_ix, r.fore_ix) == (None, None)


def test_report_text(spark):
    lines = frame(spark, [(1, 0, 61_234, 61_500, "A", ""), (1, 1, 61_500, 3_661_005, "A", "")])
    groups = spark.createDataFrame([(1, 0, 0, 1, 2)], "media_id long, group_ix long, start_ix long, end_ix long, n_lines long")
    r = detect.segment_report(groups, lines).first()
    assert (r.start_text, r.end_text) == ("1:01.23", "61:01.01")


def test_empty(spark):
    lines = frame(spark, [])
    assert detect.find_mistimed(lines, Params()).count() == 0
    assert repair.fix_mistimed(lines, Params()).count() == 0
    assert repair.apply_timing_standards(lines, Params()).count() == 0
    assert repair.remove_empty(frame(spark, [(1, 0, 0, 1, "A", "　"), (1, 1, 0, 1, "A", "x")])).select(F.max("line_ix")).first()[0] == 0


def planned(df, what):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count(what)


def test_scans_and_exchanges(spark):
    """Chains of detection and repair read their lines once or twice, and deal them by media once; making the lines has an exchange too."""
    from subtide.plans import line_queries, word_queries

    sf = "/root/testdata/sf0.001"
    for name, scans, exchanges in (("c6_find_mistimed", 1, 2), ("c9_segment_report", 1, 2), ("d8_cut_plan", 1, 2), ("d3_fix_mistimed", 2, 3), ("d12_retranscribe", 8, 16)):
        df = (line_queries.QUERIES | word_queries.QUERIES)[name](spark, sf)
        assert planned(df, "FileScan") <= scans and planned(df, "Exchange ") <= exchanges, name


def test_one_pass_is_the_chain(corpus):
    """The one-pass forms give what the single operators give in turn."""
    _, df = corpus
    for p in (Params(seg_min_lines=3, seg_backtrace_limit=4, seg_foretrace_limit=3, seg_min_delay_sec=1.0, seg_max_gap=2), Params(seg_min_lines=1, seg_min_delay_sec=0.3, seg_max_gap=0), Params(seg_min_lines=2, seg_backtrace_limit=9, seg_foretrace_limit=9, seg_min_delay_sec=2.0, seg_max_gap=6)):
        flagged = detect.fill_single_gaps(detect.short_lines(df, p.mistimed_line_thresh_sec))
        groups = detect.expand_runs(detect.runs(flagged, p.seg_min_lines), df, p.seg_backtrace_limit, p.seg_foretrace_limit, p.seg_min_delay_sec)
        marked = detect.mark_groups(flagged, detect.merge_runs(groups, p.seg_max_gap), "in_group")
        want = sorted(map(tuple, marked.select("media_id", "line_ix", (F.col("is_short") | F.col("in_group")).alias("x")).collect()))
        assert sorted(map(tuple, detect.find_mistimed(df, p).select("media_id", "line_ix", "is_mistimed").collect())) == want
        chain = detect.find_segments(df, p)
        for pad, groups in ((False, chain), (True, detect.pad_segments(chain, df))):
            want = sorted(map(tuple, detect.span_times(groups, df).select("media_id", "group_ix", "start_ix", "end_ix", "n_lines", "start_ms", "end_ms").collect()))
            assert sorted(map(tuple, detect.segment_spans(df, p, pad).collect())) == want and want
        every = detect.runs(detect.find_mistimed(df, p), 1, "is_mistimed")
        for between in (None, (3, 6)):
            some = every if between is None else every.where("start_ix <= 6 and end_ix >= 3")
            want = repair.redistribute_backward(repair.merge_forward(df, some), some)
            assert sorted(map(str, repair.fix_mistimed(df, p, between).collect())) == sorted(map(str, want.collect()))


def walked(durations, edge, step, limit, boundary):
    far, total, i = None, 0, edge
    while 0 <= i < len(durations):
        total += durations[i]
        if total > limit:
            break
        far = i if durations[i] > boundary else far
        i += step
    return far


def test_runs_by_time_random(spark):
    rng = random.Random(23)
    lines, groups, want = [], [], []
    for m in range(60):
        durations = [rng.choice([0, 0, 100, 400, 900, 1500] + [-300] * (m % 4 == 0)) for _ in range(rng.randint(1, 40))]
        lines += [(m, i, 5000, 5000 + d, "A", "") for i, d in enumerate(durations)]
        at = sorted(rng.sample(range(len(durations)), min(len(durations), 4)))
        for k, (a, b) in enumerate(zip(at[::2], at[1::2], strict=False)):
            groups.append((m, k, a, b, b - a + 1))
            want.append((m, k, walked(durations, a, -1, 2500, 300), walked(durations, b, 1, 2500, 300)))
    df = spark.createDataFrame(groups, "media_id long, group_ix long, start_ix long, end_ix long, n_lines long")
    got = detect.expand_runs_by_time(df, frame(spark, lines), 2.5, 0.3)
    assert sorted(tuple(r) for r in got.select("media_id", "group_ix", "back_ix", "fore_ix").collect()) == sorted(want)


def test_runs_by_time_of_one_large_media(spark):
    """10,000 runs and 100,000 lines of one media."""
    import time

    lines = spark.range(100_000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("line_ix"), F.lit(0).cast("long").alias("start_ms"), (F.col("id") % 7 * 100).alias("end_ms"), F.lit("A").alias("style"), F.lit("").alias("text"), F.lit("x").alias("speaker"))
    groups = spark.range(10_000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("group_ix"), (F.col("id") * 10).alias("start_ix"), (F.col("id") * 10 + 2).alias("end_ix"), F.lit(3).cast("long").alias("n_lines"))
    began = time.perf_counter()
    found = {r.group_ix: (r.back_ix, r.fore_ix) for r in detect.expand_runs_by_time(groups, lines, 3600.0, 0.5).collect()}
    assert time.perf_counter() - began < 60
    durations = [i % 7 * 100 for i in range(100_000)]
    for k in (0, 1, 500, 9_999):
        assert found[k] == (walked(durations, k * 10, -1, 3_600_000, 500), walked(durations, k * 10 + 2, 1, 3_600_000, 500))
