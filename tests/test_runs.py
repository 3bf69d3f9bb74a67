"""Runs that are stopped and taken up again: answers, rounds, stages."""

import os
import sys
from collections import Counter
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from subtide.functions import store as S
from subtide.operators import detect, repair, translate, words
from subtide.operators.answers import AnswerStore, Overloaded
from subtide.plans import fixtures, pipeline, rounds, word_queries
from subtide.schema import CONTINUE_FLAG, Params

# the functions here are sent to workers, which have no tests folder
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SF = "/root/testdata/sf0.001"
LINES = "media_id long, line_ix long, start_ms long, end_ms long, style string, text string, speaker string"


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Small tables, many jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def logged(path, call, fail=lambda rows: False):
    """``call`` that writes down each request, and fails where told to, before it is answered."""

    def run(rows):
        with open(path, "a") as f:
            f.write("".join(f"{r.get('attempt', 0)}|{r.get('model', '')}|{r['prompt'][-40:]!r}\n" for r in rows))
        if fail(rows):
            raise RuntimeError("stopped")
        return call(rows)

    return run


def upper(rows):
    return [r["prompt"].upper() for r in rows]


def test_answers_outlive_a_stopped_job(spark, tmp_path):
    n = 40
    requests = spark.range(n).select(F.concat(F.lit("ask "), F.col("id") % 20).alias("prompt"), "id")
    store = AnswerStore(spark, f"file://{tmp_path}/answers", per_call=1)
    log, stop = tmp_path / "log", tmp_path / "stop"
    stop.touch()
    with pytest.raises(Exception, match="stopped"):
        store.ask(requests, logged(str(log), upper, lambda rows, stop=str(stop): os.path.exists(stop) and rows[0]["prompt"] == "ask 7"))
    kept = {r.response for r in store.answers().collect()}
    asked = Counter(log.read_text().splitlines())
    assert len(kept) < 20 and sum("'ask 7'" in x for x in asked) == 1
    stop.unlink()
    got = store.ask(requests, logged(str(log), upper))
    for _ in range(2):  # reading twice asks nobody
        assert sorted((r.id, r.response) for r in got.collect()) == [(i, f"ASK {i % 20}") for i in range(n)]
    again = Counter(log.read_text().splitlines())
    # what was kept is not asked again, and all the rest once more at most
    assert sum(again.values()) <= sum(asked.values()) + 20 - len(kept)
    assert all(again[x] == 1 for x in asked if eval(x.split("|")[2]).upper() in kept)


def test_answer_spacing(spark, tmp_path):
    now, waits = [100.0], []

    def sleep(sec):
        waits.append(sec)
        now[0] += sec

    def clock():
        now[0] += 1.0
        return now[0]

    make = lambda: AnswerStore(spark, f"file://{tmp_path}/a", per_call=2, lanes=2, interval_sec=61.0, sleep=sleep, clock=clock)
    requests = spark.range(9).select(F.col("id").cast("string").alias("prompt"))
    make().fill(requests, upper)
    # 9 requests in calls of 2 by 2 lanes: waves of 4, 4 and 1
    at = sorted({(r.lane, r.asked_at) for r in make().answers().collect()})
    assert len(at) == 5 and len(waits) == 2
    for lane in (0, 1):
        times = [t for k, t in at if k == lane]
        assert all(b - a >= 61 for a, b in zip(times, times[1:], strict=False))
    # another run knows when the lanes last called
    make().fill(spark.createDataFrame([("new",)], "prompt string"), upper)
    assert len(waits) == 3 and make().answers().count() == 10


def test_apply_model_with_store(spark, tmp_path):
    tries = tmp_path / "tries"

    def call(prompts):
        with open(tries, "a") as f:
            f.write("x")
        if tries.stat().st_size == 1:
            raise Overloaded
        return [p + "!" for p in prompts]

    store = AnswerStore(spark, f"file://{tmp_path}/a", retries=3)
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, prompt string")
    got = translate.apply_model(df.where("id < 3"), call, store=store)
    assert sorted(map(tuple, got.collect())) == [(1, "a", "a!"), (2, "a", "a!")] and tries.stat().st_size == 2
    assert store.missing(df).count() == 1


def episode(media, n):
    return [(media, i, 1000 * i, 1000 * i + 900, "s", f"line {'x' * ((3 * i + 14) % 16)} {i} of {media}" + CONTINUE_FLAG * (i % 4 == 1) + ("\nsecond" if i % 5 == 0 else ""), "a") for i in range(n)]


PARAMS = Params(batch_lines=3, discard_lines=2, max_cont_lines=2, context_lines=4, translate_retries=2)


def plain_rounds(rows, call, params, models, before=()):
    """One media after another, one batch after another: (translated texts by line, prompts of each call)."""
    out, calls = {}, []
    for media in sorted({r[0] for r in rows}):
        texts = [r[5] for r in sorted(r for r in rows if r[0] == media)]
        done = [t for m, t in before if m == media]
        at = len(done)
        while at < len(texts):
            end = min(at + params.batch_lines, len(texts))
            more = 0
            while end < len(texts) and texts[end - 1].endswith(CONTINUE_FLAG) and more < params.max_cont_lines:
                end, more = end + 1, more + 1
            asked = [t.replace("\n", "\\N") for t in texts[at : end + params.discard_lines]]
            said, prompt = None, None
            for attempt in range(params.translate_retries * len(models)):
                listed = lambda x: "\n".join(f"{i + 1}. {t}" for i, t in enumerate(x))
                if said is not None and abs(len(said) - len(asked)) <= 10:
                    prompt = f"Your translation had {len(said)} entries; exactly {len(asked)} are needed.\n\nEnglish entries:\n{listed(asked)}\n\nYour German entries:\n{listed(said)}\n\nGive the same content in exactly {len(asked)} entries."
                else:
                    past = done[-params.context_lines :]
                    prompt = f"Context:\nabout {media}\n\n" + (f"The last {len(past)} translated entries were:\n" + "\n".join(past) + "\n\nGo on from there. " if past else "")
                    prompt += f"Translate these {len(asked)} English subtitle entries to German, as many and in this order:\n\n{listed(asked)}"
                row = {"model": models[attempt // params.translate_retries], "prompt": prompt, "attempt": attempt}
                calls.append((row["model"], attempt, prompt))
                said = call([row])[0].strip().split("\n")
                if len(said) > 1 and said[0].startswith("1. ") and said[1].startswith("2. "):
                    said = [x.split(". ", 1)[1] for x in said]
                if len(said) == len(asked):
                    break
            if len(said) > len(asked):
                said = [*said[: len(asked) - 1], "\\N".join(said[len(asked) - 1 :])]
            said += ["[Translation missing]"] * (len(asked) - len(said))
            done += said[: end - at]
            at = end
        out |= {(media, i): t for i, t in enumerate(done)}
    return out, sorted(calls)


def run_rounds(spark, df, home, call, **options):
    contexts = df.select("media_id").distinct().select("media_id", F.concat(F.lit("about "), "media_id").alias("context"))
    return rounds.translate_rounds(df, home, call, PARAMS, model="first", fallback_model="second", lang_from="English", lang_to="German", contexts=contexts, per_call=1, **options)


def test_rounds_and_resume(spark, tmp_path):
    rows = episode(1, 6) + episode(2, 1) + episode(3, 5) + episode(4, 3)
    df = spark.createDataFrame(rows, LINES)
    want, calls = plain_rounds(rows, fixtures.flawed_model, PARAMS, ["first", "second"])
    assert any(m == "second" for m, _, _ in calls) and any("missing]" in t for t in want.values())
    log, stop, home = tmp_path / "log", tmp_path / "stop", f"file://{tmp_path}/run"
    stop.touch()
    # stopped in the third round, at the media that comes second in it
    fail = lambda rows, stop=str(stop): os.path.exists(stop) and "of 3" in rows[0]["prompt"].rsplit("\n\n", 1)[-1] and "line" in rows[0]["prompt"] and "translated entries" in rows[0]["prompt"]
    with pytest.raises(Exception, match="stopped"):
        run_rounds(spark, df, home, logged(str(log), fixtures.flawed_model, fail))
    assert S.committed(spark, f"{home}/rounds/round=0")
    stop.unlink()
    got = run_rounds(spark, df, home, logged(str(log), fixtures.flawed_model))
    assert {(r.media_id, r.line_ix): r.text for r in got.collect()} == want
    lines = log.read_text().splitlines()
    asked = Counter(x.split("|")[0] + x.split("|")[1] + x.split("|")[2] for x in lines)
    # every call of the plain run once; those that failed, or ran beside one that did, once more at most
    assert len(calls) <= len(lines) <= len(calls) + 4
    assert set(asked) == {f"{a}{m}{p[-40:]!r}" for m, a, p in calls}
    # nothing is left, and nothing is asked
    n = len(lines)
    assert {(r.media_id, r.line_ix): r.text for r in run_rounds(spark, df, home, logged(str(log), fixtures.flawed_model)).collect()} == want
    assert len(log.read_text().splitlines()) == n


def test_rounds_after_earlier_lines(spark, tmp_path):
    rows = episode(1, 9) + episode(2, 5)
    df = spark.createDataFrame(rows, LINES)
    before = [(1, i, f"done {i}") for i in range(4)] + [(2, i, f"done {i}") for i in range(5)]
    want, _ = plain_rounds(rows, fixtures.flawed_model, PARAMS, ["first", "second"], [(m, t) for m, _, t in before])
    got = run_rounds(spark, df, f"file://{tmp_path}/run", fixtures.flawed_model, translated=spark.createDataFrame(before, "media_id long, line_ix long, text string"))
    assert {(r.media_id, r.line_ix): r.text for r in got.collect()} == want
    assert run_rounds(spark, df.limit(0), f"file://{tmp_path}/none", fixtures.flawed_model).count() == 0


def test_system_prompt(spark):
    text = translate.system_prompt("English", "German")
    assert all(x in text for x in ("English", "German", CONTINUE_FLAG, "\\N", "{\\i1}"))
    assert translate.with_system(spark.range(1), "English", "German").first().system == text


def test_stage_store(spark, tmp_path):
    """Stages in turn give the same as a whole run; of a removed half only that half is done anew, also in later stages."""
    params = replace(word_queries.FULL, seg_min_lines=2)
    talk = fixtures.talk_words(spark, SF).where("media_id < 40000").cache()
    tables = {"words": talk, "seg_words": fixtures.words_again, "responses": fixtures.replies}
    store = pipeline.StageStore(spark, f"file://{tmp_path}/store")
    done = Counter()

    def seen(stage):
        def note(rows, media):
            done[stage] += media.count()
            return commit(stage, rows, media)
        return note

    commit = store.commit
    store.commit = lambda stage, rows, media: seen(stage)(rows, media)
    got = sorted(map(str, pipeline.run_stages(store, tables, pipeline.STAGES, params).collect()))
    n = talk.select("media_id").distinct().count()
    assert done == dict.fromkeys(pipeline.STAGES, n) and n > 3
    lines = words.convert(talk, params)
    cuts = repair.cut_plan(detect.pad_segments(detect.find_segments(lines, params), lines), lines)
    assert cuts.count() > 0
    lines = S.keep(repair.retranscribe(lines, cuts, fixtures.words_again(lines, cuts), params), f"file://{tmp_path}/cut")
    lines = S.keep(repair.remove_empty(repair.fix_mistimed(lines, params)), f"file://{tmp_path}/fixed")
    batches = translate.plan_batches(lines, params.batch_lines, params.max_cont_lines)
    lines = translate.translate(lines, fixtures.replies(translate.batch_windows(lines, batches, params.discard_lines)), params)
    assert got == sorted(map(str, repair.apply_timing_standards(lines, params).select(*store.read("pad").columns).collect()))

    assert pipeline.run_stages(store, tables, pipeline.STAGES, params).count() == len(got) and done["pad"] == n
    half = talk.select("media_id").distinct().orderBy("media_id").limit(n // 2).cache()
    store.remove("fix", half)
    assert store.read("fix").join(half, "media_id", "left_semi").count() == 0
    assert sorted(map(str, pipeline.run_stages(store, tables, pipeline.STAGES, params).collect())) == got
    assert done == {"convert": n, "retranscribe": n} | dict.fromkeys(("fix", "translate", "pad"), n + n // 2)


def test_stage_store_media_without_rows(spark, tmp_path):
    """A media of which a stage leaves no line is done; a commit that is repeated takes the place of the first."""
    store = pipeline.StageStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame(episode(1, 3) + episode(2, 2), LINES)
    assert {r.media_id for r in store.pending("fix", df).collect()} == {1, 2}
    store.commit("fix", df.where("media_id = 1"), df)
    assert store.pending("fix", df).count() == 0 and {r.media_id for r in store.read("fix").collect()} == {1}
    store.commit("fix", df.where("media_id = 1 and line_ix = 0"), df.where("media_id = 1"))
    assert store.read("fix").count() == 1
    assert {r.media_id for r in store.pending("pad", store.media("fix")).collect()} == {1, 2}
    store.remove("fix", df.where("media_id = 2"))
    assert {r.media_id for r in store.pending("fix", df).collect()} == {2}
    with pytest.raises(ValueError, match="no such stages"):
        pipeline.run_stages(store, {"lines": df}, ["mend"], PARAMS)
