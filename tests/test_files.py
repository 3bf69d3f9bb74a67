"""Files by name, event tables with headers of their own, contexts, languages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from subtide.functions import store
from subtide.operators import translate, words
from subtide.sources import catalog, cues, transcripts

LINES = "media_id string, line_ix long, start_ms long, end_ms long, style string, text string, speaker string"


def lines(spark):
    return spark.createDataFrame([("a b", 0, 0, 1000, "S", "one", "x"), ("a b", 1, 1000, 2000, "S", "two\\Nthree", "x"), ("é/1:2", 0, 5, 10, "S", "drei", "x")], LINES)


def test_files_by_name(spark, tmp_path):
    df = lines(spark).where("media_id = 'a b'").unionByName(lines(spark).where("media_id <> 'a b'").withColumn("media_id", F.lit("é=%2")))
    for format in ("srt", "vtt", "ass"):
        cues.write_cues(df, str(tmp_path / "out"), format)
    cues.write_text(df, str(tmp_path / "out"))
    docs = spark.createDataFrame([("a b", json.dumps({"text": "", "segments": [], "words": []}))], "media_id string, doc string")
    transcripts.write_transcripts(docs, str(tmp_path / "out"))
    names = sorted(x for x in os.listdir(tmp_path / "out") if not x.startswith("."))
    assert names == sorted([f"{m}.{s}" for m in ("a b", "é=%2") for s in ("srt", "vtt", "ass", "txt")] + ["a b.json"])
    assert (tmp_path / "out" / "a b.txt").read_text() == "one\ntwo\\Nthree\n"
    back = cues.read_cues(spark, str(tmp_path / "out" / "*.srt"), "srt").orderBy("media_id", "line_ix").collect()
    assert [(r.media_id, r.line_ix, r.start_ms, r.text) for r in back] == [("a b", 0, 0, "one"), ("a b", 1, 1000, "two\\Nthree"), ("é=%2", 0, 5, "drei")]
    assert transcripts.read_transcripts(spark, str(tmp_path / "out" / "*.json"), "segmented").first().media_id == "a b"
    # written again, a file is replaced, and those of other media stay
    cues.write_text(df.where("media_id = 'a b' and line_ix = 0"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a b.txt").read_text() == "one\n" and (tmp_path / "out" / "é=%2.txt").exists()


def test_packed_transcripts(spark, tmp_path):
    """Documents of many media in few files come back as they were, and a folder that is there is not written into."""
    names = ["a b", "é/1:2", *map(str, range(200))]
    doc = lambda m: json.dumps({"text": m + '"\n\u3000', "segments": [], "words": [{"word": m, "start": 0.5, "end": 1.0}]}, ensure_ascii=False)
    docs = spark.createDataFrame([(m, doc(m)) for m in names], "media_id string, doc string").coalesce(2)
    transcripts.write_transcripts(docs, str(tmp_path / "out"), packed=True)
    assert len([x for x in os.listdir(tmp_path / "out") if x.endswith(".json.gz")]) <= 2
    back = transcripts.read_transcripts(spark, str(tmp_path / "out"), "segmented", packed=True)
    assert sorted((r.media_id, r.doc, r.j.words[0].word) for r in back.collect()) == sorted((m, doc(m), m) for m in names)
    with pytest.raises(Exception, match="(?i)already exists"):
        transcripts.write_transcripts(docs, str(tmp_path / "out"), packed=True)


def test_no_file_after_a_failed_job(spark, tmp_path):
    docs = spark.range(20).select(F.col("id").alias("media_id"), F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise("x").alias("doc"))
    with pytest.raises(Exception, match="no"):
        store.write_named(docs.repartition(8, "media_id"), str(tmp_path / "out"), ".txt")
    assert not (tmp_path / "out").exists() or [x for x in os.listdir(tmp_path / "out") if not x.startswith(".")] == []


def test_event_headers(spark):
    usual = "Dialogue: 0,0:00:01.00,0:00:02.50,Main,Ann,0,0,0,,Hello, you"
    docs = [
        (1, usual),
        (2, "[Script Info]\r\n[V4+ Styles]\r\nFormat: Name, Text\r\n[Events]\r\nFormat: Text\r\nFormat:  Start , End,Text\r\nDialogue: 1:00:00.05,1:00:01.1,a,b,,c\r\nComment: 0:0:0.0,0:0:0.0,no\r\nDialogue: 0:00:01.00"),
        (3, "[Events]\nFormat: Marked, Start, End, Actor, Text\nDialogue: Marked=0,0:00:00.00,0:00:01.00,,x\nDialogue: Marked=0,soon,later,Bo,y\n[Fonts]\nDialogue: 0,0:00:01.00,0:00:02.00,no,no"),
        (4, "[Events]\nFormat: Layer, Text\nDialogue: 0,text"),
        (5, ""),
    ]
    df = spark.createDataFrame(docs, "media_id long, doc string")
    got = [tuple(r) for r in cues.parse_cues(df, "ass").orderBy("media_id", "line_ix").collect()]
    assert got == [(1, 0, 1000, 2500, "Main", "Hello, you", "Ann"), (2, 0, 3_600_050, 3_601_100, "Default", "a,b,,c", "Unknown"), (3, 0, 0, 1000, "Default", "x", "Unknown")]
    bad = [(r.media_id, r.at, r.reason) for r in cues.rejected_events(df).orderBy("media_id", "at").collect()]
    assert bad == [(2, 8, "too few fields"), (3, 3, "no time"), (4, 2, "start, end or text not named")]


def test_load_contexts(spark, tmp_path):
    (tmp_path / "7.context.txt").write_text(" \n about seven 　\n")
    (tmp_path / "8.txt").write_text("")
    got = catalog.load_contexts(spark, str(tmp_path), spark.createDataFrame([(7,), (8,), (9,)], "media_id long"))
    assert sorted(map(tuple, got.collect())) == [(7, "about seven"), (8, ""), (9, "")]


def test_stitched_language(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "de"), (1, 2, "en"), (2, 0, "fr"), (3, 0, None)], "media_id long, chunk_ix long, language string")
    assert sorted(map(tuple, words.stitched_language(df).collect())) == [(1, "de"), (2, "fr"), (3, None)]
    asked = spark.createDataFrame([(1, "ja"), (3, None)], "media_id long, language string")
    assert sorted(map(tuple, words.stitched_language(df, asked).collect())) == [(1, "ja"), (2, "fr"), (3, None)]


def test_language_tags(spark):
    dim = spark.createDataFrame([*translate.LANGUAGES, ("zh-Hant", "Traditional Chinese")], "code string, name string")
    tags = ["de", "pt-BR", "PT_br", "zh-Hant-TW", "zh-Hans", "es-419", "xx-BR", "", "-", "sr-Latn-RS", "en-x-own", None]
    got = {r.code: r.name for r in translate.language_names(spark.createDataFrame([(t,) for t in [*tags, "de"]], "code string"), dim).collect()}
    assert got == {
        "de": "German", "pt-BR": "Portuguese (Brazil)", "PT_br": "Portuguese (Brazil)", "zh-Hant-TW": "Traditional Chinese (Taiwan)", "zh-Hans": "Chinese (Simplified)", "es-419": "Spanish (Latin America)",
        "xx-BR": "xx-BR", "": "", "-": "-", "sr-Latn-RS": "Serbian (Latin, Serbia)", "en-x-own": "English (x, own)", None: None,
    }
