"""Registered queries of detection and repair, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators import detect, repair
from subtide.plans import fixtures as X
from subtide.schema import Params

#: Event lines last a few seconds at most, so a slow line is one over a second there.
EVENTS = Params(seg_min_delay_sec=1.0)
TALKS = Params()
LINE = ["media_id", "line_ix", "start_ms", "end_ms", "style", "text"]


def _flagged(s: SparkSession, d: str) -> DataFrame:
    return detect.fill_single_gaps(detect.short_lines(X.event_lines(s, d), 0.1))


def _runs(s: SparkSession, d: str) -> DataFrame:
    return detect.runs(_flagged(s, d), 4)


def _expanded(s: SparkSession, d: str) -> DataFrame:
    return detect.expand_runs(_runs(s, d), X.event_lines(s, d), 20, 5, 1.0)


def _segments(s: SparkSession, d: str) -> DataFrame:
    return detect.find_segments(X.event_lines(s, d), EVENTS)


def _talk_groups(s: SparkSession, d: str) -> DataFrame:
    return detect.runs(detect.find_mistimed(X.talk_lines(s, d), TALKS), 1, "is_mistimed")


def _new_lines(s: SparkSession, d: str) -> DataFrame:
    two = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long")))
    r = X.line_ranges(s, d).select("media_id", "lo_ix", two.alias("new_ix"))
    start = F.col("lo_ix") * 1000 + F.col("new_ix") * 300
    return r.select("media_id", F.lit(0).cast("long").alias("line_ix"), start.alias("start_ms"), (start + 250).alias("end_ms"), F.lit("Default").alias("style"), F.concat_ws("-", F.lit("new"), "media_id", "new_ix").alias("text"), F.lit("Unknown").alias("speaker"), "lo_ix", "new_ix")


def _cuts(s: SparkSession, d: str) -> DataFrame:
    lines = X.event_lines(s, d)
    return repair.cut_plan(detect.segment_spans(lines, EVENTS, pad=True), lines)


def _done(s: SparkSession, d: str) -> DataFrame:
    return _cuts(s, d).where("(media_id + group_ix) % 2 = 0").select("media_id", "start_ms", "end_ms")


def _specs(s: SparkSession, d: str) -> DataFrame:
    m = X.talk_lines(s, d).select("media_id").distinct()
    return m.withColumn("spec", F.when(F.col("media_id") % 2 == 0, F.concat_ws("-", F.col("media_id") % 5 + 1, F.col("media_id") % 5 + 4)).otherwise((F.col("media_id") % 5 + 1).cast("string")))


QUERIES = {
    "c1_short_lines": lambda s, d: detect.short_lines(X.event_lines(s, d), 0.1).select("media_id", "line_ix", "is_short"),
    "c2_fill_single_gaps": lambda s, d: _flagged(s, d).select("media_id", "line_ix", "is_short"),
    "c3_runs": _runs,
    "c4_expand_runs": _expanded,
    "c5_merge_runs": lambda s, d: detect.merge_runs(_expanded(s, d), 4),
    "c6_find_mistimed": lambda s, d: detect.find_mistimed(X.event_lines(s, d), EVENTS).select("media_id", "line_ix", "is_mistimed"),
    "c7_find_segments": _segments,
    "c8_pad_segments": lambda s, d: detect.pad_segments(_segments(s, d), X.event_lines(s, d)),
    "c9_segment_report": lambda s, d: detect.segment_report(detect.segment_spans(X.event_lines(s, d), EVENTS), X.event_lines(s, d)),
    "c10_long_lines": lambda s, d: detect.long_lines(X.talk_lines(s, d), 5.0).select("media_id", "line_ix", "start_ms", "end_ms"),
    "c11_long_gaps": lambda s, d: detect.long_gaps(X.event_lines(s, d), 60.0),
    "c12_expand_runs_by_time": lambda s, d: detect.expand_runs_by_time(_runs(s, d), X.event_lines(s, d), 3.0, 0.5).fillna(-1, ["back_ix", "fore_ix"]),
    "d1_merge_forward": lambda s, d: repair.merge_forward(X.talk_lines(s, d), _talk_groups(s, d)).select(*LINE),
    "d2_redistribute_backward": lambda s, d: repair.redistribute_backward(X.talk_lines(s, d), _talk_groups(s, d)).select(*LINE),
    "d3_fix_mistimed": lambda s, d: repair.fix_mistimed(X.talk_lines(s, d), TALKS).select(*LINE),
    "d4_remove_empty": lambda s, d: repair.remove_empty(X.event_lines(s, d)).select(*LINE),
    "d5_apply_timing_standards": lambda s, d: repair.apply_timing_standards(X.talk_lines(s, d), TALKS).select(*LINE),
    "d6_splice": lambda s, d: repair.splice(X.talk_lines(s, d), X.line_ranges(s, d), _new_lines(s, d)).select(*LINE),
    "d7_shift": lambda s, d: repair.shift(X.talk_lines(s, d), F.col("media_id") * 10).select(*LINE),
    "d8_cut_plan": _cuts,
    "d9_parse_line_range": lambda s, d: repair.in_range(X.talk_lines(s, d), repair.parse_line_range(_specs(s, d))).select(*LINE),
    "d10_rebase_range": lambda s, d: repair.rebase_range(X.line_ranges(s, d), X.talk_lines(s, d), repair.splice(X.talk_lines(s, d), X.line_ranges(s, d), _new_lines(s, d))),
    "d11_pending_cuts": lambda s, d: repair.pending_cuts(_cuts(s, d), _done(s, d))[1].select("media_id", "group_ix", "cut_key"),
    "d11_done_cuts": lambda s, d: repair.pending_cuts(_cuts(s, d), _done(s, d))[0].select("media_id", "group_ix", "cut_key"),
}


def chain(lines: str, min_delay_ms: int, min_lines: int = 4) -> str:
    """WITH entries from lines to padded segments."""
    return f"""WITH {lines},
short AS (SELECT *, (end_ms - start_ms) / 1000.0::DOUBLE <= 0.1::DOUBLE AS is_short FROM lines),
filled AS (SELECT * REPLACE (is_short OR (coalesce(lag(is_short) OVER m, false) AND coalesce(lead(is_short) OVER m, false)) AS is_short) FROM short WINDOW m AS (PARTITION BY media_id ORDER BY line_ix)),
runs0 AS (SELECT media_id, min(line_ix) AS start_ix, max(line_ix) AS end_ix, count(*) AS n_lines FROM (SELECT media_id, line_ix, line_ix - row_number() OVER (PARTITION BY media_id ORDER BY line_ix) AS k FROM filled WHERE is_short) GROUP BY media_id, k),
runs AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ix) - 1 AS group_ix, start_ix, end_ix, n_lines FROM runs0 WHERE n_lines >= {min_lines}),
slow AS (SELECT media_id, line_ix, count(*) OVER (PARTITION BY media_id) AS n,
    max(CASE WHEN end_ms - start_ms > {min_delay_ms} THEN line_ix END) OVER (PARTITION BY media_id ORDER BY line_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    min(CASE WHEN end_ms - start_ms > {min_delay_ms} THEN line_ix END) OVER (PARTITION BY media_id ORDER BY line_ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM lines),
expanded AS (SELECT r.media_id, group_ix,
    CASE WHEN r.start_ix - a.p <= 20 THEN a.p WHEN a.p IS NULL AND r.start_ix < 20 THEN 0 ELSE r.start_ix END AS start_ix,
    CASE WHEN b.q - r.end_ix <= 5 THEN b.q WHEN b.q IS NULL AND b.n - 1 - r.end_ix < 5 THEN b.n - 1 ELSE r.end_ix END AS end_ix
  FROM runs r JOIN slow a ON a.media_id = r.media_id AND a.line_ix = r.start_ix JOIN slow b ON b.media_id = r.media_id AND b.line_ix = r.end_ix),
m1 AS (SELECT *, max(end_ix) OVER (PARTITION BY media_id ORDER BY start_ix, end_ix, group_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM expanded),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ix - reach > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_ix, end_ix, group_ix ROWS UNBOUNDED PRECEDING) AS k FROM m1),
m3 AS (SELECT media_id, min(start_ix) AS start_ix, max(end_ix) AS end_ix FROM m2 GROUP BY media_id, k),
merged AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ix, end_ix) - 1 AS group_ix, start_ix, end_ix, end_ix - start_ix + 1 AS n_lines FROM m3),
marked AS (SELECT f.*, f.is_short OR m.media_id IS NOT NULL AS is_mistimed FROM filled f LEFT JOIN merged m ON f.media_id = m.media_id AND f.line_ix BETWEEN m.start_ix AND m.end_ix),
g1 AS (SELECT media_id, min(line_ix) AS start_ix, max(line_ix) AS end_ix, count(*) AS n_lines FROM (SELECT media_id, line_ix, line_ix - row_number() OVER (PARTITION BY media_id ORDER BY line_ix) AS k FROM marked WHERE is_mistimed) GROUP BY media_id, k),
every AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ix) - 1 AS group_ix, start_ix, end_ix, n_lines FROM g1),
segs AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ix) - 1 AS group_ix, start_ix, end_ix, n_lines FROM g1 WHERE n_lines >= {min_lines}),
sizes AS (SELECT media_id, count(*) AS n FROM lines GROUP BY media_id),
padded AS (SELECT s.media_id, group_ix, greatest(start_ix - 1, 0) AS start_ix, least(end_ix + 1, n - 1) AS end_ix, least(end_ix + 1, n - 1) - greatest(start_ix - 1, 0) + 1 AS n_lines FROM segs s JOIN sizes z ON s.media_id = z.media_id),
cuts AS (SELECT p.media_id, group_ix, p.start_ix, p.end_ix, a.start_ms, b.end_ms, (b.end_ms - a.start_ms) / 1000.0::DOUBLE AS duration_s, concat_ws('-', a.start_ms, b.end_ms) AS cut_key
  FROM padded p JOIN lines a ON a.media_id = p.media_id AND a.line_ix = p.start_ix JOIN lines b ON b.media_id = p.media_id AND b.line_ix = p.end_ix)"""


_E = chain(X.EVENT_LINES_SQL, 1000)
_T = chain(X.TALK_LINES_SQL, 10000)
_clock = lambda c: f"concat(({c} + 5) // 10 // 6000, ':', lpad(CAST(({c} + 5) // 10 // 100 % 60 AS varchar), 2, '0'), '.', lpad(CAST(({c} + 5) // 10 % 100 AS varchar), 2, '0'))"
_D1 = """, head AS (SELECT e.media_id, e.end_ix, string_agg(l.text, ' ' ORDER BY l.line_ix) AS t, min(l.start_ms) FILTER (l.line_ix = 0) AS s FROM every e JOIN sizes z ON z.media_id = e.media_id
  JOIN lines l ON l.media_id = e.media_id AND l.line_ix <= e.end_ix WHERE e.start_ix = 0 AND e.end_ix + 1 < z.n GROUP BY e.media_id, e.end_ix),
one AS (SELECT l.media_id, l.line_ix, CASE WHEN l.line_ix = end_ix + 1 THEN h.s ELSE start_ms END AS start_ms, end_ms, style,
  CASE WHEN l.line_ix = end_ix + 1 THEN h.t || ' ' || l.text WHEN l.line_ix <= end_ix THEN '' ELSE l.text END AS text FROM lines l LEFT JOIN head h ON l.media_id = h.media_id)"""


def _d2(source: str) -> str:
    return f""", r1 AS (SELECT l.media_id, l.line_ix, e.group_ix, length(text)::DOUBLE AS c, first(start_ms) OVER w AS a, last(end_ms) OVER w AS b, sum(length(text)) OVER w::DOUBLE AS t
  FROM {source} l JOIN every e ON l.media_id = e.media_id AND e.start_ix > 0 AND l.line_ix BETWEEN e.start_ix - 1 AND e.end_ix
  WINDOW w AS (PARTITION BY l.media_id, e.group_ix ORDER BY l.line_ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
r2 AS (SELECT *, CAST(trunc((b - a) * (c / t)) AS bigint) AS share FROM r1 WHERE t > 0),
r3 AS (SELECT *, a + sum(share) OVER (PARTITION BY media_id, group_ix ORDER BY line_ix ROWS UNBOUNDED PRECEDING) AS e FROM r2)
SELECT l.media_id, l.line_ix, CAST(coalesce(r3.e - share, start_ms) AS bigint) AS start_ms, CAST(coalesce(r3.e, end_ms) AS bigint) AS end_ms, style, text FROM {source} l LEFT JOIN r3 ON l.media_id = r3.media_id AND l.line_ix = r3.line_ix"""


def fixed_sql(lines: str, min_lines: int = 4) -> str:
    return chain(lines, 10000, min_lines) + _D1 + _d2("one")


_SPLICED = f"""WITH {X.TALK_LINES_SQL}, {X.RANGES_SQL}, sizes AS (SELECT media_id, count(*) AS n FROM lines GROUP BY media_id),
good AS (SELECT r.* FROM ranges r JOIN sizes z ON r.media_id = z.media_id WHERE hi_ix < n),
parts AS (SELECT l.media_id, line_ix AS place, -1 AS nth, start_ms, end_ms, style, text FROM lines l LEFT JOIN good g ON l.media_id = g.media_id AND line_ix BETWEEN lo_ix AND hi_ix WHERE g.media_id IS NULL
  UNION ALL SELECT media_id, lo_ix, k, lo_ix * 1000 + k * 300, lo_ix * 1000 + k * 300 + 250, 'Default', concat_ws('-', 'new', media_id, k) FROM good, (SELECT unnest([0, 1]) AS k)),
spliced AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY place, nth) - 1 AS line_ix, CAST(start_ms AS bigint) AS start_ms, CAST(end_ms AS bigint) AS end_ms, style, text FROM parts)"""

def padded_sql(lines: str) -> str:
    """The passes of the timing standards, for lines that end after they start."""
    return f"WITH {lines}" + """, a AS (SELECT *, greatest(length(text) / 15.0::DOUBLE * 1000.0::DOUBLE, 1000.0::DOUBLE) AS dur FROM lines),
b AS (SELECT *, least(start_ms + dur, end_ms + 2000.0::DOUBLE) AS target FROM a),
c AS (SELECT *, length(text) > 0 AND target > end_ms AS active, least(target, lead(start_ms) OVER w::DOUBLE) AS ne FROM b WINDOW w AS (PARTITION BY media_id, style ORDER BY line_ix)),
d AS (SELECT *, CASE WHEN active THEN CAST(round_even(greatest(end_ms::DOUBLE, ne), 0) AS bigint) ELSE end_ms END AS end_1 FROM c),
e AS (SELECT *, coalesce(lag(end_1) OVER (PARTITION BY media_id, style ORDER BY line_ix), 0) AS pe, dur - (ne - start_ms) AS lack FROM d),
f AS (SELECT *, greatest(start_ms - least(lack, 250.0::DOUBLE), pe::DOUBLE) AS earlier FROM e),
g AS (SELECT *, CASE WHEN active AND lack > 0 AND earlier < start_ms THEN CAST(trunc(earlier) AS bigint) ELSE start_ms END AS start_2 FROM f),
h AS (SELECT *, greatest(end_ms::DOUBLE, ne, (start_2 + 1)::DOUBLE) AS f FROM g)
SELECT media_id, line_ix, start_2 AS start_ms, CASE WHEN active AND f > end_ms THEN CAST(round_even(f, 0) AS bigint) ELSE end_ms END AS end_ms, style, text FROM h"""


SQL = {
    "c1_short_lines": _E + "SELECT media_id, line_ix, is_short FROM short",
    "c2_fill_single_gaps": _E + "SELECT media_id, line_ix, is_short FROM filled",
    "c3_runs": _E + "SELECT media_id, group_ix, start_ix, end_ix, n_lines FROM runs",
    "c4_expand_runs": _E + "SELECT media_id, group_ix, start_ix, end_ix, end_ix - start_ix + 1 AS n_lines FROM expanded",
    "c5_merge_runs": _E + "SELECT * FROM merged",
    "c6_find_mistimed": _E + "SELECT media_id, line_ix, is_mistimed FROM marked",
    "c7_find_segments": _E + "SELECT * FROM segs",
    "c8_pad_segments": _E + "SELECT * FROM padded",
    "c9_segment_report": _E + f""", t AS (SELECT s.*, a.start_ms, b.end_ms, b.end_ms - a.start_ms AS duration_ms FROM segs s JOIN lines a ON a.media_id = s.media_id AND a.line_ix = s.start_ix JOIN lines b ON b.media_id = s.media_id AND b.line_ix = s.end_ix)
SELECT *, {_clock("start_ms")} AS start_text, {_clock("end_ms")} AS end_text, {_clock("duration_ms")} AS duration_text FROM t""",
    "c10_long_lines": _T + "SELECT media_id, line_ix, start_ms, end_ms FROM lines WHERE end_ms - start_ms > 5000",
    "c11_long_gaps": _E + "SELECT * FROM (SELECT media_id, end_ms AS gap_start_ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, line_ix) AS gap_end_ms FROM lines) WHERE gap_end_ms - gap_start_ms > 60000",
    "c12_expand_runs_by_time": _E + """, b1 AS (SELECT r.media_id, r.group_ix, l.line_ix, l.end_ms - l.start_ms AS dur, sum(l.end_ms - l.start_ms) OVER (PARTITION BY r.media_id, r.group_ix ORDER BY l.line_ix DESC ROWS UNBOUNDED PRECEDING) AS total FROM runs r JOIN lines l ON l.media_id = r.media_id AND l.line_ix <= r.start_ix),
b2 AS (SELECT *, max(total) OVER (PARTITION BY media_id, group_ix ORDER BY line_ix DESC ROWS UNBOUNDED PRECEDING) AS most FROM b1),
f1 AS (SELECT r.media_id, r.group_ix, l.line_ix, l.end_ms - l.start_ms AS dur, sum(l.end_ms - l.start_ms) OVER (PARTITION BY r.media_id, r.group_ix ORDER BY l.line_ix ROWS UNBOUNDED PRECEDING) AS total FROM runs r JOIN lines l ON l.media_id = r.media_id AND l.line_ix >= r.end_ix),
f2 AS (SELECT *, max(total) OVER (PARTITION BY media_id, group_ix ORDER BY line_ix ROWS UNBOUNDED PRECEDING) AS most FROM f1)
SELECT r.*, coalesce(x.back_ix, -1) AS back_ix, coalesce(y.fore_ix, -1) AS fore_ix FROM runs r LEFT JOIN (SELECT media_id, group_ix, min(line_ix) AS back_ix FROM b2 WHERE most <= 3000 AND dur / 1000.0::DOUBLE > 0.5 GROUP BY ALL) x ON r.media_id = x.media_id AND r.group_ix = x.group_ix
LEFT JOIN (SELECT media_id, group_ix, max(line_ix) AS fore_ix FROM f2 WHERE most <= 3000 AND dur / 1000.0::DOUBLE > 0.5 GROUP BY ALL) y ON r.media_id = y.media_id AND r.group_ix = y.group_ix""",
    "d1_merge_forward": _T + _D1 + "SELECT * FROM one",
    "d2_redistribute_backward": _T + _d2("lines"),
    "d3_fix_mistimed": _T + _D1 + _d2("one"),
    "d4_remove_empty": _E + "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY line_ix) - 1 AS line_ix, start_ms, end_ms, style, text FROM lines WHERE trim(text) <> ''",
    "d5_apply_timing_standards": padded_sql(X.TALK_LINES_SQL),
    "d6_splice": _SPLICED + "SELECT * FROM spliced",
    "d7_shift": _T + "SELECT media_id, line_ix, start_ms + media_id * 10 AS start_ms, end_ms + media_id * 10 AS end_ms, style, text FROM lines",
    "d8_cut_plan": _E + "SELECT * FROM cuts",
    "d9_parse_line_range": _T + """, r AS (SELECT DISTINCT media_id, media_id % 5 AS lo_ix, CASE WHEN media_id % 2 = 0 THEN media_id % 5 + 3 ELSE media_id % 5 END AS hi_ix FROM lines)
SELECT l.media_id, line_ix, start_ms, end_ms, style, text FROM lines l JOIN r ON l.media_id = r.media_id AND line_ix BETWEEN lo_ix AND hi_ix""",
    "d10_rebase_range": _SPLICED + """, after AS (SELECT media_id, count(*) AS m FROM spliced GROUP BY media_id)
SELECT r.media_id, lo_ix, greatest(lo_ix, hi_ix + m - n) AS hi_ix FROM ranges r JOIN sizes z ON r.media_id = z.media_id JOIN after a ON r.media_id = a.media_id""",
    "d11_pending_cuts": _E + "SELECT media_id, group_ix, cut_key FROM cuts c WHERE NOT EXISTS (SELECT 1 FROM cuts x WHERE (x.media_id + x.group_ix) % 2 = 0 AND x.media_id = c.media_id AND x.start_ms = c.start_ms AND x.end_ms = c.end_ms)",
    "d11_done_cuts": _E + "SELECT media_id, group_ix, cut_key FROM cuts c WHERE EXISTS (SELECT 1 FROM cuts x WHERE (x.media_id + x.group_ix) % 2 = 0 AND x.media_id = c.media_id AND x.start_ms = c.start_ms AND x.end_ms = c.end_ms)",
}
SQL = {k: v.replace(")SELECT", ")\nSELECT") for k, v in SQL.items()}
