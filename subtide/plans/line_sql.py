"""DuckDB forms of line building and alignment: folds over lists, as WITH entries.

``lines_from_words`` reads ``words`` and gives ``built`` (key, segment_ix,
island_ix, pos, text, start, end, speaker), with the delimiters and limits of the
registered queries: ``. ? !``, soft ``,`` and space, 40, 80 and 15 characters.
"""

from __future__ import annotations

_LINE = "STRUCT(b bigint, cut bigint, e bigint, more varchar, checked boolean)[]"
_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def shortened(x: str) -> str:
    """Units of up to six characters that stand five times or more in a row, three times; from left to right, shortest unit first."""
    unit = f"list_filter(range(1, 7), lambda u: length(substr({x}, p.i, 5 * u)) = 5 * u AND substr({x}, p.i, 5 * u) = repeat(substr({x}, p.i, u), 5) AND NOT contains(substr({x}, p.i, u), chr(10)))[1]"
    times = f"list_filter(range(5, length({x}) // q + 1), lambda k: substr({x}, p.i, k * q) = repeat(substr({x}, p.i, q), k))[-1]"
    return f"""CASE WHEN len(list_filter(range(1, length({x}) - 3), lambda i: len(list_filter(range(1, 7), lambda u: length(substr({x}, i, 5 * u)) = 5 * u AND substr({x}, i, 5 * u) = repeat(substr({x}, i, u), 5) AND NOT contains(substr({x}, i, u), chr(10)))) > 0)) = 0 THEN {x}
      ELSE list_reduce(list_transform(range(1, length({x}) + 1), lambda i: {{'i': i, 'on': 0::bigint, 'o': ''}}), lambda a, p: CASE WHEN p.i < a.on THEN a ELSE
        list_transform([{unit}], lambda q: CASE WHEN q IS NULL THEN {{'i': p.i, 'on': p.i + 1, 'o': a.o || substr({x}, p.i, 1)}}
          ELSE {{'i': p.i, 'on': p.i + q * {times}, 'o': a.o || repeat(substr({x}, p.i, q), 3)}} END)[1] END, {{'i': 0::bigint, 'on': 1::bigint, 'o': ''}}).o END"""


def lines_from_words(key: str = "media_id", halved: bool = False) -> str:
    """``halved``: texts over the hard limit are split at the first space after 30 characters, where there is one."""
    line = lambda b, cut, e, more, checked: f"{{'b': {b}, 'cut': {cut}, 'e': {e}, 'more': {more}, 'checked': {checked}}}"
    carried = "coalesce(list_filter(range(greatest(p.b, x.i - 15), x.i + 1), lambda k: c[x.i + 1] - c[k] - CASE WHEN k = p.b THEN p.cut ELSE 0 END <= 15)[1], x.i + 1)"
    if halved:
        text = "substr(array_to_string(t[p.b:x.i], ''), p.cut + 1)"
        second = f"length(trim(regexp_extract({stripped(text)}, '^(.{{30,}}?) (.*)$', 2))) + length(regexp_extract({text}, '(\\s*)$', 1))"
        carried = f"""CASE WHEN c[x.i + 1] - c[p.b] - p.cut > 80 AND regexp_matches({stripped(text)}, '^(.{{30,}}?) (.*)$') THEN
        list_transform([{second}], lambda m: coalesce(list_filter(range(p.b, x.i + 1), lambda k: c[x.i + 1] - c[k] - CASE WHEN k = p.b THEN p.cut ELSE 0 END >= m)[-1], p.b))[1] ELSE {carried} END"""
    return rf"""iw AS (SELECT *, sum(CAST(fresh AS int)) OVER (PARTITION BY {key}, segment_ix ORDER BY word_ix ROWS UNBOUNDED PRECEDING) AS island_ix FROM (
  SELECT *, coalesce(start - lag("end") OVER w > 2.0, false) OR coalesce(lag(stops) OVER w, false) AS fresh
  FROM (SELECT *, regexp_matches(text, '[.?!]$') AND NOT (length(text) > 1 AND regexp_matches(text, '^[.?!]')) AS stops FROM words) WINDOW w AS (PARTITION BY {key}, segment_ix ORDER BY word_ix))),
isl AS (SELECT {key}, segment_ix, CAST(island_ix AS bigint) AS island_ix, list(text ORDER BY word_ix) AS t, list(start ORDER BY word_ix) AS s, list("end" ORDER BY word_ix) AS e, list(speaker ORDER BY word_ix) AS sp,
  list_prepend(0, list(upto ORDER BY word_ix)) AS c FROM (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY {key}, segment_ix, island_ix ORDER BY word_ix ROWS UNBOUNDED PRECEDING) AS bigint) AS upto FROM iw) GROUP BY {key}, segment_ix, island_ix),
folded AS (SELECT *, list_reduce(list_transform(range(1, len(t) + 1), lambda i: {{'i': i, 'b': 1::bigint, 'cut': 0::bigint, 'o': []::{_LINE}}}),
  lambda a, x:
    list_transform([CASE WHEN a.b < x.i AND length(t[x.i]) > 1 AND regexp_matches(t[x.i], '^[.?!]')
        THEN {{'b': x.i, 'cut': 1::bigint, 'o': list_append(a.o, {line('a.b', 'a.cut', 'x.i - 1', 't[x.i][1]', 'false')}), 'f': false}}
        ELSE {{'b': a.b, 'cut': a.cut, 'o': a.o, 'f': regexp_matches(t[x.i], '[.?!]$')}} END], lambda p:
    list_transform([{{'n': c[x.i + 1] - c[p.b] - p.cut, 'k': {carried}}}], lambda q:
    list_transform([CASE WHEN q.n > 80 AND p.b < q.k AND q.k <= x.i
        THEN {{'b': q.k, 'cut': 0::bigint, 'o': list_append(p.o, {line('p.b', 'p.cut', 'q.k - 1', "'%%CONT%%'", 'false')}), 'f': p.f}}
        ELSE {{'b': p.b, 'cut': p.cut, 'o': p.o, 'f': p.f OR q.n > 80 OR (q.n > 40 AND regexp_matches(t[x.i], '[, ]$'))}} END], lambda r:
    CASE WHEN r.f THEN {{'i': x.i, 'b': x.i + 1, 'cut': 0::bigint, 'o': list_append(r.o, {line('r.b', 'r.cut', 'x.i', "''", 'true')})}}
      ELSE {{'i': x.i, 'b': r.b, 'cut': r.cut, 'o': r.o}} END)[1])[1])[1],
  {{'i': 0::bigint, 'b': 1::bigint, 'cut': 0::bigint, 'o': []::{_LINE}}}) AS z FROM isl),
raw AS (SELECT {key}, segment_ix, island_ix, t, s, e, sp, unnest(l) AS l, CAST(unnest(range(len(l))) AS bigint) AS pos
  FROM (SELECT *, CASE WHEN z.b <= len(t) THEN list_append(z.o, {line('z.b', 'z.cut', 'len(t)::bigint', "''", 'true')}) ELSE z.o END AS l FROM folded)),
plain AS (SELECT {key}, segment_ix, island_ix, pos, l.checked AS checked, {stripped("regexp_replace(substr(array_to_string(t[l.b:l.e], ''), l.cut + 1) || l.more, '^-', '')")} AS y, s[l.b] AS start, e[l.e] AS "end", sp[l.b] AS speaker FROM raw),
built AS (SELECT * FROM (SELECT {key}, segment_ix, island_ix, pos, {shortened('y')} AS text, start, "end", speaker, checked FROM plain) WHERE NOT (checked AND text IN ('.', '?', '!', ',', ' ')))"""


def numbered(key: str = "media_id") -> str:
    """SELECT of lines, with line_ix and whole milliseconds, from ``built``."""
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY segment_ix, island_ix, pos) - 1 AS line_ix, CAST(round_even(start * 1000.0::DOUBLE, 0) AS bigint) AS start_ms, CAST(round_even("end" * 1000.0::DOUBLE, 0) AS bigint) AS end_ms, 'Default' AS style, text, speaker FROM built"""


#: Tokens of documents that have their words: segments count anew, white space falls into characters at the end of the word before.
ALIGNED = r"""spoken AS (SELECT *, min(word_ix) FILTER (type = 'word') OVER g AS a, max(word_ix) FILTER (type = 'word') OVER g AS b,
    last_value(CASE WHEN type = 'word' THEN "end" END IGNORE NULLS) OVER (PARTITION BY media_id, segment_ix ORDER BY word_ix ROWS UNBOUNDED PRECEDING) AS until
  FROM words WHERE media_id % 50 <> 49 WINDOW g AS (PARTITION BY media_id, segment_ix)),
parts AS (SELECT media_id, dense_rank() OVER (PARTITION BY media_id ORDER BY segment_ix) - 1 AS segment_ix, word_ix, CASE WHEN type = 'word' THEN [text] ELSE string_split(text, '') END AS ts, type, start, "end", until, speaker FROM spoken WHERE word_ix BETWEEN a AND b),
each AS (SELECT media_id, segment_ix, word_ix, unnest(ts) AS text, unnest(range(len(ts))) AS k, type, CASE WHEN type = 'word' THEN start ELSE until END AS start, CASE WHEN type = 'word' THEN "end" ELSE until END AS "end", speaker FROM parts),
aligned AS (SELECT media_id, CAST(segment_ix AS int) AS segment_ix, CAST(row_number() OVER (PARTITION BY media_id, segment_ix ORDER BY word_ix, k) - 1 AS int) AS word_ix, text, start, "end", type, speaker FROM each)"""

#: Ellipses as a loop over neighbours leaves them, from ``d`` (media_id, batch_ix, attempt, pos, entry).
ELLIPSES_COMPAT = """neighbours AS (SELECT media_id, batch_ix, attempt, list(entry ORDER BY pos) AS rows FROM d GROUP BY ALL),
walked AS (SELECT media_id, batch_ix, attempt, list_reduce(list_transform(rows[2:], lambda x: {'x': x, 'cur': '', 'o': []::varchar[]}), lambda a, b:
    {'x': b.x, 'cur': CASE WHEN starts_with(b.x, '...') THEN substr(b.x, 4) WHEN starts_with(a.cur, '...') THEN substr(a.cur, 4) ELSE b.x END,
     'o': list_append(a.o, CASE WHEN ends_with(a.cur, '...') AND starts_with(b.x, '...') THEN left(a.cur, length(a.cur) - 3) ELSE a.cur END)},
    {'x': '', 'cur': rows[1], 'o': []::varchar[]}) AS z FROM neighbours)
SELECT media_id, batch_ix, attempt, CAST(unnest(range(len(z.o) + 1)) AS bigint) AS pos, unnest(list_append(z.o, z.cur)) AS entry FROM walked"""
