"""SQL for the other engine of the order-dependent operators: recursion over a key's rows with the state in columns."""

from __future__ import annotations

from hushframe.operators import audio, evaluation

HOUR = 3_600_000

# --- detection quality: greedy matching, one prediction of each image and class a step

_BOXES = """t AS (SELECT frame AS image, kind AS class, ordinal, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM v_regions WHERE line <= 4),
p AS (SELECT frame AS image, kind AS class, ordinal, confidence AS score, x + s AS x1, y + s AS y1, x + w + s AS x2, y + h + s AS y2 FROM (SELECT *, (supp % 7 - 3) / 100.0::DOUBLE AS s FROM v_regions)),
o AS (SELECT image, class, p.ordinal, t.ordinal AS truth, greatest(0.0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0.0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS i,
  (t.x2 - t.x1) * (t.y2 - t.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS areas FROM p JOIN t USING (image, class)),
near AS (SELECT image, class, ordinal, list({'iou': i / (areas - i), 'truth': truth} ORDER BY i / (areas - i) DESC, truth) AS near FROM o WHERE areas - i > 0 GROUP BY ALL),
turns AS (SELECT image, class, ordinal, score, near, row_number() OVER (PARTITION BY image, class ORDER BY score DESC, ordinal) AS k FROM p LEFT JOIN near USING (image, class, ordinal))"""


def _matched(thresholds: tuple[float, ...]) -> str:
    values = ", ".join(f"{x}::DOUBLE" for x in thresholds)
    return f"""{_BOXES}, st AS (
  SELECT image, class, unnest([{values}]) AS threshold, cast(0 AS BIGINT) AS k, cast([] AS BIGINT[]) AS used, cast(NULL AS BIGINT) AS ordinal, cast(NULL AS DOUBLE) AS score, false AS hit FROM (SELECT DISTINCT image, class FROM p) UNION ALL
  SELECT image, class, threshold, k, CASE WHEN truth IS NULL THEN used ELSE list_append(used, truth) END, ordinal, score, truth IS NOT NULL FROM (
    SELECT s.image, s.class, s.threshold, q.k, s.used, q.ordinal, q.score, list_filter(coalesce(q.near, []), lambda c: c.iou >= s.threshold AND NOT list_contains(s.used, c.truth))[1].truth AS truth
    FROM st s JOIN turns q ON q.image = s.image AND q.class = s.class AND q.k = s.k + 1)),
m AS (SELECT image, class, ordinal, score, threshold, hit FROM st WHERE k > 0)"""


MATCH = f"WITH RECURSIVE {_matched((0.5,))} SELECT * FROM m"
PR = f"""WITH RECURSIVE {_matched((0.5,))}, h AS (SELECT class, threshold, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM m WHERE score >= 0.25 GROUP BY ALL),
l AS (SELECT class, threshold, n FROM (SELECT class, count(*) AS n FROM t GROUP BY class), (SELECT DISTINCT threshold FROM m)),
b AS (SELECT class, threshold, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM l FULL JOIN h USING (class, threshold)),
g AS (SELECT class, threshold, cast(sum(tp) AS BIGINT) AS tp, cast(sum(fp) AS BIGINT) AS fp, cast(sum(n) AS BIGINT) AS n FROM b GROUP BY GROUPING SETS ((class, threshold), (threshold)))
SELECT class, threshold, tp, fp, n - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS recall, 1 - CASE WHEN n > 0 THEN tp / n ELSE 0 END AS miss_rate FROM g"""
_AP = f"""{_matched(evaluation.THRESHOLDS)}, l AS (SELECT class, count(*) AS n FROM t GROUP BY class),
c AS (SELECT class, threshold, sum(cast(hit AS INT)) OVER w AS tp, row_number() OVER w AS rank FROM m WINDOW w AS (PARTITION BY class, threshold ORDER BY score DESC, image, ordinal ROWS UNBOUNDED PRECEDING)),
best AS (SELECT class, threshold, cast(floor(tp * 100 / n) AS INT) AS level, max(tp / rank) AS precision FROM c JOIN l USING (class) GROUP BY ALL),
r AS (SELECT l.class, x.threshold, level AS at FROM l, (SELECT DISTINCT threshold FROM m) x, range(101) g(level)),
ap AS (SELECT r.class, r.threshold, sum(coalesce((SELECT max(precision) FROM best b WHERE b.class = r.class AND b.threshold = r.threshold AND b.level >= r.at), 0)) / 101 AS ap FROM r GROUP BY ALL)"""
AP = f"WITH RECURSIVE {_AP} SELECT class, threshold, round(ap, 9) AS ap FROM ap"
MAP = f"WITH RECURSIVE {_AP} SELECT round(avg(ap) FILTER (WHERE threshold = 0.5), 9) AS map50, round(avg(ap), 9) AS map FROM ap"

# --- pixels: one row for each byte of a frame

_PIXELS = """bx AS (SELECT frame, ordinal, greatest(0, least(floor(x * 16), 15)) AS l, greatest(0, least(floor(y * 12), 11)) AS t, ceil((x + w) * 16) AS r, ceil((y + h) * 12) AS b FROM v_regions),
fr AS (SELECT frame, sha256(cast(frame AS VARCHAR)) AS h, list({'l': cast(l AS INT), 't': cast(t AS INT), 'r': cast(least(16, greatest(l + 1, r)) AS INT), 'b': cast(least(12, greatest(t + 1, b)) AS INT)} ORDER BY ordinal) AS boxes FROM bx GROUP BY frame),
px AS (SELECT frame, h, i, cast(i // 48 AS INT) AS y, cast(i // 3 % 16 AS INT) AS x, cast(i % 3 AS INT) AS c, boxes FROM fr, range(576) g(i)),
hit AS (SELECT *, list_filter(boxes, lambda q: q.l <= x AND x < q.r AND q.t <= y AND y < q.b)[-1] AS q FROM px)"""
_BYTE = "substr(h, cast(2 * ({}) % 64 AS INT) + 1, 2)"


def raster(style: str) -> str:
    own = _BYTE.format("i")
    if style == "cover":
        value = "'00'"
    elif style == "pixelate":
        value = _BYTE.format("(least(q.b - 1, q.t + (y - q.t) // 8 * 8 + 4) * 16 + least(q.r - 1, q.l + (x - q.l) // 8 * 8 + 4)) * 3 + c")
    else:
        inside = "y + k // 5 - 2 BETWEEN 0 AND 11 AND x + k % 5 - 2 BETWEEN 0 AND 15"
        byte = f"cast('0x' || {_BYTE.format('((y + k // 5 - 2) * 16 + x + k % 5 - 2) * 3 + c')} AS INT)"
        value = f"printf('%02x', cast(list_sum(list_transform(range(25), lambda k: CASE WHEN {inside} THEN {byte} ELSE 0 END)) // len(list_filter(range(25), lambda k: {inside})) AS INT))"
    return f"WITH {_PIXELS} SELECT frame, 'ok' AS status, sha256(unhex(string_agg(CASE WHEN q IS NULL THEN {own} ELSE {value} END, '' ORDER BY i))) AS payload_sha256 FROM hit GROUP BY frame"


# --- speech segments: a chunk of 100 ms a step

SEGMENTS = """WITH RECURSIVE st AS (
  SELECT stream, cast(-1 AS BIGINT) AS seq, cast(NULL AS BIGINT) AS opened, cast(NULL AS BIGINT) AS fin, cast(NULL AS BIGINT) AS voice, cast(0 AS BIGINT) AS low, cast(NULL AS BIGINT) AS a, cast(NULL AS BIGINT) AS b FROM (SELECT DISTINCT stream FROM v_frames) UNION ALL
  SELECT stream, seq, CASE WHEN full_ THEN o + 1000 WHEN shut THEN NULL ELSE o END, f, CASE WHEN shut THEN NULL ELSE v END, CASE WHEN shut THEN f ELSE low END, CASE WHEN full_ OR shut AND f > o THEN o END, CASE WHEN full_ THEN o + 1000 WHEN shut AND f > o THEN f END FROM (
    SELECT *, o IS NOT NULL AND talks AND f - o >= 1000 AS full_, o IS NOT NULL AND NOT talks AND e - v >= 250 AS shut FROM (
      SELECT *, CASE WHEN o IS NOT NULL THEN least(e, v + 250) ELSE f0 END AS f FROM (
        SELECT s.stream, x.seq, s.low, s.fin AS f0, x.seq * 100 + 100 AS e, event_id % 7 < 3 AS talks, CASE WHEN event_id % 7 < 3 THEN coalesce(opened, greatest(x.seq * 100 + 10 - 150, low)) ELSE opened END AS o, CASE WHEN event_id % 7 < 3 THEN x.seq * 100 + 90 ELSE voice END AS v
        FROM st s JOIN v_frames x ON x.stream = s.stream AND x.seq = s.seq + 1)))),
out AS (SELECT stream, seq, a, b FROM st WHERE a IS NOT NULL UNION ALL
  SELECT stream, seq + 1, opened, fin FROM st s WHERE opened IS NOT NULL AND fin > opened AND seq = (SELECT max(seq) FROM v_frames x WHERE x.stream = s.stream))
SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS segment, a AS start_ms, b AS end_ms FROM out"""

# --- the synchroniser: an event a step

BUFFERED = f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY due, kind, event_id) AS k FROM (
  SELECT event_id, stream, ts_ms * 2 AS due, 'frame' AS kind, seq, ts_ms, cast(NULL AS BIGINT) AS a, cast(NULL AS BIGINT) AS b FROM v_frames UNION ALL SELECT event_id, stream, end_ms * 2 + 1, 'audio', NULL, NULL, start_ms, end_ms FROM v_intervals)),
st AS (
  SELECT stream, cast(0 AS BIGINT) AS k, cast([] AS STRUCT(seq BIGINT, ts BIGINT)[]) AS waits, cast(NULL AS BIGINT) AS wm, cast([] AS STRUCT(seq BIGINT, ts BIGINT)[]) AS freed, cast([] AS STRUCT(seq BIGINT, ts BIGINT)[]) AS lost FROM (SELECT DISTINCT stream FROM ev) UNION ALL
  SELECT stream, k, list_filter(rest, lambda x, i: i > len(rest) - 5 AND rest[-1].ts - x.ts <= {48 * HOUR}), wm, list_filter(p, lambda x: coalesce(wm >= x.ts + {3 * HOUR}, false)), list_filter(rest, lambda x, i: NOT (i > len(rest) - 5 AND rest[-1].ts - x.ts <= {48 * HOUR})) FROM (
    SELECT *, list_filter(p, lambda x: NOT coalesce(wm >= x.ts + {3 * HOUR}, false)) AS rest FROM (
      SELECT s.stream, e.k, CASE WHEN e.kind = 'frame' THEN list_append(s.waits, {{'seq': e.seq, 'ts': e.ts_ms}}) ELSE s.waits END AS p, CASE WHEN e.kind = 'audio' THEN e.b ELSE s.wm END AS wm
      FROM st s JOIN ev e ON e.stream = s.stream AND e.k = s.k + 1))),
freed AS (SELECT stream, k, wm, unnest(freed) AS f FROM st)
SELECT stream, f.seq AS seq, CASE WHEN EXISTS (SELECT 1 FROM ev e WHERE e.stream = g.stream AND e.kind = 'audio' AND e.k <= g.k AND e.b + {HOUR} > g.f.ts AND e.a - {HOUR} < g.f.ts + {2 * HOUR}) THEN 'sensitive_speech' ELSE 'no_sensitive_speech' END AS status, NULL AS reason, greatest(0, wm - f.ts) AS delay_ms FROM freed g UNION ALL
SELECT stream, f.seq, 'failed', 'unsafe_buffer_overflow', NULL FROM (SELECT stream, unnest(lost) AS f FROM st) UNION ALL
SELECT stream, f.seq, 'failed', 'unsafe_audio_incomplete', NULL FROM (SELECT stream, unnest(waits) AS f FROM st s WHERE k = (SELECT max(k) FROM ev e WHERE e.stream = s.stream))"""

# --- tracks: streams with one region a frame

TRACKS = """WITH RECURSIVE fr AS (SELECT (supp % 50) * 10 + line AS stream, frame AS seq, kind, x, y, w, h, row_number() OVER (PARTITION BY supp % 50, line ORDER BY frame) AS k FROM v_regions WHERE ordinal = line),
st AS (
  SELECT stream, cast(0 AS BIGINT) AS k, cast(NULL AS BIGINT) AS seq, cast(NULL AS BIGINT) AS key, cast(NULL AS VARCHAR) AS kind, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS w, 0.0::DOUBLE AS h, cast(NULL AS BIGINT) AS until, cast(0 AS BIGINT) AS fresh, '' AS status FROM (SELECT DISTINCT stream FROM fr) UNION ALL
  SELECT stream, k, seq, CASE WHEN ok THEN CASE WHEN same THEN key ELSE fresh END WHEN live THEN key END, CASE WHEN ok THEN kind2 WHEN live THEN kind END, CASE WHEN ok THEN x2 ELSE x END, CASE WHEN ok THEN y2 ELSE y END, CASE WHEN ok THEN w2 ELSE w END, CASE WHEN ok THEN h2 ELSE h END,
    CASE WHEN ok THEN seq + 2000 WHEN live THEN until END, fresh + CASE WHEN ok AND NOT same THEN 1 ELSE 0 END, CASE WHEN ok THEN 'success' ELSE 'timeout' END FROM (
    SELECT *, live AND kind = kind2 AND i / (w * h + w2 * h2 - i) >= 0.3 AS same FROM (
      SELECT s.stream, q.k, q.seq, s.key, s.kind, s.x, s.y, s.w, s.h, s.until, s.fresh, q.kind AS kind2, q.x AS x2, q.y AS y2, q.w AS w2, q.h AS h2, q.seq % 7 <> 0 AS ok, coalesce(s.until > q.seq, false) AS live,
        greatest(0.0, least(s.x + s.w, q.x + q.w) - greatest(s.x, q.x)) * greatest(0.0, least(s.y + s.h, q.y + q.h) - greatest(s.y, q.y)) AS i
      FROM st s JOIN fr q ON q.stream = s.stream AND q.k = s.k + 1)))
SELECT stream, seq, 'plate' AS detector, key AS region_key, kind, status FROM st WHERE k > 0"""

# --- words as they would be written

SPOKEN_TABLE = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**audio.SYMBOLS, **audio.DIGITS}.items()) + " ELSE t END"
TOKENS = rf"""w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS pos FROM documents),
tk AS (SELECT doc_id, pos, {SPOKEN_TABLE} AS token FROM (SELECT doc_id, pos, trim(lower(word), ' ,;:!?') AS t FROM w) WHERE t <> ''),
pl AS (SELECT doc_id, pos, token, sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(token) - 1 AS a FROM tk),
spoken AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tk GROUP BY doc_id)"""


def spoken_pii(spans: str) -> str:
    """spans: the SQL for spans of a table spoken (doc_id, text)."""
    return f"""WITH {TOKENS}, s AS ({spans}), n AS (SELECT *, row_number() OVER () AS id FROM s)
SELECT n.doc_id, min(pos * 300) AS start_ms, max(pos * 300 + 280) AS end_ms, min(0.5 + pos % 50 / 100.0::DOUBLE) AS confidence, any_value(category) AS reason
FROM n JOIN pl ON pl.doc_id = n.doc_id AND pl.a + length(pl.token) > n.start_pos AND pl.a < n.end_pos GROUP BY n.id, n.doc_id"""
