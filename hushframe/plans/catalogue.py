"""The query catalogue: Spark plans over the input tables, and the SQL that an independent engine runs beside them.

Durations are hours where the operators' defaults are milliseconds, as the event tables are minutes apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.operators import audio, cross_modal, evaluation, gate, geometry, identity, intervals, manifests, raster, regions, text_pii
from hushframe.plans import sequential_sql as sequential
from hushframe.sources.tables import table, view, with_views
from hushframe.streaming import twins

FLAGSHIP = "text_pii_spans"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with the other engine's SQL if there is one."""

    def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return registered


# --- personal data in text

_EMAIL = r"[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+\s*@\s*[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\s*\.\s*[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+"
_EMAILS = rf"regexp_extract_all(coalesce(text, ''), '(?:^|[^\p{{L}}\p{{N}}_.+-])({_EMAIL})', 1)"
_PHONES = r"list_filter(regexp_extract_all(coalesce(text, ''), '(?:^|[^\p{L}\p{N}_])(\+?\d[\d\s().-]*\d)(?:[^\p{L}\p{N}_]|$)', 1), lambda v: length(regexp_replace(v, '\D', '', 'g')) BETWEEN 8 AND 15 AND NOT regexp_full_match(v, '\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}') AND NOT regexp_full_match(v, '\d+\.\d{1,2}'))"


def _placed(found: str, category: str, source: str, confidence: str) -> str:
    """Matches with their places: each one is looked for behind the one before it."""
    return f"""SELECT doc_id, '{category}' AS category, '{source}' AS source, {confidence} AS confidence, unnest(list_reduce({found}, lambda acc, m: {{
      'at': acc.at + instr(substr(text, acc.at + 1), m.v) - 1 + length(m.v), 'v': '', 'out': list_append(acc.out, {{'a': acc.at + instr(substr(text, acc.at + 1), m.v) - 1, 'b': acc.at + instr(substr(text, acc.at + 1), m.v) - 1 + length(m.v)}})}},
      {{'at': cast(0 AS BIGINT), 'v': '', 'out': cast([] AS STRUCT(a BIGINT, b BIGINT)[])}}).out) AS p FROM documents"""


def _as_items(found: str) -> str:
    return f"list_transform({found}, lambda v: {{'at': cast(0 AS BIGINT), 'v': v, 'out': cast([] AS STRUCT(a BIGINT, b BIGINT)[])}})"


_SPANS = f"""SELECT doc_id, category, confidence, cast(p.a AS INT) AS start_pos, cast(p.b AS INT) AS end_pos, source FROM
 ({_placed(_as_items(_EMAILS), "email", "text-email-regex", "0.99::DOUBLE")} UNION ALL {_placed(_as_items(_PHONES), "phone_number", "text-phone-regex", "0.95::DOUBLE")})"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query("text_email_counts", f"SELECT doc_id, cast(len({_EMAILS}) AS BIGINT) AS email_count FROM documents WHERE len({_EMAILS}) > 0")
def text_email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_pii.matches(F.col("text"), text_pii.EMAIL)
    return _documents(spark, sf_dir).filter(F.col("text").contains("@")).select("doc_id", F.size(found).cast("long").alias("email_count")).filter("email_count > 0")


@query("text_phone_counts", f"SELECT doc_id, cast(len({_PHONES}) AS BIGINT) AS phone_count FROM documents WHERE len({_PHONES}) > 0")
def text_phone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(text_pii.matches(F.col("text"), text_pii.PHONE), lambda m: text_pii.plausible_phone(m["value"]))
    return _documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("phone_count")).filter("phone_count > 0")


@query("text_pii_spans", _SPANS)
def text_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _documents(spark, sf_dir).select("doc_id", F.explode(text_pii.spans(F.col("text"))).alias("s"))
    return each.select("doc_id", "s.category", "s.confidence", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), "s.source")


@query("text_pii_by_source_lang", f"SELECT lang, category, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM ({_SPANS}) JOIN documents USING (doc_id) GROUP BY lang, category")
def text_pii_by_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _documents(spark, sf_dir).select("doc_id", "lang", F.explode(text_pii.spans(F.col("text"))).alias("s"))
    return each.groupBy("lang", F.col("s.category").alias("category")).agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"))


_WORDS_CONFIG = text_pii.Config(email=False, phone=False, patterns=(text_pii.Pattern("government_id", r"\b\d{3}-\d{4}\b"), text_pii.Pattern("payment_identifier", r"\b\d{16}\b", 0.8)))


@query("configured_patterns", r"""SELECT doc_id, category, count(*) AS spans FROM (
  SELECT doc_id, 'government_id' AS category, unnest(regexp_extract_all(text, '\b\d{3}-\d{4}\b')) AS v FROM documents UNION ALL
  SELECT doc_id, 'payment_identifier', unnest(regexp_extract_all(text, '\b\d{16}\b')) FROM documents) GROUP BY doc_id, category""")
def configured_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _documents(spark, sf_dir).select("doc_id", F.explode(text_pii.spans(F.col("text"), _WORDS_CONFIG)).alias("s"))
    return each.groupBy("doc_id", F.col("s.category").alias("category")).agg(F.count("*").alias("spans"))


@query("redacted_chars", f"SELECT doc_id, cast(sum(end_pos - start_pos) AS BIGINT) AS marks, cast(any_value(length(text)) AS BIGINT) AS n_chars FROM ({_SPANS}) JOIN documents USING (doc_id) GROUP BY doc_id")
def redacted_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters redaction replaces in each text, and the redacted text's length, which is the text's."""
    found = _documents(spark, sf_dir).select("doc_id", text_pii.redact(F.col("text"), text_pii.spans(F.col("text"))).alias("r"))
    marks = F.length("r") - F.length(F.replace("r", F.lit("█"), F.lit("")))
    return found.select("doc_id", marks.cast("long").alias("marks"), F.length("r").cast("long").alias("n_chars")).filter("marks > 0")


@query("ocr_text_forms", r"SELECT item_id, md5(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'), ' |~')) AS form FROM benchmark")
def ocr_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(text_pii.normalise_ocr(F.col("text"))).alias("form"))


# --- boxes and regions


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    x, y = (c("doc_id") % 150).cast("double"), (c("doc_id") % 80).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    polygon = F.array(point(x, y), point(x + 60, y + 2), point(x + 58, y + 20), point(x - 1, y + 19))
    return _documents(spark, sf_dir).select("doc_id", "text", polygon.alias("polygon"), ((c("doc_id") % 10) / 10.0).alias("confidence"), F.lit(200).alias("width"), F.lit(100).alias("height"))


_FORM = "(SELECT doc_id, trim(regexp_replace(replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '…', '...'), '\\s+', ' ', 'g'), ' |~') AS text FROM documents)"


@query("ocr_regions", f"""WITH s AS ({_SPANS.replace("FROM documents", "FROM " + _FORM)}),
b AS (SELECT doc_id, doc_id % 150 AS x, doc_id % 80 AS y, (doc_id % 10) / 10.0 AS confidence FROM documents),
k AS (SELECT doc_id, CASE WHEN count(DISTINCT category) = 1 THEN min(category) ELSE 'custom_sensitive_text' END AS kind FROM s GROUP BY doc_id),
g AS (SELECT doc_id, kind, confidence, greatest(0.0, x - 1 - 4.0) AS x1, greatest(0.0, y - 2.0) AS y1, least(200.0, x + 60 + 4.0) AS x2, least(100.0, y + 20 + 2.0) AS y2 FROM b JOIN k USING (doc_id) WHERE confidence >= 0.4)
SELECT doc_id, kind, cast(confidence AS DOUBLE) AS confidence, round(cast(x1 / 200 AS DOUBLE), 9) AS x, round(cast(y1 / 100 AS DOUBLE), 9) AS y, round(cast((x2 - x1) / 200 AS DOUBLE), 9) AS w, round(cast((y2 - y1) / 100 AS DOUBLE), 9) AS h FROM g WHERE x2 > x1 AND y2 > y1""")
def ocr_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.ocr_regions(text_pii.classify_ocr(_blocks(spark, sf_dir), "text"), F.col("spans"))
    return found.select("doc_id", "kind", "confidence", *[F.round(c, 9).alias(c) for c in "xywh"])


@query("letterbox_map", """WITH b AS (SELECT p_partkey AS id, 640 + 10 * (p_partkey % 50) AS fw, 360 + 10 * (p_partkey % 37) AS fh, p_partkey % 300 AS a, p_partkey % 200 AS c FROM part),
s AS (SELECT *, least(640.0::DOUBLE / fw, 640.0::DOUBLE / fh) AS scale FROM b),
p AS (SELECT *, floor((640 - round_even(fw * scale, 0)) / 2) AS px, floor((640 - round_even(fh * scale, 0)) / 2) AS py FROM s)
SELECT id, round(greatest(0.0, least((a - px) / scale, cast(fw AS DOUBLE))), 6) AS x1, round(greatest(0.0, least((c - py) / scale, cast(fh AS DOUBLE))), 6) AS y1,
  round(greatest(0.0, least((a + 200 - px) / scale, cast(fw AS DOUBLE))), 6) AS x2, round(greatest(0.0, least((c + 150 - py) / scale, cast(fh AS DOUBLE))), 6) AS y2 FROM p""")
def letterbox_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    w, h = 640 + 10 * (k % 50), 360 + 10 * (k % 37)
    a, c = k % 300, k % 200
    box = geometry.from_letterbox(a, c, a + 200, c + 150, geometry.letterbox(w, h, 640))
    return table(spark, sf_dir, "part").select(k.alias("id"), *[F.round(v, 6).alias(n) for n, v in box.items()])


@query("region_pad_clamp", """WITH g AS (SELECT frame, ordinal, line * 33 AS ts_ms, greatest(0.0, least(x - 12 / 1920.0::DOUBLE, 1.0)) AS x1, greatest(0.0, least(y - 12 / 1080.0::DOUBLE, 1.0)) AS y1, greatest(0.0, least(x + w + 12 / 1920.0::DOUBLE, 1.0)) AS x2, greatest(0.0, least(y + h + 12 / 1080.0::DOUBLE, 1.0)) AS y2 FROM v_regions)
SELECT frame, ordinal, round(x1, 9) AS x, round(y1, 9) AS y, round(x2 - x1, 9) AS w, round(y2 - y1, 9) AS h, cast(ts_ms + 250 AS BIGINT) AS expires_ms, x2 > x1 AND y2 > y1 AS valid FROM g""")
def region_pad_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_regions").select("frame", "ordinal", "x", "y", "w", "h", (F.col("line") * 33).cast("long").alias("ts_ms"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return geometry.pad_regions(rows, pad_px=12, ttl_ms=250).select("frame", "ordinal", *[F.round(c, 9).alias(c) for c in "xywh"], "expires_ms", "valid")


@query("region_pixels", """SELECT frame, ordinal, cast(greatest(0, least(floor(x * 97), 96)) AS BIGINT) AS left_px, cast(greatest(0, least(floor(y * 53), 52)) AS BIGINT) AS top_px,
  cast(least(97, greatest(greatest(0, least(floor(x * 97), 96)) + 1, ceil((x + w) * 97))) AS BIGINT) AS right_px, cast(least(53, greatest(greatest(0, least(floor(y * 53), 52)) + 1, ceil((y + h) * 53))) AS BIGINT) AS bottom_px FROM v_regions""")
def region_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = geometry.pixel_bounds(F.lit(97), F.lit(53))
    return view(spark, sf_dir, "v_regions").select("frame", "ordinal", *[v.cast("long").alias(k) for k, v in bounds.items()])


@query("region_iou_pairs", """SELECT frame, a, b, round(i / (wa * ha + wb * hb - i), 9) AS iou FROM (
  SELECT p.frame, p.ordinal AS a, q.ordinal AS b, p.w AS wa, p.h AS ha, q.w AS wb, q.h AS hb,
    greatest(0.0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0.0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS i
  FROM v_regions p JOIN v_regions q ON p.frame = q.frame AND p.ordinal < q.ordinal) WHERE i / (wa * ha + wb * hb - i) > 0""")
def region_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.overlapping_pairs(view(spark, sf_dir, "v_regions")).select("frame", "a", "b", F.round("iou", 9).alias("iou"))


@query("region_merge", """WITH items AS (SELECT frame, list(struct_pack(at := cast(0 AS BIGINT), kind := kind, x := x, y := y, w := w, h := h, confidence := confidence, n := cast(1 AS BIGINT), done := cast([] AS STRUCT(kind VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, confidence DOUBLE, n BIGINT)[])) ORDER BY kind, confidence DESC, ordinal) AS l FROM v_regions GROUP BY frame),
folded AS (SELECT frame, list_reduce(l, lambda acc, r: struct_pack(at := cast(0 AS BIGINT), kind := '', x := 0.0::DOUBLE, y := 0.0::DOUBLE, w := 0.0::DOUBLE, h := 0.0::DOUBLE, confidence := 0.0::DOUBLE, n := cast(0 AS BIGINT), done :=
    CASE WHEN len(list_filter(acc.done, lambda o: o.kind = r.kind AND least(o.x + o.w, r.x + r.w) > greatest(o.x, r.x) AND least(o.y + o.h, r.y + r.h) > greatest(o.y, r.y))) = 0
    THEN list_append(acc.done, struct_pack(kind := r.kind, x := r.x, y := r.y, w := r.w, h := r.h, confidence := r.confidence, n := r.n))
    ELSE list_transform(acc.done, lambda o, k: CASE WHEN k = list_position(list_transform(acc.done, lambda q: q.kind = r.kind AND least(q.x + q.w, r.x + r.w) > greatest(q.x, r.x) AND least(q.y + q.h, r.y + r.h) > greatest(q.y, r.y)), true)
      THEN struct_pack(kind := o.kind, x := least(o.x, r.x), y := least(o.y, r.y), w := greatest(o.x + o.w, r.x + r.w) - least(o.x, r.x), h := greatest(o.y + o.h, r.y + r.h) - least(o.y, r.y), confidence := greatest(o.confidence, r.confidence), n := o.n + r.n) ELSE o END) END),
    struct_pack(at := cast(0 AS BIGINT), kind := '', x := 0.0::DOUBLE, y := 0.0::DOUBLE, w := 0.0::DOUBLE, h := 0.0::DOUBLE, confidence := 0.0::DOUBLE, n := cast(0 AS BIGINT), done := cast([] AS STRUCT(kind VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, confidence DOUBLE, n BIGINT)[]))).done AS d FROM items)
SELECT frame, cast(k - 1 AS INT) AS place, d[k].kind AS kind, round(d[k].x, 9) AS x, round(d[k].y, 9) AS y, round(d[k].w, 9) AS w, round(d[k].h, 9) AS h, round(d[k].confidence, 9) AS confidence, cast(d[k].n AS INT) AS n FROM (SELECT frame, d, unnest(range(1, len(d) + 1)) AS k FROM folded)""")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.merge_regions(view(spark, sf_dir, "v_regions"))
    return found.select("frame", "place", "region.kind", *[F.round(F.col(f"region.{c}"), 9).alias(c) for c in ("x", "y", "w", "h", "confidence")], F.col("region.n").alias("n"))


@query("region_ttl_active", f"""SELECT f.stream, f.seq, f.ts_ms, count(r.start_ms) AS active FROM v_frames f LEFT JOIN v_intervals r ON r.stream = f.stream AND r.start_ms <= f.ts_ms AND r.start_ms + {24 * HOUR} > f.ts_ms GROUP BY ALL""")
def region_ttl_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = view(spark, sf_dir, "v_intervals").select("stream", F.col("start_ms").alias("from_ms"), (F.col("start_ms") + 24 * HOUR).alias("expires_ms"))
    return regions.active(view(spark, sf_dir, "v_frames"), live, "stream", bucket=24 * HOUR)


@query("region_tracks", sequential.TRACKS)
def region_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_regions").filter("ordinal = line")  # a stream has one region a frame, which the other engine can follow
    item = F.struct("kind", "x", "y", "w", "h", F.lit("").alias("track"))
    frames = rows.select(((F.col("supp") % 50) * 10 + F.col("line")).alias("stream"), F.col("frame").alias("seq"), F.array(item).alias("regions"))
    frames = frames.withColumns({"ts_ms": F.col("seq"), "detector": F.lit("plate"), "status": F.when(F.col("seq") % 7 == 0, "timeout").otherwise("success"), "ttl_ms": F.lit(2000)})
    return regions.track(frames)


@query("cadence_status", """SELECT r.stream, f.seq, r.detector, CASE WHEN f.seq % 3 <> 0 THEN 'skipped' WHEN outcome = 'called' AND duration_ms > 100 THEN 'timeout' WHEN outcome = 'called' THEN 'success' ELSE outcome END AS status
  FROM v_runs r JOIN v_frames f USING (event_id)""")
def cadence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "v_runs").join(view(spark, sf_dir, "v_frames").select("event_id", "seq"), "event_id")
    return regions.run_status(runs, cadence=3, timeout_ms=100).select("stream", "seq", "detector", "status")


@query("detector_metrics", """WITH s AS (SELECT r.detector, duration_ms, CASE WHEN f.seq % 3 <> 0 THEN 'skipped' WHEN outcome = 'called' AND duration_ms > 100 THEN 'timeout' WHEN outcome = 'called' THEN 'success' ELSE outcome END AS status FROM v_runs r JOIN v_frames f USING (event_id))
SELECT detector, count(*) FILTER (WHERE status <> 'skipped') AS calls, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'timeout') AS timeouts,
  count(*) FILTER (WHERE status IN ('timeout', 'unavailable', 'invalid', 'error')) AS failures, round(sum(duration_ms) FILTER (WHERE status <> 'skipped'), 3) AS total_ms, round(max(duration_ms) FILTER (WHERE status <> 'skipped'), 3) AS max_ms FROM s GROUP BY detector""")
def detector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "v_runs").join(view(spark, sf_dir, "v_frames").select("event_id", "seq"), "event_id")
    return regions.detector_metrics(regions.run_status(runs, cadence=3, timeout_ms=100))


@query("last_known_regions", """WITH l AS (SELECT stream, seq, last_value(CASE WHEN seq % 5 = 0 THEN seq END IGNORE NULLS) OVER w AS seen, last_value(CASE WHEN seq % 5 = 0 THEN event_id END IGNORE NULLS) OVER w AS what FROM v_frames WINDOW w AS (PARTITION BY stream ORDER BY seq))
SELECT stream, seq, CASE WHEN seq - seen <= 2 THEN seq - seen END AS age, CASE WHEN seq - seen <= 2 THEN what END AS reused FROM l""")
def last_known_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.last_known(view(spark, sf_dir, "v_frames"), "event_id", cadence=5, ttl=2).select("stream", "seq", "age", "reused")


# --- embeddings

_UNIT = "list_transform(cast(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(cast(embedding AS DOUBLE[]), lambda y: y * y))))"
_TEMPLATE = f"""own AS (SELECT vec_id, {_UNIT} AS u FROM embeddings WHERE label = 0),
mean AS (SELECT i, sum(u[i]) / (SELECT count(*) FROM own) AS m FROM own, range(1, 65) r(i) GROUP BY i),
template AS (SELECT list(m / (SELECT sqrt(sum(m * m)) FROM mean) ORDER BY i) AS t FROM mean)"""


def _enrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "embeddings").filter("label = 0").withColumn("creator", F.lit(0))
    return identity.enroll(chosen, "creator", "embedding")


@query("embedding_enroll", f"WITH {_TEMPLATE} SELECT cast(len(t) AS INT) AS dim, cast((SELECT count(*) FROM own) AS INT) AS sample_count, round(t[1], 6) AS first_value, round(list_sum(list_transform(t, lambda x: x * x)), 6) AS norm FROM template")
def embedding_enroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _enrolled(spark, sf_dir)
    return found.select("dim", "sample_count", F.round(F.col("template")[0], 6).alias("first_value"), F.round(F.pow(identity.magnitude(F.col("template")), 2), 6).alias("norm"))


_DECIDED = f"""{_TEMPLATE}, faces AS (SELECT vec_id, (vec_id % 10) / 10.0 AS q, greatest(-1.0, least(1.0, list_sum(list_transform(list_zip({_UNIT}, t), lambda p: p[1] * p[2])))) AS s FROM embeddings, template),
decided AS (SELECT vec_id, CASE WHEN q < 0.5 THEN 'low_quality' WHEN s >= 0.2::DOUBLE + 0.05::DOUBLE THEN 'creator' WHEN s >= 0.2::DOUBLE - 0.05::DOUBLE THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN q >= 0.5 THEN round(s, 6) END AS similarity FROM faces)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = (F.col("vec_id") % 10) / 10.0
    faces = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", share.alias("confidence"), share.alias("quality"))
    return identity.decide(faces, _enrolled(spark, sf_dir), threshold=0.2, margin=0.05)


@query("identity_decisions", f"WITH {_DECIDED} SELECT vec_id, status, similarity FROM decided")
def identity_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("vec_id", "status", F.round("similarity", 6).alias("similarity"))


@query("bystander_faces", f"WITH {_DECIDED} SELECT status, count(*) AS faces FROM decided WHERE status <> 'creator' GROUP BY status")
def bystander_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.bystanders(_decided(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("faces"))


@query("enrollment_lifecycle", """WITH RECURSIVE ops AS (SELECT stream, seq, CASE WHEN event_id % 4 = 0 THEN 'delete' WHEN event_id % 4 = 1 THEN 'replace' ELSE 'create' END AS op, CASE WHEN event_id % 7 = 0 THEN 'enrollment_rejected' ELSE 'ok' END AS outcome FROM v_frames),
st AS (SELECT stream AS subject, cast(-1 AS BIGINT) AS ord, false AS have, '' AS result FROM (SELECT DISTINCT stream FROM ops) UNION ALL
  SELECT s.subject, o.seq, CASE WHEN op = 'delete' THEN false WHEN op = 'create' AND have THEN true WHEN op = 'replace' AND NOT have THEN false ELSE have OR outcome = 'ok' END,
    CASE WHEN op = 'create' AND have THEN 'conflict' WHEN op = 'replace' AND NOT have THEN 'not_found' WHEN op = 'delete' THEN CASE WHEN have THEN 'ok' ELSE 'enrollment_not_found' END ELSE outcome END
  FROM st s JOIN ops o ON o.stream = s.subject AND o.seq = s.ord + 1)
SELECT subject, ord, CASE WHEN have THEN 'enrolled' ELSE 'not_enrolled' END AS state, result FROM st WHERE ord >= 0""")
def enrollment_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    operations = view(spark, sf_dir, "v_frames").select(F.col("stream").alias("subject"), F.col("seq").alias("ord"), F.when(k % 4 == 0, "delete").when(k % 4 == 1, "replace").otherwise("create").alias("op"), F.when(k % 7 == 0, "enrollment_rejected").otherwise("ok").alias("outcome"))
    return identity.lifecycle(operations)


# --- audio


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream"), (F.row_number().over(order) - 1).alias("pos"), (F.col("l_extendedprice") % 2 - 1).alias("value"))


_SAMPLES = "smp AS (SELECT l_orderkey AS stream, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_extendedprice % 2 - 1 AS value FROM lineitem)"


@query("resample_downmix", f"""WITH {_SAMPLES}, c AS (SELECT stream, list(value ORDER BY pos) AS s FROM smp GROUP BY stream),
m AS (SELECT stream, list_transform(range(len(s) // 2), lambda i: (s[2 * i + 1] + s[2 * i + 2]) / 2) AS s FROM c WHERE len(s) >= 2),
n AS (SELECT stream, s, greatest(1, cast(round_even(len(s) * 16000.0::DOUBLE / 8000, 0) AS BIGINT)) AS k FROM m),
r AS (SELECT stream, k, list_transform(range(k), lambda i: s[cast(floor(least(len(s) - 1.0, i * 8000 / 16000.0)) AS BIGINT) + 1] + (s[least(cast(floor(least(len(s) - 1.0, i * 8000 / 16000.0)) AS BIGINT) + 1, len(s) - 1) + 1] - s[cast(floor(least(len(s) - 1.0, i * 8000 / 16000.0)) AS BIGINT) + 1]) * (least(len(s) - 1.0, i * 8000 / 16000.0) - floor(least(len(s) - 1.0, i * 8000 / 16000.0)))) AS o FROM n)
SELECT stream, cast(len(o) AS BIGINT) AS n_out, round(list_sum(o), 6) AS checksum FROM r""")
def resample_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).groupBy("stream").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("s"))
    mono = rows.filter(F.size("s") >= 2).withColumn("s", audio.downmix(F.col("s"), F.lit(2)))
    out = mono.withColumn("o", audio.resample(F.col("s"), F.lit(8000), 16_000))
    return out.select("stream", F.size("o").cast("long").alias("n_out"), F.round(F.aggregate("o", F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


_CHUNKS = "ch AS (SELECT stream, CASE WHEN seq > 20 AND event_id % 50 = 0 THEN seq + 1 ELSE seq END AS seq, seq * 100 + CASE WHEN event_id % 60 = 0 THEN 3 ELSE 0 END AS start_ms, 44100 AS rate, 4410 AS frames, event_id FROM v_frames)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_frames").selectExpr("stream", "CASE WHEN seq > 20 AND event_id % 50 = 0 THEN seq + 1 ELSE seq END AS seq", "seq * 100 + CASE WHEN event_id % 60 = 0 THEN 3 ELSE 0 END AS start_ms", "cast(44100 AS bigint) AS rate", "cast(4410 AS bigint) AS frames")


@query("audio_timeline_check", f"""WITH {_CHUNKS}, l AS (SELECT stream, seq, start_ms, lag(seq) OVER w AS ps, lag(start_ms) OVER w AS pm FROM ch WINDOW w AS (PARTITION BY stream ORDER BY seq, start_ms))
SELECT stream, CASE WHEN bool_or(coalesce(seq <> ps + 1 OR abs((start_ms - pm) * 44100 - 4410000) > 44100, false)) THEN 'unsafe_timestamp_discontinuity' ELSE 'ok' END AS status FROM l GROUP BY stream""")
def audio_timeline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.timeline(_chunks(spark, sf_dir))


@query("release_watermark", f"WITH {_CHUNKS} SELECT stream, cast(max(start_ms + (frames * 1000 + rate - 1) // rate) AS BIGINT) AS watermark_ms, cast(max(start_ms + (frames * 1000 + rate - 1) // rate) - min(start_ms) AS BIGINT) AS duration_ms FROM ch GROUP BY stream")
def release_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.release(_chunks(spark, sf_dir))


@query("vad_windows", f"""WITH v AS (SELECT stream, seq * 30 AS start_ms, seq * 30 + 30 AS end_ms FROM v_frames WHERE event_id % 7 < 4),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR start_ms - p > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, max(end_ms) OVER (PARTITION BY stream ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v)),
m AS (SELECT stream, min(start_ms) AS a, max(end_ms) AS b FROM i GROUP BY stream, k HAVING max(end_ms) - min(start_ms) >= 120)
SELECT stream, cast(s AS BIGINT) AS start_ms, cast(least(s + 600, b) AS BIGINT) AS end_ms FROM (SELECT stream, b, unnest(range(cast(a AS BIGINT), cast(b AS BIGINT), 600)) AS s FROM m) WHERE least(s + 600, b) - s >= 120""")
def vad_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    voiced = view(spark, sf_dir, "v_frames").filter("event_id % 7 < 4").select("stream", (F.col("seq") * 30).cast("long").alias("start_ms"), (F.col("seq") * 30 + 30).cast("long").alias("end_ms"))
    return audio.voice_windows(voiced, "stream", most_ms=600)


@query("energy_frames", f"""WITH {_SAMPLES} SELECT stream, cast((pos // 2) * 30 AS BIGINT) AS start_ms, cast((pos // 2) * 30 + round_even(count(*) * 30.0::DOUBLE / 2, 0) AS BIGINT) AS end_ms FROM smp GROUP BY stream, pos // 2 HAVING sqrt(avg(value * value)) >= 0.6""")
def energy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.energy_frames(_samples(spark, sf_dir), "stream", frame=2, threshold=0.6)


@query("speech_segments", sequential.SEGMENTS)
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    voiced = c("event_id") % 7 < 3
    rows = view(spark, sf_dir, "v_frames").select("stream", "seq", (c("seq") * 100).alias("start_ms"), (c("seq") * 100 + 100).alias("end_ms"), F.when(voiced, c("seq") * 100 + 10).alias("voice_start"), F.when(voiced, c("seq") * 100 + 90).alias("voice_end"))
    return audio.speech_segments(rows, most_ms=1000)


@query("muted_samples", f"""WITH {_SAMPLES}, iv AS (SELECT o_orderkey AS stream, (o_custkey % 5) * 100 AS start_ms, (o_custkey % 5) * 100 + 1 + o_custkey % 300 AS end_ms FROM orders UNION ALL SELECT o_orderkey, 250, 260 FROM orders WHERE o_custkey % 2 = 0)
SELECT stream, count(*) FILTER (WHERE hit) AS muted, count(*) AS total FROM (SELECT s.stream, EXISTS (SELECT 1 FROM iv WHERE iv.stream = s.stream AND (s.pos + 1) * 1000 > iv.start_ms * 10 AND s.pos * 1000 < iv.end_ms * 10) AS hit FROM smp s) GROUP BY stream""")
def muted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 5 * 100
    spans = orders.select(F.col("o_orderkey").alias("stream"), k.alias("start_ms"), (k + 1 + F.col("o_custkey") % 300).alias("end_ms")).union(orders.filter("o_custkey % 2 = 0").select("o_orderkey", F.lit(250).cast("long"), F.lit(260).cast("long")))
    found = audio.mute(_samples(spark, sf_dir).withColumn("rate", F.lit(10)), spans, "stream")
    return found.groupBy("stream").agg(F.count_if("muted").alias("muted"), F.count("*").alias("total"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "word"))
    return rows.select("doc_id", "pos", "word", (F.col("pos") * 300).cast("long").alias("start_ms"), (F.col("pos") * 300 + 280).cast("long").alias("end_ms"), (0.5 + F.col("pos") % 50 / 100.0).alias("confidence"))


@query("spoken_tokens", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS word FROM documents),
t AS (SELECT doc_id, trim(lower(word), ' ,;:!?') AS t FROM w)
SELECT doc_id, count(*) FILTER (WHERE t <> '') AS tokens, count(*) FILTER (WHERE t IN ('at', 'dot', 'period', 'underscore', 'dash', 'hyphen', 'plus', 'zero', 'oh', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine')) AS replaced,
  md5(string_agg(DISTINCT """ + sequential.SPOKEN_TABLE + """, ' ' ORDER BY """ + sequential.SPOKEN_TABLE + r""") FILTER (WHERE length(t) BETWEEN 1 AND 3)) AS short_md5 FROM t GROUP BY doc_id""")
def spoken_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = _words(spark, sf_dir).withColumn("t", audio.spoken_token(F.col("word"))).withColumn("plain", F.btrim(F.lower("word"), F.lit(audio.EDGE)))
    known = [*audio.DIGITS, *audio.SYMBOLS]
    short = F.md5(F.array_join(F.sort_array(F.collect_set(F.when(F.length("plain").between(1, 3), F.col("t")))), " "))
    return token.groupBy("doc_id").agg(F.count_if(F.col("t") != "").alias("tokens"), F.count_if(F.col("plain").isin(*known)).alias("replaced"), F.when(F.count_if(F.length("plain").between(1, 3)) > 0, short).alias("short_md5"))


@query("spoken_pii_intervals", sequential.spoken_pii(_SPANS.replace("FROM documents", "FROM spoken")))
def spoken_pii_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.spoken_pii(_words(spark, sf_dir), "doc_id")


@query("interval_merge", f"""WITH p AS (SELECT event_id, stream, start_ms - {HOUR} AS a, end_ms + {HOUR} AS b, confidence, detector, reason FROM v_intervals),
i AS (SELECT *, sum(CASE WHEN q IS NULL OR a > q + {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, max(b) OVER (PARTITION BY stream ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM p))
SELECT stream, cast(min(a) AS BIGINT) AS start_ms, cast(max(b) AS BIGINT) AS end_ms, max(confidence) AS confidence, first(detector ORDER BY a, b, event_id) AS detector,
  list_reduce(list(reason ORDER BY a, b, event_id), lambda acc, r: CASE WHEN r = '' OR acc = r THEN acc WHEN acc = '' THEN r ELSE acc || ', ' || r END, '') AS reason, count(*) AS n FROM i GROUP BY stream, k""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(view(spark, sf_dir, "v_intervals"), "stream", padding=HOUR, gap=6 * HOUR)


# --- speech and faces

_SPAN = {"frame_ms": 2 * HOUR, "pre_ms": HOUR, "post_ms": HOUR}


@query("cross_modal_overlap", f"""SELECT f.stream, f.seq, f.ts_ms, count(i.a) AS n_intervals, min(i.confidence) AS min_confidence FROM v_frames f
  LEFT JOIN (SELECT DISTINCT stream, start_ms - {HOUR} AS a, end_ms + {HOUR} AS b, confidence, detector, reason FROM v_intervals) i ON i.stream = f.stream AND i.b > f.ts_ms AND i.a < f.ts_ms + {2 * HOUR} GROUP BY ALL""")
def cross_modal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_modal.overlaps(view(spark, sf_dir, "v_frames"), view(spark, sf_dir, "v_intervals"), bucket=12 * HOUR, **_SPAN)


_FACES = "fc AS (SELECT event_id, list({'score': CASE WHEN (event_id + i) % 3 <> 0 THEN ((7 * event_id + 5 * i) % 10) / 10.0::DOUBLE END, 'confidence': ((event_id + 3 * i) % 10) / 10.0::DOUBLE} ORDER BY i) AS faces FROM v_frames, range(4) r(i) WHERE i < event_id % 4 GROUP BY event_id)"
_XM = f"""{_FACES}, top AS (SELECT f.stream, f.seq, f.ts_ms, coalesce(len(faces), 0) AS n, faces[1].confidence AS c1,
    list_sort(list_filter(faces, lambda x: x.score IS NOT NULL), 'DESC') AS s FROM v_frames f LEFT JOIN fc USING (event_id)),
how AS (SELECT stream, seq, ts_ms, CASE WHEN n = 0 THEN 'unsafe' WHEN n = 1 THEN CASE WHEN c1 >= 0.5 THEN 'mouth' ELSE 'unsafe' END
    WHEN coalesce(len(s) > 0 AND (len(s) = 1 OR s[1].score - s[2].score >= 0.1::DOUBLE) AND s[1].score >= 0.7 AND s[1].confidence >= 0.5, false) THEN 'mouth' ELSE 'face_fallback' END AS how FROM top),
ov AS (SELECT f.stream, f.seq, count(i.a) AS n, min(i.confidence) AS mc FROM v_frames f
  LEFT JOIN (SELECT DISTINCT stream, start_ms - {HOUR} AS a, end_ms + {HOUR} AS b, confidence, detector, reason FROM v_intervals) i ON i.stream = f.stream AND i.b > f.ts_ms AND i.a < f.ts_ms + {2 * HOUR} GROUP BY ALL),
rel AS (SELECT f.stream, f.seq, min(u.end_ms) AS wm FROM v_frames f LEFT JOIN v_intervals u ON u.stream = f.stream AND u.end_ms >= f.ts_ms + {3 * HOUR} GROUP BY ALL),
xm AS (SELECT h.stream, h.seq, CASE WHEN wm IS NULL THEN 'unsafe_audio_incomplete' WHEN ov.n = 0 THEN 'no_sensitive_speech' WHEN how = 'unsafe' THEN 'unsafe_no_face_association' ELSE 'protected' END AS status, how, mc,
  greatest(0, wm - ts_ms) AS delay_ms, greatest(0, wm - ts_ms - {3 * HOUR}) AS lag_ms, wm FROM how h JOIN ov ON ov.stream = h.stream AND ov.seq = h.seq JOIN rel ON rel.stream = h.stream AND rel.seq = h.seq)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    face = lambda i: F.struct(F.when((e + i) % 3 != 0, (7 * e + 5 * i) % 10 / 10.0).alias("score"), ((e + 3 * i) % 10 / 10.0).alias("confidence"))
    faces = F.when(e % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), e % 4 - 1), face))
    spoken = view(spark, sf_dir, "v_intervals")
    updates = spoken.select("stream", F.col("end_ms").alias("watermark_ms"))
    return cross_modal.decide(view(spark, sf_dir, "v_frames").withColumn("faces", faces), spoken, updates, bucket=12 * HOUR, **_SPAN)


@query("cross_modal_decisions", f"""WITH {_XM} SELECT stream, seq, status, CASE status WHEN 'protected' THEN how WHEN 'unsafe_no_face_association' THEN 'unsafe' ELSE 'none' END AS association, CASE WHEN status = 'protected' THEN mc END AS min_confidence,
  CASE WHEN wm IS NULL THEN NULL ELSE delay_ms END AS delay_ms, CASE WHEN wm IS NULL THEN NULL ELSE lag_ms END AS lag_ms FROM xm""")
def cross_modal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decisions(spark, sf_dir)
    none = F.col("status") == "unsafe_audio_incomplete"
    return found.withColumns({c: F.when(~none, F.col(c)) for c in ("delay_ms", "lag_ms")})


@query("cross_modal_metrics", f"""WITH {_XM} SELECT count(*) AS released, count(*) FILTER (WHERE status = 'protected') AS protected, count(*) FILTER (WHERE status = 'no_sensitive_speech') AS silent, count(*) FILTER (WHERE starts_with(status, 'unsafe')) AS unsafe,
  cast(sum(CASE WHEN wm IS NOT NULL THEN delay_ms ELSE 0 END) AS BIGINT) AS total_delay_ms, max(CASE WHEN wm IS NOT NULL THEN delay_ms ELSE 0 END) AS max_delay_ms, max(CASE WHEN wm IS NOT NULL THEN lag_ms ELSE 0 END) AS max_lag_ms FROM xm""")
def cross_modal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_modal.metrics(cross_modal_decisions(spark, sf_dir))


@query("late_intervals", """WITH u AS (SELECT stream, event_id AS ord, start_ms, end_ms, end_ms AS watermark_ms FROM v_intervals),
l AS (SELECT *, max(watermark_ms) OVER (PARTITION BY stream ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM u)
SELECT stream, ord, start_ms, end_ms, previous, coalesce(end_ms <= previous, false) AS late FROM l""")
def late_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = view(spark, sf_dir, "v_intervals").select("stream", F.col("event_id").alias("ord"), "start_ms", "end_ms", F.col("end_ms").alias("watermark_ms"))
    return cross_modal.late(updates).select("stream", "ord", "start_ms", "end_ms", "previous", "late")


@query("cross_modal_buffered", sequential.BUFFERED)
def cross_modal_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "v_frames").selectExpr("event_id", "stream", "ts_ms * 2 AS due", "'frame' AS kind", "seq", "ts_ms", "cast(null AS bigint) AS start_ms", "cast(null AS bigint) AS end_ms", "cast(null AS double) AS confidence", "cast(null AS bigint) AS watermark_ms")
    sound = view(spark, sf_dir, "v_intervals").selectExpr("event_id", "stream", "end_ms * 2 + 1 AS due", "'audio' AS kind", "cast(null AS bigint) AS seq", "cast(null AS bigint) AS ts_ms", "start_ms", "end_ms", "confidence", "end_ms AS watermark_ms")
    total = Window.partitionBy("stream").orderBy("due", "kind", "event_id")
    return cross_modal.synchronise(frames.unionByName(sound).withColumn("ord", F.row_number().over(total)), most=5, most_ms=48 * HOUR, **_SPAN)


# --- the gate

_ISSUES = """iss AS (SELECT w.session, w.seq, p.ord, p.capability, p.required, CASE WHEN p.required THEN 'required_' ELSE 'optional_' END || CASE WHEN o.capability IS NULL THEN 'observation_missing' WHEN o.state <> 'ready' THEN 'state_' || o.state
    WHEN o.watermark_ms IS NULL THEN 'watermark_missing' WHEN o.watermark_ms < w.end_ms THEN 'watermark_pending' WHEN p.max_lag IS NOT NULL AND o.lag_ms IS NULL THEN 'lag_missing' WHEN p.max_lag IS NOT NULL AND o.lag_ms > p.max_lag THEN 'lag_exceeded' END AS issue,
    o.watermark_ms, o.lag_ms FROM v_windows w CROSS JOIN (SELECT * FROM v_policies WHERE enabled) p LEFT JOIN v_obs o ON o.session = w.session AND o.seq = w.seq AND o.capability = p.capability)"""
_GATE = f"""{_ISSUES}, per AS (SELECT session, seq, first(issue ORDER BY ord) FILTER (WHERE required AND issue IS NOT NULL) AS ri, first(issue ORDER BY ord) FILTER (WHERE NOT required AND issue IS NOT NULL) AS oi,
    min(watermark_ms) FILTER (WHERE required) AS watermark_ms, max(lag_ms) FILTER (WHERE required) AS lag_ms FROM iss GROUP BY session, seq),
dec AS (SELECT session, seq, CASE WHEN ri IS NOT NULL THEN 'full_redact' ELSE 'publish' END AS action, CASE WHEN ri IS NOT NULL THEN 'unsafe' WHEN oi IS NOT NULL THEN 'degraded' ELSE 'ready' END AS readiness, coalesce(ri, oi, 'ready') AS reason, watermark_ms, lag_ms FROM per)"""


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.decisions(view(spark, sf_dir, "v_windows"), view(spark, sf_dir, "v_policies"), view(spark, sf_dir, "v_obs"))


@query("gate_issues", f"WITH {_ISSUES} SELECT issue, count(*) AS windows FROM iss WHERE issue IS NOT NULL GROUP BY issue")
def gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.issues(view(spark, sf_dir, "v_windows"), view(spark, sf_dir, "v_policies"), view(spark, sf_dir, "v_obs")).filter("issue is not null").groupBy("issue").agg(F.count("*").alias("windows"))


@query("gate_decisions", f"WITH {_GATE} SELECT * FROM dec")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)


@query("gate_panic", f"""WITH RECURSIVE {_GATE}, cd AS (SELECT d.session, d.seq, action, readiness, reason, panic, leave, alive FROM dec d JOIN v_control c ON c.session = d.session AND c.seq = d.seq),
st AS (
  SELECT session, cast(0 AS BIGINT) AS seq, false AS active, false AS leaving, 0 AS streak, '' AS action, '' AS reason FROM (SELECT DISTINCT session FROM cd) UNION ALL
  SELECT session, seq, CASE WHEN act AND NOT (lv AND alive AND readiness <> 'unsafe' AND sk >= 2) THEN true ELSE false END, CASE WHEN act AND NOT (lv AND alive AND readiness <> 'unsafe' AND sk >= 2) THEN lv ELSE false END,
    CASE WHEN act AND lv AND alive AND readiness <> 'unsafe' AND sk < 2 THEN sk ELSE 0 END,
    CASE WHEN act AND NOT (lv AND alive AND readiness <> 'unsafe' AND sk >= 2) OR NOT alive THEN 'full_redact' ELSE act_now END,
    CASE WHEN act AND lv AND alive AND readiness <> 'unsafe' AND sk < 2 THEN 'panic_recovery_pending' WHEN act AND NOT (lv AND alive AND readiness <> 'unsafe') THEN CASE WHEN lv THEN 'panic_recovery_blocked' ELSE 'panic_active' END WHEN NOT alive THEN 'liveness_lost' ELSE why END
  FROM (SELECT c.session, c.seq, c.action AS act_now, c.readiness, c.reason AS why, c.alive, (s.active OR c.panic) AS act, CASE WHEN c.panic THEN c.leave ELSE s.leaving OR (c.leave AND s.active) END AS lv, CASE WHEN c.panic THEN 0 ELSE s.streak END + 1 AS sk FROM st s JOIN cd c ON c.session = s.session AND c.seq = s.seq + 1))
SELECT session, seq, action, reason, active AS panic_active FROM st WHERE seq > 0""")
def gate_panic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.panic(_gate(spark, sf_dir), view(spark, sf_dir, "v_control"))


@query("window_routing", f"WITH {_GATE} SELECT session, seq, action, CASE action WHEN 'publish' THEN 'protected' WHEN 'full_redact' THEN 'covered' END AS video, CASE action WHEN 'publish' THEN 'protected' WHEN 'full_redact' THEN 'silence' END AS audio FROM dec")
def window_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.route(_gate(spark, sf_dir)).select("session", "seq", "action", "video", "audio")


@query("sink_events", f"WITH {_GATE} SELECT event, count(*) AS events FROM (SELECT unnest(CASE action WHEN 'publish' THEN ['decision', 'video:protected', 'audio:protected'] ELSE ['decision', 'video:covered', 'audio:silence'] END) AS event FROM dec) GROUP BY event")
def sink_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.sink_events(gate.route(_gate(spark, sf_dir))).groupBy("event").agg(F.count("*").alias("events"))


@query("integration_metrics", f"WITH {_GATE} SELECT action, count(*) AS windows, count(*) FILTER (WHERE readiness = 'degraded') AS degraded, count(*) FILTER (WHERE readiness = 'unsafe') AS unsafe, count(DISTINCT session) AS sessions FROM dec GROUP BY action")
def integration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.outcome_metrics(_gate(spark, sf_dir))


# --- streams


@query("stream_event_windows", """SELECT (epoch_us(ts) // 3600000000) * 3600000 AS window_ms, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts as a stream that takes all there is and stops."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = twins.windowed_counts(events).select((F.unix_millis("window_start")).alias("window_ms"), "event_type", "n", F.round("total", 6).alias("total"))
    return twins.drained(counted, "event-windows")


# --- evaluation


@query("latency_percentiles", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
  min(value) AS min_ms, max(value) AS max_ms, round(1000 / avg(value), 6) AS fps FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(table(spark, sf_dir, "events"), "event_type", "value")


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "v_regions").select(F.col("frame").alias("image"), F.col("kind").alias("class"), "ordinal", "line", "supp", "confidence", "x", "y", "w", "h")
    c = F.col
    shift = (c("supp") % 7 - 3) / 100.0
    truth = rows.filter("line <= 4").select("image", "class", "ordinal", c("x").alias("x1"), c("y").alias("y1"), (c("x") + c("w")).alias("x2"), (c("y") + c("h")).alias("y2"))
    found = rows.select("image", "class", "ordinal", c("confidence").alias("score"), (c("x") + shift).alias("x1"), (c("y") + shift).alias("y1"), (c("x") + c("w") + shift).alias("x2"), (c("y") + c("h") + shift).alias("y2"))
    return truth, found


@query("bench_match", sequential.MATCH)
def bench_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.match(*_boxes(spark, sf_dir))


@query("bench_pr", sequential.PR)
def bench_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = _boxes(spark, sf_dir)
    return evaluation.precision_recall(evaluation.match(truth, found), truth)


@query("bench_ap", sequential.AP)
def bench_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = _boxes(spark, sf_dir)
    return evaluation.average_precision(evaluation.match(truth, found, thresholds=evaluation.THRESHOLDS), truth).withColumn("ap", F.round("ap", 9))


@query("bench_map", sequential.MAP)
def bench_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = _boxes(spark, sf_dir)
    ap = evaluation.average_precision(evaluation.match(truth, found, thresholds=evaluation.THRESHOLDS), truth)
    return evaluation.mean_average_precision(ap).select(F.round("map50", 9).alias("map50"), F.round("map", 9).alias("map"))


# --- raster, manifests


def _raster(spark: SparkSession, sf_dir: str, style: str) -> DataFrame:
    c = F.col
    bounds = geometry.pixel_bounds(F.lit(16), F.lit(12))
    names = {"left_px": "left", "top_px": "top", "right_px": "right", "bottom_px": "bottom"}
    box = F.struct(c("ordinal"), *[v.cast("int").alias(names[k]) for k, v in bounds.items()])
    frames = view(spark, sf_dir, "v_regions").groupBy("frame").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    payload = F.unhex(F.repeat(F.sha2(c("frame").cast("string"), 256), 18))
    rows = frames.select("frame", payload.alias("payload"), F.lit(16).alias("width"), F.lit(12).alias("height"), F.lit(3).alias("channels"), "boxes")
    return raster.redact_frames(rows, style).select("frame", "status", F.sha2("payload", 256).alias("payload_sha256"))


for _style in ("cover", "pixelate", "blur"):
    query(f"raster_{_style}", sequential.raster(_style))(lambda spark, sf_dir, style=_style: _raster(spark, sf_dir, style))


@query("manifest_rules", """SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'model_id' WHEN p_partkey % 11 = 0 THEN 'version' WHEN p_partkey % 7 = 0 THEN 'sha256' WHEN p_partkey % 5 = 0 THEN 'archive_suffix' END AS violation FROM part""")
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sha = F.sha2(k.cast("string"), 256)
    manifest = F.struct(
        F.when(k % 13 == 0, "Bad Id").otherwise(F.concat(F.lit("model-"), k)).alias("model_id"), F.when(k % 11 == 0, "../1").otherwise("1.0").alias("version"), F.when(k % 5 == 0, "archive").otherwise("file").alias("type"),
        F.lit("weights.bin").alias("filename"), F.lit("MIT").alias("license"), F.struct(F.lit("https://models.example/x").alias("url"), F.when(k % 7 == 0, F.upper(sha)).otherwise(sha).alias("sha256")).alias("source"),
    )
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.to_json(manifest).alias("json"))
    return manifests.parse(rows, "json").select("id", manifests.violation(F.col("manifest")).alias("violation"))


@query("archive_rules", """WITH m AS (SELECT l_orderkey AS archive, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity AS BIGINT) AS ord, l_partkey, l_suppkey FROM lineitem),
v AS (SELECT archive, ord, CASE WHEN l_partkey % 97 = 0 THEN 'link' WHEN l_suppkey % 89 = 0 THEN 'unsafe_path' WHEN row_number() OVER (PARTITION BY archive, l_partkey % 40 ORDER BY ord) > 1 THEN 'duplicate' END AS wrong FROM m)
SELECT archive, arg_min(wrong, ord) FILTER (WHERE wrong IS NOT NULL) AS violation FROM v GROUP BY archive""")
def archive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    order = c("l_linenumber") * F.lit(1_000_000_000_000) + c("l_partkey") * 1_000_000 + c("l_suppkey") * 100 + c("l_quantity").cast("long")
    path = F.concat(F.lit("member-"), c("l_partkey") % 40)
    members = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("archive"), order.alias("ord"), F.when(c("l_suppkey") % 89 == 0, F.concat(F.lit("../"), path)).otherwise(path).alias("path"), F.lit(1).alias("size"), (c("l_partkey") % 97 == 0).alias("is_link"))
    return manifests.archive_violation(members)
