"""More queries of the catalogue: what stands between the stages, and media windows put together from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import audio, cross_modal, evaluation, gate, geometry, identity, manifests, raster, regions, text_pii, windows
from hushframe.plans import sequential_sql as sequential
from hushframe.plans.catalogue import _SPANS, HOUR, QUERIES, _boxes, _words, query
from hushframe.sources.tables import table, view

_BEFORE = set(QUERIES)
c = F.col

# --- text


@query("text_status", f"""WITH s AS (SELECT doc_id, count(*) AS n, min(start_pos) AS first FROM ({_SPANS}) GROUP BY doc_id),
st AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unavailable' WHEN doc_id % 5 = 0 OR doc_id % 5 = 1 OR length(coalesce(text, '')) = 0 THEN 'error' ELSE 'ok' END AS status FROM documents)
SELECT doc_id, status, CASE WHEN status = 'ok' THEN cast(coalesce(n, 0) + CASE WHEN first = 0 THEN 0 ELSE 1 END AS INT) END AS n_spans FROM st LEFT JOIN s USING (doc_id)""")
def text_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contextual recogniser that finds the first character, fails, answers out of bounds, or isn't there."""
    one = lambda a, b: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("postal_address").alias("category"), F.lit("context").alias("source"), F.lit(0.7).alias("confidence")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    contextual = F.when(c("doc_id") % 5 == 0, F.lit(None)).when(c("doc_id") % 5 == 1, one(0, 1 << 30)).otherwise(one(0, 1))
    found = text_pii.recognise(docs, "text", contextual=contextual, available=c("doc_id") % 7 != 0)
    return found.select("doc_id", "status", F.when(c("status") == "ok", F.size("spans")).alias("n_spans"))


@query("safe_reason_codes", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'lag_' || event_id WHEN event_id % 5 = 0 THEN repeat('a', 64) END AS code FROM events")
def safe_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    raw = F.when(k % 3 == 0, F.concat(F.lit("lag_"), k)).when(k % 5 == 0, F.repeat(F.lit("a"), F.lit(64))).when(k % 7 == 0, F.repeat(F.lit("a"), F.lit(65))).when(k % 2 == 0, "Bad Code").otherwise(F.lit(""))
    return table(spark, sf_dir, "events").select(k, gate.safe_code(raw).alias("code"))


# --- boxes of detectors


def _plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    box = lambda i: F.array(*[(v + 0.0) for v in (k % 300 + 40 * i, k % 200 + 30 * i + 100, k % 300 + 40 * i + 200, k % 200 + 30 * i + 150)])
    names = F.create_map(F.lit(0), F.lit("License_Plate"), F.lit(1), F.lit("car"), F.lit(2), F.lit("plate"))
    return table(spark, sf_dir, "part").select(
        k.alias("frame"), F.array(box(0), box(1), box(2)).alias("boxes"), F.array((k % 10) / 10.0, F.lit(0.9)).alias("conf"), F.when(k % 3 == 0, F.array().cast("array<double>")).otherwise(F.array((k % 3).cast("double"))).alias("cls"),
        names.alias("names"), (640 + 10 * (k % 50)).alias("width"), (360 + 10 * (k % 37)).alias("height"),
    )


_PLATES = """b AS (SELECT p_partkey AS k, i, p_partkey % 300 + 40 * i AS x1, p_partkey % 200 + 30 * i + 100 AS y1, p_partkey % 300 + 40 * i + 200 AS x2, p_partkey % 200 + 30 * i + 150 AS y2, 640 + 10 * (p_partkey % 50) AS w, 360 + 10 * (p_partkey % 37) AS h,
  CASE WHEN i = 0 THEN (p_partkey % 10) / 10.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence, CASE p_partkey % 3 WHEN 0 THEN 'license_plate' WHEN 1 THEN 'car' ELSE 'plate' END AS name FROM part, range(3) g(i)),
s AS (SELECT *, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS scale FROM b WHERE confidence >= 0.45 AND name <> 'car'),
p AS (SELECT *, floor((640 - round_even(w * scale, 0)) / 2) AS px, floor((640 - round_even(h * scale, 0)) / 2) AS py FROM s),
r AS (SELECT *, greatest(0.0, least((x1 - px) / scale, cast(w AS DOUBLE))) AS a1, greatest(0.0, least((y1 - py) / scale, cast(h AS DOUBLE))) AS b1, greatest(0.0, least((x2 - px) / scale, cast(w AS DOUBLE))) AS a2, greatest(0.0, least((y2 - py) / scale, cast(h AS DOUBLE))) AS b2 FROM p),
g AS (SELECT *, greatest(0.0, least(a1 - w * 0.02::DOUBLE, cast(w AS DOUBLE))) AS l, greatest(0.0, least(b1 - h * 0.02::DOUBLE, cast(h AS DOUBLE))) AS t, greatest(0.0, least(a2 + w * 0.02::DOUBLE, cast(w AS DOUBLE))) AS r, greatest(0.0, least(b2 + h * 0.02::DOUBLE, cast(h AS DOUBLE))) AS u FROM r)"""


@query("plate_regions", f"""WITH {_PLATES} SELECT k AS frame, 'license_plate' AS kind, confidence, round(l / w, 9) AS x, round(t / h, 9) AS y, round((r - l) / w, 9) AS w, round((u - t) / h, 9) AS h FROM g WHERE r > l AND u > t""")
def plate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.plate_regions(_plates(spark, sf_dir)).select("frame", "kind", "confidence", *[F.round(v, 9).alias(v) for v in "xywh"])


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's faces: two for each vector, one of them partly outside, with values that aren't finite here and there."""
    k = c("vec_id")
    one = lambda i: F.struct(F.array(*[v.cast("double") for v in (k % 90 - 10 + 50 * i, k % 70 - 5, k % 90 + 20 + 50 * i, k % 70 + 25)]).alias("bbox"), ((k + i) % 10 / 10.0).alias("det_score"), F.when((k + i) % 4 == 0, (k % 7) / 7.0).alias("quality"), F.when((k + i) % 6 == 0, F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.slice(c("embedding").cast("array<double>"), 1, 2)).alias("embedding"))
    return table(spark, sf_dir, "embeddings").select(k, F.lit(100).alias("width"), F.lit(80).alias("height"), F.array(one(0), one(1)).alias("faces"))


_FACES = "f AS (SELECT vec_id, i AS place, vec_id % 90 - 10 + 50 * i AS x1, vec_id % 70 - 5 AS y1, vec_id % 90 + 20 + 50 * i AS x2, vec_id % 70 + 25 AS y2, ((vec_id + i) % 10) / 10.0::DOUBLE AS confidence, CASE WHEN (vec_id + i) % 4 = 0 THEN (vec_id % 7) / 7.0::DOUBLE ELSE ((vec_id + i) % 10) / 10.0::DOUBLE END AS quality, (vec_id + i) % 6 = 0 AS bad FROM embeddings, range(2) g(i))"


@query("face_outputs", f"WITH {_FACES} SELECT vec_id, cast(place AS INT) AS place, cast(x1 AS DOUBLE) AS x1, cast(y2 AS DOUBLE) AS y2, confidence, quality, NOT bad AS embedded FROM f")
def face_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.face_outputs(_faces(spark, sf_dir)).select("vec_id", "place", "x1", "y2", "confidence", "quality", c("embedding").isNotNull().alias("embedded"))


@query("face_regions", f"""WITH {_FACES}, q AS (SELECT *, greatest(0, least(x1, 100)) AS a, greatest(0, least(y1, 80)) AS b, greatest(0, least(x2, 100)) AS c, greatest(0, least(y2, 80)) AS d FROM f)
SELECT vec_id, cast(place AS INT) AS place, 'face_bystander' AS kind, CASE WHEN c > a AND d > b THEN round(a / 100.0::DOUBLE, 9) END AS x, CASE WHEN c > a AND d > b THEN round((d - b) / 80.0::DOUBLE, 9) END AS h, CASE WHEN c > a AND d > b THEN 'ok' ELSE 'error' END AS status FROM q""")
def face_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.face_regions(geometry.face_outputs(_faces(spark, sf_dir))).select("vec_id", "place", "kind", F.round("x", 9).alias("x"), F.round("h", 9).alias("h"), "status")


@query("recogniser_blocks", "SELECT p_partkey AS id, cast(i AS INT) AS place, cast(p_partkey % 50 + i AS DOUBLE) AS x1, cast(p_partkey % 50 + i + 9 AS DOUBLE) AS x2 FROM part, range(2) g(i) WHERE NOT (i = 1 AND p_partkey % 4 = 0) AND NOT (i = 0 AND p_partkey % 9 = 0)")
def recogniser_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    point = lambda x, y: F.array(x.cast("double"), F.lit(float(y)))
    block = lambda i: F.struct(F.array(point(k % 50 + i, 1), point(k % 50 + i + 9, 1), F.when(F.lit(i == 1) & (k % 4 == 0), point(F.lit(float("nan")), 5)).otherwise(point(k % 50 + i + 9, 5))).alias("points"), F.lit("text").alias("text"), F.when(F.lit(i == 0) & (k % 9 == 0), F.lit(float("inf"))).otherwise(F.lit(0.5)).alias("confidence"))
    found = geometry.recogniser_blocks(table(spark, sf_dir, "part").select(k.alias("id"), F.array(block(0), block(1)).alias("out")))
    box = geometry.polygon_box(c("polygon"))
    return found.select("id", "place", box["x1"].alias("x1"), box["x2"].alias("x2"))


@query("all_detector_regions", f"""WITH {_PLATES}, {_FACES} SELECT detector, count(*) AS n, round(sum(x), 6) AS x FROM (
  SELECT 'plate' AS detector, l / w AS x FROM g WHERE r > l AND u > t UNION ALL SELECT 'face', greatest(0, least(x1, 100)) / 100.0::DOUBLE FROM f WHERE least(x2, 100) > greatest(x1, 0) AND least(y2, 80) > greatest(y1, 0)) GROUP BY detector""")
def all_detector_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plates = geometry.plate_regions(_plates(spark, sf_dir)).select("kind", "x")
    faces = geometry.face_regions(geometry.face_outputs(_faces(spark, sf_dir))).filter("status = 'ok'").select("kind", "x")
    return geometry.all_detectors(plate=plates, face=faces).groupBy("detector").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("x"))


@query("dimension_guards", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM part")
def dimension_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    wide = F.when(k % 5 == 0, F.lit(None)).when(k % 3 == 0, 641).otherwise(640)
    return table(spark, sf_dir, "part").select(k.alias("id"), geometry.dimension_status(F.lit(640), F.lit(360), wide, F.lit(360)).alias("status"))


@query("mouth_boxes", f"WITH {_FACES} SELECT vec_id, cast(place AS INT) AS place, round(x1 / 100.0::DOUBLE + 0.3::DOUBLE * 0.15::DOUBLE, 9) AS x, round(y1 / 80.0::DOUBLE + 0.4::DOUBLE * 0.55::DOUBLE, 9) AS y, round(0.3::DOUBLE * 0.70::DOUBLE, 9) AS w, round(0.4::DOUBLE * 0.40::DOUBLE, 9) AS h FROM f")
def mouth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.struct((c("x1") / 100).alias("x"), (c("y1") / 80).alias("y"), F.lit(0.3).alias("w"), F.lit(0.4).alias("h"))
    found = geometry.face_outputs(_faces(spark, sf_dir)).select("vec_id", "place", cross_modal.mouth_box(face).alias("m"))
    return found.select("vec_id", "place", *[F.round(f"m.{v}", 9).alias(v) for v in "xywh"])


# --- enrollment


def _samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("vec_id")
    status = F.when(k % 17 == 0, "unavailable").when(k % 19 == 0, "error").otherwise("ok")
    vector = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.array(F.lit(0.0), F.lit(0.0))).when(k % 29 == 0, F.slice(c("embedding"), 1, 3).cast("array<double>")).otherwise(c("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select((k % 60).alias("subject"), k.alias("sample"), status.alias("status"), (k % 7 % 3).alias("faces"), (k % 10 / 10.0).alias("confidence"), (k % 9 / 9.0).alias("quality"), vector.alias("embedding"), (k % 60 != 3).alias("consent"))


_TRIAGE = """tr AS (SELECT vec_id % 60 AS subject, vec_id AS sample, vec_id % 29 = 0 AS short, vec_id % 60 <> 3 AS consent, CASE WHEN vec_id % 17 = 0 THEN 'detector_unavailable' WHEN vec_id % 19 = 0 THEN 'detector_error' WHEN vec_id % 7 % 3 = 0 THEN 'no_face' WHEN vec_id % 7 % 3 > 1 THEN 'ambiguous_multi_face'
  WHEN vec_id % 10 < 5 THEN 'low_detection_confidence' WHEN vec_id % 9 / 9.0 < 0.5 THEN 'low_quality' WHEN vec_id % 11 = 0 THEN 'embedding_failed' WHEN vec_id % 13 = 0 THEN 'invalid_embedding' END AS reason FROM embeddings),
oc AS (SELECT subject, count(*) AS samples, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(DISTINCT short) FILTER (WHERE reason IS NULL) AS sizes, bool_and(consent) AS consent, list(reason) FILTER (WHERE reason IS NOT NULL) AS reasons FROM tr GROUP BY subject)"""


@query("sample_triage", f"WITH {_TRIAGE} SELECT sample, reason FROM tr")
def sample_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.triage(_samples_of(spark, sf_dir)).select("sample", "reason")


@query("enrollment_outcomes", f"""WITH {_TRIAGE} SELECT subject, samples, accepted, CASE WHEN NOT consent THEN 'consent_missing' WHEN samples > 12 THEN 'too_many_samples' WHEN accepted < 1 OR sizes > 1 THEN 'rejected' ELSE 'enrolled' END AS status,
  cast(len(coalesce(reasons, [])) + CASE WHEN accepted < 1 THEN 1 WHEN consent AND samples <= 12 AND sizes > 1 THEN 1 ELSE 0 END AS INT) AS n_rejections,
  CASE WHEN list_contains(coalesce(reasons, []), 'detector_unavailable') THEN 'detector_unavailable' WHEN list_contains(coalesce(reasons, []), 'detector_error') THEN 'detector_error' ELSE 'enrollment_rejected' END AS reason FROM oc""")
def enrollment_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    triaged = identity.triage(_samples_of(spark, sf_dir))
    templates = identity.enroll(triaged.filter("reason is null"), "subject", "embedding")
    found = identity.with_templates(identity.outcome(triaged, "subject", most=12), templates, "subject")
    reason = identity.reason_code(F.transform("rejections", lambda r: r["reason"]))
    return found.select("subject", "samples", "accepted", "status", F.size("rejections").alias("n_rejections"), reason.alias("reason"))


@query("templates_by_label", """WITH u AS (SELECT label, vec_id, list_transform(cast(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(cast(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings),
m AS (SELECT label, i, sum(u[i]) / count(*) AS m, count(*) AS n FROM u, range(1, 65) r(i) GROUP BY label, i)
SELECT label, cast(any_value(n) AS INT) AS sample_count, round(max(m) FILTER (WHERE i = 1) / sqrt(sum(m * m)), 6) AS first_value FROM m GROUP BY label""")
def templates_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.enroll(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select("label", "sample_count", F.round(c("template")[0], 6).alias("first_value"))


@query("latest_records", "SELECT stream, max(seq) AS seq, arg_max(event_id, seq) AS event_id, min(seq) AS created_at FROM v_frames GROUP BY stream")
def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.latest(view(spark, sf_dir, "v_frames").select("stream", "seq", "event_id"), "stream", "seq").select("stream", "seq", "event_id", "created_at")


@query("identity_readiness", """WITH d AS (SELECT stream, seq, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CASE WHEN event_id % 3 = 0 THEN 'detector_error' ELSE '' END END AS said FROM v_frames),
l AS (SELECT *, nullif(last_value(said IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq), '') AS known FROM d)
SELECT stream, seq, coalesce(known, CASE WHEN event_id % 10 = 0 THEN 'model_unavailable' END, CASE WHEN event_id % 6 = 1 THEN 'enrollment_rejected' END) AS reason,
  coalesce(known, CASE WHEN event_id % 10 = 0 THEN 'm' END, CASE WHEN event_id % 6 = 1 THEN 'e' END) IS NULL AND event_id % 2 = 1 AS ready FROM l""")
def identity_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    frames = view(spark, sf_dir, "v_frames").select("stream", "seq", "event_id", F.when(k % 4 == 0, F.lit(None)).otherwise(k % 3 != 0).alias("ok"), F.when((k % 4 != 0) & (k % 3 == 0), "detector_error").alias("reason"))
    known = identity.reasons_over_time(frames).drop("reason")
    signals = known.withColumns({"model_ready": k % 10 != 0, "enrollment_reason": F.when(k % 6 == 1, "enrollment_rejected"), "enrolled": k % 2 == 1})
    return identity.readiness(signals).select("stream", "seq", "reason", "ready")


@query("face_models", """WITH m AS (SELECT 'm' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'file' ELSE 'archive' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'onnx' ELSE 'insightface-pack' END AS format, 'pack' || p_partkey % 4 AS name FROM part),
s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'm' || (p_partkey + 1) END AS face, CASE WHEN p_partkey % 7 <> 0 THEN 'm' || p_partkey END AS general, CASE WHEN p_partkey % 11 = 0 THEN 'own' END AS own FROM part),
r AS (SELECT s.*, coalesce(face, CASE WHEN g.format = 'insightface-pack' THEN general END) AS resolved FROM s LEFT JOIN m g ON g.id = general),
p AS (SELECT r.*, m.name AS found, CASE WHEN resolved IS NULL THEN NULL WHEN m.id IS NULL THEN 'no_manifest' WHEN m.type <> 'archive' THEN 'not_archive' WHEN m.format <> 'insightface-pack' THEN 'format' END AS problem FROM r LEFT JOIN m ON m.id = resolved)
SELECT k AS id, resolved, problem, CASE WHEN resolved IS NOT NULL AND problem IS NULL THEN coalesce(own, found) ELSE 'buffalo' END AS name FROM p""")
def face_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    name = lambda v: F.concat(F.lit("m"), v)
    parts = table(spark, sf_dir, "part")
    held = parts.select(name(k).alias("model_id"), F.when(k % 5 == 0, "file").otherwise("archive").alias("type"), F.when(k % 3 == 0, "onnx").otherwise("insightface-pack").alias("format"), F.concat(F.lit("pack"), k % 4).alias("model_name"), F.lit("cpu").alias("provider"))
    settings = parts.select(k.alias("id"), F.when(k % 2 == 0, name(k + 1)).otherwise("").alias("face_model_id"), F.when(k % 7 != 0, name(k)).alias("model_id"), F.when(k % 11 == 0, "own").alias("model_name"), F.lit(None).cast("string").alias("providers"), F.lit("buffalo").alias("default_name"), F.lit("gpu").alias("default_provider"))
    return identity.face_model(settings, held).select("id", "resolved", "problem", "name")


# --- frames


@query("release_in_order", "SELECT stream, seq, max(ts_ms + event_id * 7919 % 5000000) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS released_ms FROM v_frames")
def release_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "v_frames").select("stream", "seq", (c("ts_ms") + c("event_id") * 7919 % 5_000_000).alias("done_ms"))
    return regions.release_times(frames, "stream").select("stream", "seq", "released_ms")


@query("queue_metrics", "SELECT stream, max(event_id % 5) AS max_pending, round(sum(greatest(0.0, value - 50)), 6) AS total_wait_ms FROM v_frames GROUP BY stream")
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "v_frames").select("stream", (c("event_id") % 5).alias("pending"), (c("value") - 50).alias("wait_ms"))
    return regions.queue_metrics(frames, "stream").withColumn("total_wait_ms", F.round("total_wait_ms", 6))


@query("registration_rules", """WITH r AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE 'd' || p_partkey % 150 END AS name, p_partkey % 7 AS cadence, p_partkey % 11 AS ttl, p_partkey % 17 AS slots FROM part)
SELECT ord, CASE WHEN trim(name) = '' THEN 'name' WHEN row_number() OVER (PARTITION BY name ORDER BY ord) > 1 THEN 'duplicate' WHEN cadence = 0 THEN 'cadence' WHEN ttl = 0 THEN 'duration' WHEN slots = 0 THEN 'concurrency' END AS problem FROM r""")
def registration_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("ord"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("d"), k % 150)).alias("name"), (k % 7).alias("cadence"), F.lit(100).alias("timeout_ms"), (k % 11).alias("ttl_ms"), (k % 17).alias("concurrency"))
    return regions.registration_problem(rows).select("ord", "problem")


@query("failed_runs", """WITH e AS (SELECT user_id AS stream, CASE event_id % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'timeout' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'invalid' WHEN 4 THEN 'invalid' ELSE 'error' END AS status FROM events)
SELECT stream, cast(count(*) FILTER (WHERE status <> 'success') AS INT) AS failures, cast(count(*) FILTER (WHERE status = 'invalid') AS INT) AS invalid FROM e GROUP BY stream""")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in (None, "timeout", "unavailable", "type", "value", "runtime")])
    runs = table(spark, sf_dir, "events").select(c("user_id").alias("stream"), regions.run_outcome(F.get(kinds, (c("event_id") % 6).cast("int"))).alias("status"))
    found = runs.groupBy("stream").agg(regions.failed_runs(F.collect_list(F.struct("status"))).alias("failed"))
    return found.select("stream", F.size("failed").alias("failures"), F.size(F.filter("failed", lambda r: r["status"] == "invalid")).alias("invalid"))


_RUNS = """rn AS (SELECT supp % 40 AS stream, frame AS seq, frame * 10 AS ts_ms, CASE WHEN line % 2 = 0 THEN 'plate' ELSE 'face' END AS detector, CASE WHEN max(supp) % 5 = 0 THEN 'timeout' ELSE 'success' END AS status FROM v_regions GROUP BY ALL),
rg AS (SELECT supp % 40 AS stream, frame AS seq, CASE WHEN line % 2 = 0 THEN 'plate' ELSE 'face' END AS detector, kind, x, y, w, h, confidence, ordinal, frame * 10 + 3000 AS expires_ms FROM v_regions),
lv AS (SELECT r.stream, r.seq, r.ts_ms, r.detector, last_value(CASE WHEN status = 'success' THEN seq END IGNORE NULLS) OVER (PARTITION BY stream, detector ORDER BY seq) AS from_seq FROM rn r)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "v_regions").withColumns({"stream": c("supp") % 40, "seq": c("frame"), "ts_ms": c("frame") * 10, "detector": F.when(c("line") % 2 == 0, "plate").otherwise("face")})
    runs = rows.groupBy("stream", "seq", "ts_ms", "detector").agg(F.when(F.max("supp") % 5 == 0, "timeout").otherwise("success").alias("status"))
    return runs, rows.select("stream", "seq", "detector", "kind", "x", "y", "w", "h", "confidence", "ordinal", (c("ts_ms") + 3000).alias("expires_ms"))


@query("live_regions", f"WITH {_RUNS} SELECT lv.stream, lv.seq, lv.detector, count(*) AS n, min(lv.from_seq) AS from_seq FROM lv JOIN rg ON rg.stream = lv.stream AND rg.detector = lv.detector AND rg.seq = lv.from_seq WHERE rg.expires_ms > lv.ts_ms GROUP BY ALL")
def live_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.live_regions(*_runs(spark, sf_dir)).groupBy("stream", "seq", "detector").agg(F.count("*").alias("n"), F.min("from_seq").alias("from_seq"))


@query("protected_frames", f"""WITH {_RUNS}, al AS (SELECT lv.stream, lv.seq, rg.* EXCLUDE (stream, seq, expires_ms), lv.from_seq FROM lv JOIN rg ON rg.stream = lv.stream AND rg.detector = lv.detector AND rg.seq = lv.from_seq WHERE rg.expires_ms > lv.ts_ms),
items AS (SELECT stream, seq, list(struct_pack(kind := kind, x := x, y := y, w := w, h := h, done := cast([] AS STRUCT(kind VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[])) ORDER BY kind, confidence DESC, detector, from_seq, ordinal) AS l FROM al GROUP BY ALL),
folded AS (SELECT stream, seq, len(list_reduce(l, lambda acc, r: struct_pack(kind := '', x := 0.0::DOUBLE, y := 0.0::DOUBLE, w := 0.0::DOUBLE, h := 0.0::DOUBLE, done :=
    CASE WHEN len(list_filter(acc.done, lambda o: o.kind = r.kind AND least(o.x + o.w, r.x + r.w) > greatest(o.x, r.x) AND least(o.y + o.h, r.y + r.h) > greatest(o.y, r.y))) = 0 THEN list_append(acc.done, struct_pack(kind := r.kind, x := r.x, y := r.y, w := r.w, h := r.h))
    ELSE list_transform(acc.done, lambda o, k: CASE WHEN k = list_position(list_transform(acc.done, lambda q: q.kind = r.kind AND least(q.x + q.w, r.x + r.w) > greatest(q.x, r.x) AND least(q.y + q.h, r.y + r.h) > greatest(q.y, r.y)), true)
      THEN struct_pack(kind := o.kind, x := least(o.x, r.x), y := least(o.y, r.y), w := greatest(o.x + o.w, r.x + r.w) - least(o.x, r.x), h := greatest(o.y + o.h, r.y + r.h) - least(o.y, r.y)) ELSE o END) END),
    struct_pack(kind := '', x := 0.0::DOUBLE, y := 0.0::DOUBLE, w := 0.0::DOUBLE, h := 0.0::DOUBLE, done := cast([] AS STRUCT(kind VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]))).done) AS n FROM items),
fl AS (SELECT stream, seq, count(*) FILTER (WHERE status = 'timeout') AS failures FROM rn GROUP BY ALL)
SELECT stream, seq, coalesce(n, 0) AS n_regions, failures, CASE WHEN coalesce(n, 0) > 2 THEN 'error' WHEN seq % 9 = 0 THEN 'no_payload' ELSE 'rendered' END AS render_status FROM fl LEFT JOIN folded USING (stream, seq)""")
def protected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, found = _runs(spark, sf_dir)
    frames = runs.select("stream", "seq", (c("seq") % 9 != 0).alias("has_payload")).distinct()
    return regions.protected_frames(frames, runs, found, most=2)


@query("raster_full_cover", "SELECT frame, CASE WHEN frame % 10 = 0 THEN 'no_payload' WHEN frame % 10 = 1 THEN 'error' ELSE 'ok' END AS status, CASE WHEN frame % 10 > 1 THEN sha256(unhex(repeat('00', 576))) END AS payload_sha256 FROM (SELECT DISTINCT frame FROM v_regions)")
def raster_full_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "v_regions").select("frame").distinct()
    payload = F.when(c("frame") % 10 == 0, F.lit(None)).when(c("frame") % 10 == 1, F.unhex(F.lit("0011"))).otherwise(F.unhex(F.repeat(F.lit("7f"), 576)))
    boxes = F.array().cast("array<struct<left:int,top:int,right:int,bottom:int>>")
    rows = frames.select("frame", payload.alias("payload"), F.lit(16).alias("width"), F.lit(12).alias("height"), F.lit(3).alias("channels"), boxes.alias("boxes"), F.lit(True).alias("full_frame"))
    return raster.redact_frames(rows, "blur").select("frame", "status", F.sha2("payload", 256).alias("payload_sha256"))


@query("raster_colours", "SELECT frame, n AS channels, sha256(unhex(repeat(CASE n WHEN 1 THEN '3c' WHEN 3 THEN '0a50' || '5a' ELSE '0a50' || '5aff' END, 4))) AS payload_sha256 FROM (SELECT DISTINCT frame FROM v_regions), (SELECT unnest([1, 3, 4]) AS n)")
def raster_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover's colour in grey, three and four channels: one pixel each way more than the box is none, so the box is the frame."""
    frames = view(spark, sf_dir, "v_regions").select("frame", F.explode(F.array(F.lit(1), F.lit(3), F.lit(4))).alias("channels")).distinct()
    box = F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(2).alias("right"), F.lit(2).alias("bottom")))
    rows = frames.select("frame", F.unhex(F.repeat(F.lit("11"), 4 * c("channels"))).alias("payload"), F.lit(2).alias("width"), F.lit(2).alias("height"), "channels", box.alias("boxes"))
    return raster.redact_frames(rows, "cover", colour=(10, 80, 90)).select("frame", "channels", F.sha2("payload", 256).alias("payload_sha256"))


# --- audio


@query("audio_chunks", """SELECT p_partkey AS id, cast(i AS BIGINT) AS seq, cast(1000 + round_even(i * k * 1000.0::DOUBLE / 100, 0) AS BIGINT) AS start_ms, cast(least(k, n - i * k) AS INT) AS n FROM (
  SELECT p_partkey, 1 + p_partkey % 40 AS n, 3 AS k FROM part), range(14) g(i) WHERE i * k < n""")
def audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    segments = table(spark, sf_dir, "part").select(k.alias("id"), F.lit(1000).cast("long").alias("start_ms"), F.lit(100).alias("rate"), F.transform(F.sequence(F.lit(0).cast("long"), k % 40), lambda x: x / 100.0).alias("samples"))
    return audio.chunks(segments, "id").select("id", "seq", "start_ms", F.size("samples").alias("n"))


@query("segment_chunk", "SELECT p_partkey AS id, cast(0 AS BIGINT) AS seq, cast(7 AS BIGINT) AS start_ms, cast(p_partkey % 40 AS INT) AS n FROM part WHERE p_partkey % 40 > 0")
def segment_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey") % 40
    samples = F.when(k == 0, F.array().cast("array<double>")).otherwise(F.array_repeat(F.lit(0.5), k.cast("int")))
    return audio.one_chunk(table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.lit(7).cast("long").alias("start_ms"), samples.alias("samples")), "id").select("id", "seq", "start_ms", F.size("samples").alias("n"))


@query("pcm_decoded", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round((p_partkey % 32768 // 256 * 256 + p_partkey % 256) / 32768.0::DOUBLE, 9) END AS first, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 2 END AS n FROM part")
def pcm_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey") % 32_768
    two = F.concat(F.lpad(F.hex(k % 256), 2, "0"), F.lpad(F.hex(F.floor(k / 256)), 2, "0"))
    raw = F.unhex(F.when(c("p_partkey") % 5 == 0, F.concat(two, F.lit("00"))).otherwise(F.concat(two, F.lit("0080"))))
    found = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), audio.decode_pcm(raw, "pcm16").alias("s"))
    return found.select("id", F.round(F.get("s", F.lit(0)), 9).alias("first"), F.when(c("s").isNotNull(), F.size("s")).alias("n"))


@query("segmenter_input", """WITH ch AS (SELECT stream, seq AS place, CASE WHEN event_id % 50 = 0 THEN seq - 1 ELSE seq END AS seq, seq * 100 - CASE WHEN event_id % 60 = 0 THEN 3 ELSE 0 END AS start_ms, CASE WHEN event_id % 70 = 0 THEN 2 ELSE 1 END AS channels FROM v_frames)
SELECT stream, place, CASE WHEN channels <> 1 THEN 'not_mono_float32' WHEN seq <= lag(seq) OVER w THEN 'sequence' WHEN start_ms < lag(start_ms) OVER w + 100 THEN 'overlap' END AS problem FROM ch WINDOW w AS (PARTITION BY stream ORDER BY place)""")
def segmenter_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    rows = view(spark, sf_dir, "v_frames").select("stream", c("seq").alias("place"), F.when(k % 50 == 0, c("seq") - 1).otherwise(c("seq")).alias("seq"), (c("seq") * 100 - F.when(k % 60 == 0, 3).otherwise(0)).alias("start_ms"), F.lit(16_000).alias("rate"), F.lit(1600).alias("frames"), F.when(k % 70 == 0, 2).otherwise(1).alias("channels"), F.lit("float32").alias("form"))
    return audio.segmenter_input(rows).select("stream", "place", "problem")


@query("ring_sizes", "SELECT a.stream, a.seq, cast(greatest(1, count(b.seq)) AS INT) AS ring_size FROM v_frames a LEFT JOIN v_frames b ON b.stream = a.stream AND b.seq <= a.seq AND (a.seq * 100 + 100 + a.event_id % 5) - b.seq * 100 <= 1000 GROUP BY ALL")
def ring_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_frames").select("stream", "seq", (c("seq") * 100).alias("start_ms"), (c("seq") * 100 + 100 + c("event_id") % 5).alias("end_ms"))
    return audio.ring(rows).select("stream", "seq", "ring_size")


@query("joined_chunks", """WITH k AS (SELECT stream, seq // 4 AS part, seq, event_id FROM v_frames)
SELECT stream * 1000000 + part AS stream, min(seq) * 100 AS start_ms, max(seq) * 100 + 20 AS end_ms, CASE WHEN count(DISTINCT event_id % 40 = 0) = 1 THEN 'ok' ELSE 'format_mismatch' END AS status, CASE WHEN count(DISTINCT event_id % 40 = 0) = 1 THEN cast(2 * count(*) AS INT) END AS n FROM k GROUP BY stream, part""")
def joined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(c("seq") / 4)
    rows = view(spark, sf_dir, "v_frames").select((c("stream") * 1_000_000 + k).alias("stream"), "seq", (c("seq") * 100).alias("start_ms"), F.lit(100).alias("rate"), F.when(c("event_id") % 40 == 0, 2).otherwise(1).alias("channels"), F.lit("float32").alias("form"), F.array(F.lit(0.1), F.lit(0.2)).alias("samples"))
    return audio.join_chunks(rows).select("stream", "start_ms", "end_ms", "status", F.when(c("samples").isNotNull(), F.size("samples")).alias("n"))


@query("silent_fallback", "SELECT p_partkey AS id, cast(p_partkey % 9 AS INT) AS n, 0.0::DOUBLE AS loudest, repeat('00', p_partkey % 9) AS bytes FROM part")
def silent_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (c("p_partkey") % 9).cast("int")
    made = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), audio.silence(F.array_repeat(F.lit(0.7), n)).alias("s"), audio.silence_bytes(F.unhex(F.repeat(F.lit("7f"), n))).alias("b"))
    return made.select("id", F.size("s").alias("n"), F.aggregate("s", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))).alias("loudest"), F.lower(F.hex("b")).alias("bytes"))


@query("transcript_texts", r"SELECT doc_id, md5(string_agg(w, ' ' ORDER BY pos)) AS text_md5 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS w, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS pos FROM documents) GROUP BY doc_id")
def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.transcript_text(_words(spark, sf_dir), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("model_windows", """WITH f AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 8000 WHEN 1 THEN 16000 ELSE 44100 END AS rate, p_partkey * 37 % 100000 AS a, p_partkey * 37 % 100000 + p_partkey % 900000 AS b FROM part),
w AS (SELECT id, rate, 500 + cast(round_even(a * 1000.0::DOUBLE / rate, 0) AS BIGINT) AS a, least(60000, 500 + cast(round_even(b * 1000.0::DOUBLE / rate, 0) AS BIGINT)) AS b FROM f)
SELECT id, s AS start_ms, least(s + 15000, b) AS end_ms, 'ok' AS status FROM (SELECT id, b, unnest(range(a, b, 15000)) AS s FROM w WHERE rate <> 44100 AND b > a) UNION ALL SELECT id, NULL, NULL, 'rate' FROM w WHERE rate = 44100""")
def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.lit(500).cast("long").alias("segment_ms"), F.lit(60_000).cast("long").alias("segment_end_ms"), F.when(k % 3 == 0, 8000).when(k % 3 == 1, 16_000).otherwise(44_100).alias("rate"), (k * 37 % 100_000).alias("from_sample"), (k * 37 % 100_000 + k % 900_000).alias("to_sample"))
    return audio.model_windows(rows, "id")


_SPOKEN = sequential.spoken_pii(_SPANS.replace("FROM documents", "FROM spoken"))


@query("spoken_policy", f"""WITH found AS ({_SPOKEN}),
sg AS (SELECT doc_id, doc_id % 11 = 0 AS empty, CASE WHEN doc_id % 13 = 0 THEN 120001 ELSE 120000 END AS fin, doc_id % 5 <> 0 AS voiced FROM documents),
ok AS (SELECT f.doc_id, greatest(start_ms - 250, 0) AS a, least(end_ms + 250, 120000) AS b, f.confidence FROM found f JOIN sg USING (doc_id) WHERE NOT empty AND fin = 120000 AND voiced),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ok WHERE b > a)),
n AS (SELECT doc_id, count(DISTINCT k) AS intervals, sum(DISTINCT 0) AS zero FROM i GROUP BY doc_id), covered AS (SELECT doc_id, cast(sum(b - a) AS BIGINT) AS covered_ms FROM (SELECT doc_id, k, min(a) AS a, max(b) AS b FROM i GROUP BY doc_id, k) GROUP BY doc_id)
SELECT doc_id, CASE WHEN empty THEN 'no_samples' WHEN fin > 120000 THEN 'too_long' WHEN NOT voiced THEN 'no_voice' ELSE 'ok' END AS status, coalesce(intervals, 0) AS intervals, coalesce(covered_ms, 0) AS covered_ms FROM sg LEFT JOIN n USING (doc_id) LEFT JOIN covered USING (doc_id)""")
def spoken_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("doc_id")
    docs = table(spark, sf_dir, "documents")
    segments = docs.select(k, F.lit(0).cast("long").alias("start_ms"), F.when(k % 13 == 0, 120_001).otherwise(120_000).cast("long").alias("end_ms"), F.when(k % 11 == 0, 0).otherwise(1).alias("n_samples"))
    status, found = audio.detect_spoken(segments, docs.filter(k % 5 != 0).select(k), _words(spark, sf_dir), "doc_id")
    sums = found.groupBy("doc_id").agg(F.count("*").alias("intervals"), F.sum(c("end_ms") - c("start_ms")).alias("covered_ms"))
    return status.join(sums, "doc_id", "left").na.fill(0, ["intervals", "covered_ms"])


@query("timeline_words", """WITH w AS (SELECT stream, seq, event_id, seq * 1000 AS a, seq * 1000 + 900 AS b FROM v_frames),
o AS (SELECT stream, seq, 0 AS pos, greatest(a, a + event_id % 700 - 100) AS s, least(b, a + event_id % 1300) AS e, event_id % 6 = 0 AS blank FROM w UNION ALL SELECT stream, seq, 1, greatest(a, a + 500), least(b, a + 400 + event_id % 1000), false FROM w WHERE event_id % 3 = 0),
k AS (SELECT * FROM o WHERE e > s AND NOT blank)
SELECT stream, seq AS "window", cast(pos AS BIGINT) AS pos, s AS start_ms, e AS end_ms, 'word' AS word FROM k UNION ALL SELECT stream, seq, 0, a, b, 'whole' FROM w WHERE event_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.stream = w.stream AND k.seq = w.seq)""")
def timeline_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    rows = view(spark, sf_dir, "v_frames").withColumnRenamed("seq", "window")
    spans = rows.select("stream", "window", (c("window") * 1000).alias("start_ms"), (c("window") * 1000 + 900).alias("end_ms"), F.when(k % 4 == 0, " ").otherwise("whole").alias("text"), F.lit(0.5).alias("confidence"))
    first = rows.select("stream", "window", F.lit(0).alias("pos"), F.when(k % 6 == 0, "  ").otherwise("word").alias("word"), (k % 700 - 100).alias("from_ms"), (k % 1300).alias("to_ms"), F.lit(0.9).alias("confidence"))
    second = rows.filter(k % 3 == 0).select("stream", "window", F.lit(1), F.lit("word"), F.lit(500).cast("long"), (400 + k % 1000), F.lit(0.9))
    return audio.timeline_words(spans, first.union(second), "stream").select("stream", "window", "pos", "start_ms", "end_ms", "word")


@query("classified_segments", f"SELECT a.stream, a.event_id AS segment, count(f.event_id) AS n_words, CASE WHEN count(f.event_id) > 0 THEN 'ok' ELSE 'unsafe_unclassified' END AS status FROM v_intervals a LEFT JOIN v_frames f ON f.stream = a.stream AND f.event_id % 3 = 0 AND f.ts_ms + {HOUR} > a.start_ms AND f.ts_ms < a.start_ms + {4 * HOUR} GROUP BY ALL")
def classified_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = view(spark, sf_dir, "v_intervals").select("stream", c("event_id").alias("segment"), "start_ms", (c("start_ms") + 4 * HOUR).alias("end_ms"))
    said = view(spark, sf_dir, "v_frames").filter("event_id % 3 = 0").select("stream", c("ts_ms").alias("from_ms"), (c("ts_ms") + HOUR).alias("to_ms"))
    return audio.classified_segments(segments, said, "stream", bucket=12 * HOUR).select("stream", "segment", "n_words", "status")


@query("segment_queue", f"SELECT stream, CASE WHEN count(*) > 8 OR sum(end_ms - start_ms) > {1_500_000} THEN 'unsafe_overflow' ELSE 'ok' END AS status FROM v_intervals GROUP BY stream")
def segment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.queue_status(view(spark, sf_dir, "v_intervals"), most=8, most_ms=1_500_000)


def _calls(k: str = "event_id") -> list:
    k = c(k)
    return [
        F.when(k % 23 == 0, 0).otherwise(5).alias("chunks"), F.when(k % 19 == 0, "unsafe_timestamp_discontinuity").otherwise("ok").alias("timeline"), F.when(k % 17 == 0, "overlap").alias("input_problem"), F.when(k % 13 == 0, "failed").otherwise("ok").alias("vad"),
        (k % 7).alias("segments"), (k % 11 * 3500).alias("duration_ms"), (k % 9 != 0).alias("deadline_met"), (k % 10 == 0).alias("unclassified"), F.when(k % 14 == 1, "failed").otherwise("ok").alias("transcription"), F.when(k % 15 == 2, "failed").otherwise("ok").alias("muted"),
    ]


def _outcome_sql(k: str) -> str:
    return f"""CASE WHEN {k} % 23 = 0 THEN 'no_speech' WHEN {k} % 19 = 0 THEN 'unsafe_timestamp_discontinuity' WHEN {k} % 17 = 0 THEN 'unsafe_input' WHEN {k} % 13 = 0 THEN 'unsafe_vad_failure' WHEN {k} % 7 = 0 THEN 'no_speech' WHEN {k} % 7 > 4 OR {k} % 11 * 3500 > 30000 THEN 'unsafe_queue_overflow'
  WHEN {k} % 9 = 0 THEN 'unsafe_deadline' WHEN {k} % 10 = 0 THEN 'unsafe_unclassified' WHEN {k} % 14 = 1 THEN 'unsafe_transcription_failure' WHEN {k} % 15 = 2 THEN 'unsafe_input' ELSE 'ok' END"""


@query("audio_outcomes", f"SELECT event_id, status, status IN ('ok', 'no_speech') AND event_id % 23 <> 0 AS safe FROM (SELECT event_id, {_outcome_sql('event_id')} AS status FROM events)")
def audio_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.outcome(table(spark, sf_dir, "events").select("event_id", *_calls())).select("event_id", "status", "safe")


# --- speech and faces, the gate


def _spoken_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    face = lambda i: F.struct(((k + 2 * i) % 5 / 10.0).alias("x"), ((k + i) % 4 / 10.0).alias("y"), F.lit(0.2).alias("w"), F.lit(0.25).alias("h"), ((7 * k + 5 * i) % 10 / 10.0).alias("score"))
    how = F.when(k % 3 == 0, "mouth").otherwise("face_fallback")
    return view(spark, sf_dir, "v_frames").select("stream", "seq", "ts_ms", F.when(k % 5 == 0, "no_sensitive_speech").otherwise("protected").alias("status"), how.alias("association"), (k % 10 / 10.0).alias("min_confidence"), F.array(face(0), face(1)).alias("faces"))


@query("spoken_regions", """WITH f AS (SELECT stream, seq, ts_ms, event_id AS k, i, (event_id + 2 * i) % 5 / 10.0::DOUBLE AS x, (event_id + i) % 4 / 10.0::DOUBLE AS y, (7 * event_id + 5 * i) % 10 AS score FROM v_frames, range(2) g(i) WHERE event_id % 5 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS nth FROM f)
SELECT stream, seq, cast(CASE WHEN k % 3 = 0 THEN 0 ELSE i END AS INT) AS place, 'spoken_pii' AS kind, round(CASE WHEN k % 3 = 0 THEN x + 0.2::DOUBLE * 0.15::DOUBLE ELSE x END, 9) AS x, round(CASE WHEN k % 3 = 0 THEN y + 0.25::DOUBLE * 0.55::DOUBLE ELSE y END, 9) AS y,
  round(CASE WHEN k % 3 = 0 THEN 0.2::DOUBLE * 0.7::DOUBLE ELSE 0.2 END, 9) AS w, k % 10 / 10.0::DOUBLE AS confidence, ts_ms + 33 AS expires_ms FROM b WHERE k % 3 <> 0 OR nth = 1""")
def spoken_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_modal.spoken_regions(_spoken_decisions(spark, sf_dir), frame_ms=33)
    return found.select("stream", "seq", "place", "kind", *[F.round(v, 9).alias(v) for v in "xyw"], "confidence", "expires_ms")


@query("face_filter", "SELECT kind, count(*) AS n FROM v_regions WHERE kind = 'face' GROUP BY kind")
def face_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_modal.faces_of(view(spark, sf_dir, "v_regions")).groupBy("kind").agg(F.count("*").alias("n"))


_DECIDED = "d AS (SELECT stream, seq // 3 AS batch, seq, CASE event_id % 5 WHEN 0 THEN 'unsafe_no_face_association' WHEN 1 THEN 'no_sensitive_speech' ELSE 'protected' END AS status FROM v_frames WHERE event_id % 4 <> 0)"


@query("update_statuses", f"""WITH {_DECIDED}, u AS (SELECT stream, seq // 3 AS batch, max(CASE WHEN event_id % 37 = 0 THEN 'unsafe_timestamp_discontinuity' END) AS reason, count(*) FILTER (WHERE event_id % 11 = 0) AS n_late FROM v_frames GROUP BY ALL),
r AS (SELECT u.stream, u.batch, coalesce(u.reason, CASE WHEN n_late > 0 THEN 'unsafe_late_audio' END, first(d.status ORDER BY d.seq) FILTER (WHERE starts_with(d.status, 'unsafe'))) AS reason, count(d.seq) AS n FROM u LEFT JOIN d ON d.stream = u.stream AND d.batch = u.batch GROUP BY u.stream, u.batch, u.reason, n_late)
SELECT stream, batch, reason, CASE WHEN reason IS NOT NULL THEN 'unsafe' WHEN n > 0 THEN 'released' ELSE 'pending' END AS status FROM r""")
def update_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    frames = view(spark, sf_dir, "v_frames").withColumn("batch", F.floor(c("seq") / 3))
    status = F.when(k % 5 == 0, "unsafe_no_face_association").when(k % 5 == 1, "no_sensitive_speech").otherwise("protected")
    decisions = frames.filter(k % 4 != 0).select("stream", "batch", "seq", status.alias("status"))
    updates = frames.groupBy("stream", "batch").agg(F.max(F.when(k % 37 == 0, "unsafe_timestamp_discontinuity")).alias("reason"), F.count_if(k % 11 == 0).alias("n_late"))
    return cross_modal.update_status(updates, decisions, ["stream", "batch"]).select("stream", "batch", "reason", "status")


@query("gate_invalid", """WITH o AS (SELECT session, seq, capability FROM v_obs UNION ALL SELECT session, seq, 'thermal' FROM v_windows WHERE orderkey % 41 = 0 UNION ALL SELECT session, seq, 'video' FROM v_windows WHERE orderkey % 43 = 0),
bad AS (SELECT DISTINCT session, seq FROM (SELECT session, seq, capability, count(*) AS n FROM o GROUP BY ALL) WHERE n > 1 OR capability NOT IN (SELECT capability FROM v_policies))
SELECT w.session, w.seq, b.session IS NOT NULL AS invalid FROM v_windows w LEFT JOIN bad b ON b.session = w.session AND b.seq = w.seq""")
def gate_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown and repeated capabilities block a window, whatever else was observed."""
    held = view(spark, sf_dir, "v_windows")
    own = lambda name: (F.lit(name).alias("capability"), F.lit("ready").alias("state"), c("end_ms").cast("long").alias("watermark_ms"), F.lit(0).cast("long").alias("lag_ms"))
    seen = view(spark, sf_dir, "v_obs").select("session", "seq", "capability", "state", "watermark_ms", "lag_ms")
    seen = seen.unionByName(held.filter("orderkey % 41 = 0").select("session", "seq", *own("thermal"))).unionByName(held.filter("orderkey % 43 = 0").select("session", "seq", *own("video")))
    decided = gate.decisions(held, view(spark, sf_dir, "v_policies"), seen)
    return decided.select("session", "seq", (c("reason") == "invalid_observation").alias("invalid"))


@query("liveness_states", "SELECT session, seq, coalesce(last_value(CASE WHEN orderkey % 3 = 0 THEN NULL ELSE orderkey % 5 <> 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq), true) AS alive FROM v_windows")
def liveness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = view(spark, sf_dir, "v_windows").select("session", "seq", F.when(c("orderkey") % 3 == 0, F.lit(None)).otherwise(c("orderkey") % 5 != 0).alias("alive"))
    return gate.liveness(signals)


@query("session_snapshots", "WITH l AS (SELECT session, max(seq) AS seq FROM v_obs GROUP BY session) SELECT session, seq, cast(count(*) AS INT) AS n, string_agg(capability || ':' || state, ',' ORDER BY capability) AS states FROM v_obs JOIN l USING (session, seq) GROUP BY session, seq")
def session_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.snapshot(view(spark, sf_dir, "v_obs"))
    return found.select("session", "seq", F.size("capabilities").alias("n"), F.array_join(F.transform("capabilities", lambda x: F.concat(x["capability"], F.lit(":"), x["state"])), ",").alias("states"))


# --- media windows

_STATES = f"""mw AS (SELECT session, seq, orderkey AS k, start_ms AS ts_ms, end_ms, orderkey % 21 <> 0 AS there, CASE WHEN orderkey % 8 = 0 THEN 1 ELSE 0 END AS failures, CASE orderkey % 12 WHEN 1 THEN 'error' WHEN 2 THEN 'no_payload' ELSE 'rendered' END AS render,
  CASE WHEN orderkey % 29 = 0 THEN NULL ELSE {_outcome_sql('orderkey')} END AS audio, CASE WHEN orderkey % 23 <> 0 THEN end_ms + orderkey % 3 END AS awm, CASE WHEN orderkey % 2 = 0 THEN orderkey % 90 END AS alag, CASE WHEN orderkey % 31 = 0 THEN 'unsafe_late_audio' END AS sync FROM v_windows),
dc AS (SELECT session, seq, CASE orderkey % 6 WHEN 0 THEN 'unsafe_audio_incomplete' WHEN 1 THEN 'no_sensitive_speech' ELSE 'protected' END AS status, CASE WHEN orderkey % 12 = 0 THEN 'unsafe_audio_incomplete' END AS reason, end_ms AS wm, orderkey % 100 AS lag FROM v_windows WHERE orderkey % 9 <> 0),
ag AS (SELECT mw.*, audio IN ('ok', 'no_speech') AND awm IS NOT NULL AS safe, dc.session IS NOT NULL AS known, dc.status AS ds, dc.reason AS dr, wm AS dwm, lag AS dlag FROM mw LEFT JOIN dc ON dc.session = mw.session AND dc.seq = mw.seq),
xm AS (SELECT *, CASE WHEN NOT coalesce(safe, false) OR sync IS NOT NULL THEN 'failed' WHEN NOT known THEN 'processing' WHEN ds IN ('protected', 'no_sensitive_speech') THEN 'ready' ELSE 'failed' END AS xs,
  CASE WHEN NOT coalesce(safe, false) THEN 'cross_modal_audio_unavailable' WHEN sync IS NOT NULL THEN sync WHEN NOT known THEN 'cross_modal_pending' WHEN ds NOT IN ('protected', 'no_sensitive_speech') THEN coalesce(dr, 'cross_modal_unsafe') END AS xr,
  CASE WHEN coalesce(safe, false) AND sync IS NULL THEN CASE WHEN known THEN dwm ELSE awm END END AS xwm, CASE WHEN coalesce(safe, false) AND sync IS NULL AND known THEN dlag END AS xlag,
  CASE WHEN NOT there THEN 'video_processor_failure' WHEN failures > 0 THEN 'video_detector_failure' WHEN render <> 'rendered' THEN 'video_render_failure' ELSE 'ready' END AS vs FROM ag)"""


def _media(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = c("orderkey")
    held = view(spark, sf_dir, "v_windows").withColumn("k", k)
    judged = audio.outcome(held.select("session", "seq", *_calls("orderkey"))).select("session", "seq", c("status").alias("audio_status"))
    media = held.join(judged, ["session", "seq"]).select(
        "session", "seq", c("start_ms").alias("ts_ms"), c("end_ms"), (k % 21 != 0).alias("video_there"), F.when(k % 8 == 0, 1).otherwise(0).alias("failures"), F.when(k % 12 == 1, "error").when(k % 12 == 2, "no_payload").otherwise("rendered").alias("render_status"),
        F.when(k % 29 != 0, c("audio_status")).alias("audio_status"), F.when(k % 23 != 0, c("end_ms") + k % 3).alias("audio_watermark_ms"), F.when(k % 2 == 0, k % 90).alias("audio_lag_ms"), F.when(k % 31 == 0, "unsafe_late_audio").alias("sync_reason"),
    )
    own = held.filter(k % 9 != 0)
    status = F.when(k % 6 == 0, "unsafe_audio_incomplete").when(k % 6 == 1, "no_sensitive_speech").otherwise("protected")
    last = own.select("session", c("start_ms").alias("ts_ms"), F.lit(1).alias("ord"), status.alias("status"), F.when(k % 12 == 0, "unsafe_audio_incomplete").alias("reason"), c("end_ms").cast("long").alias("watermark_ms"), (k % 100).alias("lag_ms"))
    earlier = own.select("session", c("start_ms").alias("ts_ms"), F.lit(0).alias("ord"), F.lit("unsafe_buffer_overflow").alias("status"), F.lit("x").alias("reason"), F.lit(0).cast("long").alias("watermark_ms"), F.lit(0).cast("long").alias("lag_ms"))
    return media, last.unionByName(earlier)


@query("augmentations", f"WITH {_STATES} SELECT session, seq, xs AS status, xr AS reason, xwm AS watermark_ms, xlag AS lag_ms FROM xm")
def augmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.augmentation(*_media(spark, sf_dir))
    return found.select("session", "seq", c("xm_status").alias("status"), c("xm_reason").alias("reason"), c("xm_watermark_ms").alias("watermark_ms"), c("xm_lag_ms").alias("lag_ms"))


@query("protected_video", f"WITH {_STATES} SELECT vs AS status, count(*) AS windows FROM xm GROUP BY vs")
def protected_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, _ = _media(spark, sf_dir)
    return media.groupBy(windows.video_status(c("video_there"), c("failures"), c("render_status")).alias("status")).agg(F.count("*").alias("windows"))


_OBSERVED = f"""{_STATES}, ob AS (
  SELECT session, seq, 'video' AS capability, CASE WHEN vs = 'ready' THEN 'ready' ELSE 'failed' END AS state, CASE WHEN vs = 'ready' THEN end_ms END AS watermark_ms, CASE WHEN vs = 'ready' THEN 0 END AS lag_ms, nullif(vs, 'ready') AS reason FROM xm UNION ALL
  SELECT session, seq, 'spoken_pii', CASE WHEN coalesce(safe, false) THEN 'ready' ELSE 'failed' END, CASE WHEN coalesce(safe, false) THEN awm END, CASE WHEN coalesce(safe, false) THEN coalesce(alag, 0) END, CASE WHEN NOT coalesce(safe, false) THEN coalesce(audio, 'audio_processor_failure') END FROM xm UNION ALL
  SELECT session, seq, 'cross_modal', xs, xwm, CASE WHEN xs = 'ready' THEN coalesce(xlag, 0) ELSE xlag END, CASE WHEN xs <> 'ready' THEN coalesce(xr, 'cross_modal_unavailable') END FROM xm)"""


@query("window_observations", f"WITH {_OBSERVED} SELECT * FROM ob")
def window_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.observations(windows.augmentation(*_media(spark, sf_dir)))


@query("media_windows", f"""WITH {_OBSERVED}, pl AS (SELECT * FROM (VALUES (1, 'video', true, cast(NULL AS BIGINT)), (2, 'spoken_pii', true, 50), (3, 'cross_modal', false, 80)) p(ord, capability, required, max_lag)),
iss AS (SELECT ob.session, ob.seq, pl.ord, required, CASE WHEN required THEN 'required_' ELSE 'optional_' END || CASE WHEN state <> 'ready' THEN 'state_' || state WHEN ob.watermark_ms IS NULL THEN 'watermark_missing' WHEN ob.watermark_ms < mw.end_ms THEN 'watermark_pending' WHEN max_lag IS NOT NULL AND lag_ms IS NULL THEN 'lag_missing' WHEN max_lag IS NOT NULL AND lag_ms > max_lag THEN 'lag_exceeded' END AS issue
  FROM ob JOIN pl USING (capability) JOIN mw ON mw.session = ob.session AND mw.seq = ob.seq),
per AS (SELECT session, seq, first(issue ORDER BY ord) FILTER (WHERE required AND issue IS NOT NULL) AS ri, first(issue ORDER BY ord) FILTER (WHERE NOT required AND issue IS NOT NULL) AS oi FROM iss GROUP BY session, seq)
SELECT session, seq, CASE WHEN ri IS NOT NULL THEN 'full_redact' ELSE 'publish' END AS action, CASE WHEN ri IS NOT NULL THEN 'unsafe' WHEN oi IS NOT NULL THEN 'degraded' ELSE 'ready' END AS readiness, coalesce(ri, oi, 'ready') AS reason,
  CASE WHEN ri IS NOT NULL THEN 'covered' ELSE 'protected' END AS video, CASE WHEN ri IS NOT NULL THEN 'silence' ELSE 'protected' END AS audio, vs AS video_status, coalesce(xm.audio, 'unsafe_input') AS audio_status, xs AS cross_modal_status FROM per JOIN xm USING (session, seq)""")
def media_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video, audio and speech-and-faces of each window, the gate's decision, and what goes out."""
    return windows.process(*_media(spark, sf_dir), view(spark, sf_dir, "v_policies").filter("capability <> 'ocr'"))


@query("console_readiness", """SELECT session, bool_or(required AND enabled AND state <> 'ready') AS required_unavailable, bool_or(NOT required AND enabled AND state <> 'ready') AS optional_unavailable,
  session % 4 <> 0 AND NOT bool_or(required AND enabled AND state <> 'ready') AND session % 3 <> 0 AS can_start FROM v_obs JOIN v_policies USING (capability) GROUP BY session""")
def console_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_obs").join(view(spark, sf_dir, "v_policies").select("capability", "required", "enabled"), "capability")
    k = c("session")
    return windows.can_start(rows.withColumns({"permission": F.when(k % 4 == 0, "denied").otherwise("granted"), "safety": F.when(k % 3 == 0, "panic").when(k % 3 == 1, "normal").otherwise("degraded")}), "session")


# --- reports and manifests


@query("box_rules", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not_finite' WHEN event_id % 5 = 0 THEN 'negative' WHEN event_id % 3 = 0 THEN 'no_area' WHEN event_id % 2 = 0 THEN 'score_range' END AS problem FROM events""")
def box_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    x1, x2 = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 5 == 0, F.lit(-1.0)).otherwise(F.lit(2.0)), F.when(k % 3 == 0, F.lit(2.0)).otherwise(F.lit(3.0))
    return table(spark, sf_dir, "events").select(k, evaluation.box_problem(x1, F.lit(0.0), x2, F.lit(1.0), F.when(k % 2 == 0, F.lit(1.5)).otherwise(F.lit(1.0))).alias("problem"))


@query("performance_summary", """SELECT user_id AS run, count(value) AS samples, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(1000 / avg(value), 6) AS inference_fps,
  CASE WHEN user_id % 3 <> 0 THEN round(count(*) / (user_id % 3 * 2.5::DOUBLE), 6) END AS video_fps, count(value) FILTER (WHERE event_type = 'error') AS lags, round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS lag_mean, round(quantile_cont(value, 0.95) FILTER (WHERE event_type = 'error'), 6) AS lag_p95 FROM events GROUP BY user_id""")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(c("user_id").alias("run"), c("value").alias("latency_ms"), F.when(c("event_type") == "error", c("value")).alias("decision_lag_ms"))
    clips = rows.groupBy("run").agg(F.count("*").alias("frame_count"), F.first(F.when(c("run") % 3 != 0, c("run") % 3 * 2.5)).alias("duration_seconds"))
    return evaluation.performance(rows, clips, "run")


@query("report_provenance", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'commit' WHEN p_partkey % 5 = 0 THEN 'hardware' WHEN p_partkey % 7 = 0 THEN 'model_checksums' END AS problem FROM part")
def report_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    sha = F.sha2(k.cast("string"), 256)
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 == 0, " ").otherwise("abc").alias("commit"), F.lit("m").alias("model"), F.lit("d").alias("dataset"), F.lit("p").alias("profile"), F.when(k % 5 == 0, F.lit(None)).otherwise("cpu").alias("hardware"), F.array(sha, F.when(k % 7 == 0, F.upper(sha)).otherwise(sha)).alias("model_checksums"))
    return evaluation.provenance_problem(rows).select("id", "problem")


@query("manifest_checksums", "SELECT 'm' || p_partkey AS model_id, CASE WHEN p_partkey % 6 = 0 THEN 'missing' WHEN p_partkey % 4 = 0 THEN 'checksum_mismatch' ELSE 'verified' END AS status FROM part")
def manifest_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    parts, name = table(spark, sf_dir, "part"), F.concat(F.lit("f"), c("p_partkey"))
    files = parts.filter(k % 6 != 0).select(name.alias("filename"), F.when(k % 4 == 0, F.encode(F.lit("corrupt"), "utf-8")).otherwise(F.encode(c("p_name"), "utf-8")).alias("content"))
    return manifests.verify(parts.select(F.concat(F.lit("m"), k).alias("model_id"), name.alias("filename"), F.sha2("p_name", 256).alias("sha256")), files)


@query("manifest_round_trip", "SELECT p_partkey AS id, true AS same FROM part")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.to_json(F.struct(F.concat(F.lit("model-"), k).alias("model_id"), F.lit("1").alias("version"), F.lit("file").alias("type"), F.struct(F.lit("u").alias("url"), F.sha2(k.cast("string"), 256).alias("sha256")).alias("source"))).alias("json"))
    first = manifests.parse(rows, "json").withColumn("again", manifests.serialise(c("manifest")))
    second = manifests.parse(first.select("id", c("manifest").alias("before"), "again"), "again")
    return second.select("id", c("before").eqNullSafe(c("manifest")).alias("same"))


@query("region_rules", """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'kind' WHEN event_id % 11 = 0 THEN 'timestamp' WHEN event_id % 7 = 0 THEN 'confidence' WHEN event_id % 5 = 0 THEN 'interval' WHEN event_id % 3 = 0 THEN 'no_area' WHEN event_id % 2 = 0 THEN 'outside_frame' END AS problem FROM events""")
def region_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    kind = F.when(k % 13 == 0, F.lit(None)).otherwise("face")
    x = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 2 == 0, F.lit(0.9)).otherwise(F.lit(0.1))
    w = F.when(k % 3 == 0, F.lit(0.0)).otherwise(F.lit(0.2))
    problem = geometry.region_problem(x, F.lit(0.0), w, F.lit(0.5), F.when(k % 7 == 0, F.lit(1.5)).otherwise(F.lit(0.5)), F.when(k % 11 == 0, -1).otherwise(0), kind)
    return table(spark, sf_dir, "events").select(k, problem.alias("problem"))


@query("solid_pixels", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '3c' WHEN 1 THEN '0a505a' ELSE '0a505aff' END AS pixel, cast(12 * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS INT) AS n FROM part")
def solid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    n = F.when(k % 3 == 0, 1).when(k % 3 == 1, 3).otherwise(4)
    rows = table(spark, sf_dir, "part").select(k.alias("id"), n.alias("n"), raster.solid(F.lit(4), F.lit(3), n, (10, 80, 90)).alias("payload"))
    return rows.select("id", F.lower(F.hex(raster.pixel(c("payload"), c("id") % 4, c("id") % 3, F.lit(4), c("n")))).alias("pixel"), F.octet_length("payload").alias("n"))


@query("letterbox_images", """WITH fr AS (SELECT frame, sha256(cast(frame AS VARCHAR)) AS h FROM (SELECT DISTINCT frame FROM v_regions)),
px AS (SELECT frame, h, i, i // 8 AS y, i % 8 AS x FROM fr, range(64) g(i))
SELECT frame, sha256(unhex(string_agg(CASE WHEN y BETWEEN 1 AND 6 THEN substr(h, cast(2 * (((y - 1) * 2 * 16 + x * 2) % 32) AS INT) + 1, 2) ELSE '72' END, '' ORDER BY i))) AS input_sha256 FROM px GROUP BY frame""")
def letterbox_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.unhex(F.repeat(F.sha2(c("frame").cast("string"), 256), 6))
    frames = view(spark, sf_dir, "v_regions").select("frame").distinct().select("frame", payload.alias("payload"), F.lit(16).alias("width"), F.lit(12).alias("height"), F.lit(1).alias("channels"))
    return raster.letterbox_frames(frames, 8).select("frame", F.sha2("model_input", 256).alias("input_sha256"))


@query("normalised_chunks", """WITH s AS (SELECT stream, seq, event_id, [event_id % 10 / 10.0::DOUBLE, event_id % 7 / 10.0::DOUBLE, event_id % 3 / 10.0::DOUBLE, event_id % 9 / 10.0::DOUBLE] AS s FROM v_frames),
m AS (SELECT stream, seq, (s[1] + s[2]) / 2 AS a, (s[3] + s[4]) / 2 AS b FROM s)
SELECT stream, seq, 4 AS n, round(a, 9) AS first, round(a + (b - a) * 0.5, 9) AS second, round(b, 9) AS last FROM m""")
def normalised_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    samples = F.array(k % 10 / 10.0, k % 7 / 10.0, k % 3 / 10.0, k % 9 / 10.0)
    rows = view(spark, sf_dir, "v_frames").select("stream", "seq", F.lit(8000).alias("rate"), F.lit(2).alias("channels"), samples.alias("samples"))
    out = audio.normalise_chunk(rows)
    return out.select("stream", "seq", F.size("samples").alias("n"), F.round(c("samples")[0], 9).alias("first"), F.round(c("samples")[1], 9).alias("second"), F.round(F.element_at("samples", -1), 9).alias("last"))


@query("face_detector_reasons", """WITH d AS (SELECT stream, seq, CASE WHEN event_id % 9 = 0 THEN 'detector_error' WHEN event_id % 4 = 1 THEN 'detector_unavailable' WHEN event_id % 4 = 2 THEN 'detector_error' END AS reason FROM v_frames)
SELECT stream, seq, reason IS NULL AS ok, reason AS detector_reason FROM d""")
def face_detector_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id")
    calls = view(spark, sf_dir, "v_frames").select("stream", "seq", (k % 9 != 0).alias("has_image"), F.when(k % 4 == 1, "unavailable").when(k % 4 == 2, "value").alias("raised"))
    return identity.detector_outcomes(calls).select("stream", "seq", "ok", "detector_reason")


#: The queries of this module.
NAMES = tuple(n for n in QUERIES if n not in _BEFORE)
