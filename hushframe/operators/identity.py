"""Face embeddings: normalisation, similarity, enrollment and identity decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.folds import ordered_fold


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; null if it is empty, not finite or shorter than 1e-12."""
    own = v.cast("array<double>")
    bad = F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(own) > 0) & ~bad & (magnitude(own) > 1e-12), F.transform(own, lambda x: x / magnitude(own)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, within -1 to 1; null if their sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def enroll(samples: DataFrame, key: str, embedding: str) -> DataFrame:
    """(key, dim, sample_count, template): the mean of each key's unit vectors at length 1; null for vectors of several sizes.

    Vectors are summed place by place, map side first, so a key may have any number of them.
    """
    own = samples.select(F.col(key), unit(F.col(embedding)).alias("__unit")).filter("__unit is not null")
    each = own.select(key, F.size("__unit").alias("dim"), F.posexplode("__unit").alias("place", "x"))
    sums = each.groupBy(key, "place").agg(F.sum("x").alias("x"), F.count("*").alias("n"), F.min("dim").alias("least"), F.max("dim").alias("most"))
    whole = sums.groupBy(key).agg(F.max("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sort_array(F.collect_list(F.struct("place", "x"))).alias("sums"))
    same = F.col("least") == F.col("most")
    mean = F.transform("sums", lambda s: s["x"] / F.col("n"))
    return whole.select(key, F.when(same, F.col("most")).alias("dim"), F.col("n").cast("int").alias("sample_count"), F.when(same, unit(mean)).alias("template"))


def triage(samples: DataFrame, *, least_confidence: float = 0.5, least_quality: float = 0.5) -> DataFrame:
    """samples (status, faces, confidence, quality, embedding) with reason, the first that applies; null: the sample is good."""
    c = F.col
    reason = (
        F.when(c("status") == "unavailable", "detector_unavailable").when(c("status") == "error", "detector_error").when(c("faces") == 0, "no_face").when(c("faces") > 1, "ambiguous_multi_face")
        .when(c("confidence") < least_confidence, "low_detection_confidence").when(c("quality") < least_quality, "low_quality")
        .when(c("embedding").isNull(), "embedding_failed").when(unit(c("embedding")).isNull(), "invalid_embedding")
    )
    return samples.withColumn("reason", reason)


def outcome(triaged: DataFrame, key: str, *, most: int = 8, least_valid: int = 1) -> DataFrame:
    """(key, samples, accepted, rejections, status): of triaged samples (sample, reason, consent)."""
    rejected = F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(F.col("sample").alias("index"), F.col("reason")))))
    grouped = triaged.groupBy(key).agg(F.count("*").alias("samples"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.bool_and("consent").alias("consent"), rejected.alias("rejections"))
    few = F.col("accepted") < least_valid
    extra = F.array(F.struct(F.lit(-1).cast("long").alias("index"), F.lit("insufficient_valid_samples").alias("reason"))).cast("array<struct<index:bigint,reason:string>>")
    rows = F.col("rejections").cast("array<struct<index:bigint,reason:string>>")
    status = F.when(~F.col("consent"), "consent_missing").when(F.col("samples") > most, "too_many_samples").when(few, "rejected").otherwise("enrolled")
    return grouped.select(key, "samples", "accepted", F.when(few, F.concat(rows, extra)).otherwise(rows).alias("rejections"), status.alias("status"))


def decide(faces: DataFrame, template: DataFrame, *, threshold: float = 0.55, margin: float = 0.05, least_confidence: float = 0.5, least_quality: float = 0.5) -> DataFrame:
    """faces (confidence, quality, embedding) with similarity and status against a table of at most one row (template)."""
    one = F.broadcast(template.select(F.col("template").alias("__template")).limit(1))  # a single row
    own = faces.join(one, F.lit(True), "left").withColumn("__unit", unit(F.col("embedding")))
    similarity = cosine(F.col("__unit"), F.col("__template"))
    c = F.col
    status = (
        F.when(c("__template").isNull(), "no_enrollment").when((c("confidence") < least_confidence) | (c("quality") < least_quality), "low_quality").when(c("__unit").isNull(), "embedding_failed")
        .when(similarity.isNull(), "unknown").when(similarity >= threshold + margin, "creator").when(similarity >= threshold - margin, "ambiguous").otherwise("unknown")
    )
    shown = F.when(~status.isin("no_enrollment", "low_quality", "embedding_failed"), similarity)
    return own.withColumns({"similarity": shown, "status": status}).drop("__template", "__unit")


def bystanders(decided: DataFrame) -> DataFrame:
    """Every face but those that are certainly the creator's."""
    return decided.filter("status <> 'creator'")


def latest(records: DataFrame, key: str, at: str) -> DataFrame:
    """The last record of each key by time, with the first one's time as created_at."""
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), at).alias("r"), F.min(at).alias("created_at")).select(key, "r.*", "created_at")


def readiness(signals: DataFrame) -> DataFrame:
    """signals (detector_reason, model_ready, enrollment_reason, enrolled) with reason, the first that applies, and ready."""
    reason = F.coalesce("detector_reason", F.when(~F.col("model_ready"), "model_unavailable"), "enrollment_reason")
    return signals.withColumns({"reason": reason, "ready": reason.isNull() & F.col("enrolled")})


def lifecycle(operations: DataFrame) -> DataFrame:
    """(subject, ord, state, result): operations (create, replace, delete; outcome ok or a failure) on each subject in order."""

    def step(state: dict, row) -> list[tuple]:
        have, result = state["record"], "ok"
        if row.op == "create" and have:
            result = "conflict"
        elif row.op == "replace" and not have:
            result = "not_found"
        elif row.op == "delete":
            result, state["record"] = ("ok", False) if have else ("enrollment_not_found", False)
        elif row.outcome == "ok":
            state["record"] = True
        else:
            result = row.outcome
        return [(row.subject, row.ord, "enrolled" if state["record"] else "not_enrolled", result)]

    return ordered_fold(operations, ["subject"], ["ord"], lambda: {"record": False}, step, "subject long, ord long, state string, result string")


def reasons_over_time(outcomes: DataFrame) -> DataFrame:
    """outcomes (stream, seq, ok, reason) with the detector's last known reason; a success clears it."""
    order = Window.partitionBy("stream").orderBy("seq")
    return outcomes.withColumn("detector_reason", F.nullif(F.last(F.when(F.col("ok"), "").otherwise(F.col("reason")), ignorenulls=True).over(order), F.lit("")))


def reason_code(rejections: Column) -> Column:
    """The one reason that stands for an enrollment's rejections (an array of names)."""
    return F.when(F.array_contains(rejections, "detector_unavailable"), "detector_unavailable").when(F.array_contains(rejections, "detector_error"), "detector_error").otherwise("enrollment_rejected")


def with_templates(outcomes: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """outcomes after their accepted embeddings were put together (enroll): a template that can't be made (vectors of several sizes, or
    that cancel out) is a rejection incompatible_embeddings, number -1, and not an enrollment."""
    both = outcomes.join(templates.select(key, F.col("template").alias("__t")), key, "left")
    bad = (F.col("status") == "enrolled") & F.col("__t").isNull()
    extra = F.array(F.struct(F.lit(-1).cast("long").alias("index"), F.lit("incompatible_embeddings").alias("reason"))).cast("array<struct<index:bigint,reason:string>>")
    return both.withColumns({"rejections": F.when(bad, F.concat("rejections", extra)).otherwise(F.col("rejections")), "status": F.when(bad, "rejected").otherwise(F.col("status"))}).drop("__t")


def face_model(settings: DataFrame, manifests: DataFrame) -> DataFrame:
    """settings (face_model_id, model_id, model_name, providers, default_name, default_provider) with the resolved model and problem.

    The id meant for faces comes first; a general one counts only if its manifest (model_id, type, format, model_name, provider)
    is for faces. The manifest must be an archive of that format. Settings' own names and providers win over the manifest's.
    """
    c = F.col
    own = manifests.select(c("model_id").alias("__id"), c("type").alias("__type"), c("format").alias("__format"), c("model_name").alias("__name"), c("provider").alias("__provider"))
    general = own.filter(c("__format") == "insightface-pack").select(c("__id").alias("model_id"), F.lit(True).alias("__faces"))
    chosen = F.coalesce(F.nullif("face_model_id", F.lit("")), F.when(c("__faces"), c("model_id")))
    found = settings.join(general, "model_id", "left").withColumn("resolved", chosen).join(own, c("resolved") == c("__id"), "left")
    problem = F.when(c("resolved").isNull(), None).when(c("__id").isNull(), "no_manifest").when(c("__type") != "archive", "not_archive").when(F.coalesce(c("__format") != "insightface-pack", F.lit(True)), "format")
    name = F.coalesce(F.nullif("model_name", F.lit("")), "__name", "default_name")
    provider = F.coalesce("providers", "__provider", "default_provider")
    fits = c("resolved").isNotNull() & problem.isNull()
    out = {"problem": problem, "name": F.when(fits, name).otherwise(c("default_name")), "provider": F.when(fits, provider).otherwise(c("default_provider"))}
    return found.withColumns(out).drop("__faces", "__id", "__type", "__format", "__name", "__provider")


def detector_outcomes(calls: DataFrame, *, tracker: bool = True) -> DataFrame:
    """calls (stream, seq, has_image, raised) of the face detector with ok, reason and detector_reason, its last known one: a frame without an
    image and a call that raised are errors, an unavailable model is its own reason. Faces are only looked for with a tracker."""
    if not tracker:
        raise ValueError("face detection needs a tracker")
    reason = F.when(~F.col("has_image"), "detector_error").when(F.col("raised") == "unavailable", "detector_unavailable").when(F.col("raised").isNotNull(), "detector_error")
    return reasons_over_time(calls.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()))
