"""Input tables, and the views over them that stand for frames, intervals, regions, windows and observations.

The views are SQL text in a dialect that both engines read after a few replacements, so that a query and its check see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Replacements that turn the Spark text of a view into the other engine's.
OTHER_DIALECT = ((" div ", " // "), ("unix_micros(cast(ts as timestamp))", "epoch_us(ts)"), ("bround(", "round_even("))

MS = "(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 1000"

VIEWS = {
    "v_frames": f"SELECT event_id, user_id AS stream, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) - 1 AS seq, {MS} AS ts_ms, event_type, value FROM events",
    "v_intervals": f"""SELECT event_id, user_id AS stream, {MS} AS start_ms, {MS} + cast(floor(value * 1000) AS bigint) + 1 AS end_ms, least(1.0, value / 500) AS confidence,
      CASE WHEN event_id % 2 = 0 THEN 'asr' ELSE 'rules' END AS detector, CASE event_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone_number' ELSE '' END AS reason FROM events WHERE event_type = 'error'""",
    "v_runs": """SELECT event_id, user_id AS stream, event_type AS detector, value AS duration_ms,
      CASE event_id % 6 WHEN 0 THEN 'skipped' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'error' WHEN 3 THEN 'invalid' ELSE 'called' END AS outcome FROM events""",
    "v_regions": """SELECT l_orderkey AS frame, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS bigint) AS ordinal,
      l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'email' WHEN 'N' THEN 'face' ELSE 'phone_number' END AS kind, (l_partkey % 70) / 100.0D AS x, (l_suppkey % 70) / 100.0D AS y,
      (10 + cast(floor(l_quantity) AS bigint) % 20) / 100.0D AS w, (5 + 3 * l_linenumber) / 100.0D AS h, 1 - l_discount AS confidence, l_suppkey AS supp FROM lineitem""",
    "v_windows": """SELECT o_custkey AS session, o_orderkey AS orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS seq,
      33 * (cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) - 1) AS start_ms, 33 * cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS end_ms FROM orders""",
    "v_policies": "SELECT * FROM (VALUES (1, 'video', true, true, cast(NULL AS bigint)), (2, 'spoken_pii', true, true, 50), (3, 'cross_modal', false, true, 80), (4, 'ocr', false, false, cast(NULL AS bigint))) AS p(ord, capability, required, enabled, max_lag)",
    "v_obs": """SELECT session, seq, capability,
      CASE (orderkey + 3 * ord) % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'processing' ELSE 'ready' END AS state,
      CASE WHEN (orderkey + ord) % 17 <> 0 THEN end_ms - (CASE WHEN (orderkey * ord) % 19 = 0 THEN 1 ELSE 0 END) END AS watermark_ms,
      CASE WHEN (orderkey + ord) % 23 <> 0 THEN (orderkey * ord) % 100 END AS lag_ms
      FROM v_windows CROSS JOIN v_policies WHERE (orderkey + ord) % 11 <> 0""",
    "v_control": "SELECT session, seq, orderkey % 29 = 0 AS panic, orderkey % 31 = 0 AS leave, orderkey % 37 <> 0 AS alive FROM v_windows",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(sql: str) -> set[str]:
    return set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)) - {"VALUES"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a plan over the input tables."""
    sql = VIEWS[name]
    for source in _sources(sql):
        sql = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", sql)
    return spark.sql(sql, **{s: view(spark, sf_dir, s) if s in VIEWS else table(spark, sf_dir, s) for s in _sources(VIEWS[name])})


def with_views(sql: str) -> str:
    """SQL for the other engine with the views that it names put before it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(VIEWS[name])
                needed.append(name)

    add(sql)
    texts = []
    for name in needed:
        text = VIEWS[name].replace("100.0D", "100.0::DOUBLE")
        for ours, theirs in OTHER_DIALECT:
            text = text.replace(ours, theirs)
        texts.append(f"{name} AS ({text})")
    head = ", ".join(texts)
    body = sql.strip()
    if not head:
        return body
    return f"WITH RECURSIVE {head}, {body[5:].removeprefix('RECURSIVE ')}" if body[:5] == "WITH " else f"WITH {head} {body}"
