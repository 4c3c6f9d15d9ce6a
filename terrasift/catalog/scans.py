"""Scans, sinks and incremental table steps."""

from pyspark.sql import functions as F

from terrasift.session import scratch
from terrasift.sources import tables as io
from terrasift.sources.views import oracle, view

Q = QUERIES = {}


def a01(s, d):
    return io.read(s, f"{d}/nation.parquet")


Q["a01_scan_full_table"] = (a01, "SELECT * FROM nation")


def a02(s, d):
    return io.read(s, f"{d}/events.parquet", ["event_id", "user_id", "event_type"])


Q["a02_scan_projection"] = (a02, "SELECT event_id, user_id, event_type FROM events")


def a03(s, d):
    out = scratch(s, "parts")
    ev = view(s, d, "events").select("event_id", "user_id", "value")
    io.write(ev.filter("event_id % 2 = 0").drop("value"), f"{out}/part_a")
    io.write(ev.filter("event_id % 2 = 1"), f"{out}/part_b")
    return io.read_parts(s, f"{out}/part_*")


Q["a03_scan_part_files"] = (a03, "SELECT event_id, user_id, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM events")


def a04(s, d):
    out = scratch(s, "csv")
    io.write_csv(view(s, d, "supplier"), out)
    df = io.read_csv(s, out)
    return df.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 4).alias("total"))


Q["a04_a10_csv_round_trip_typed"] = (a04, "SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n, round(sum(s_acctbal), 4) AS total FROM supplier GROUP BY 1")


def a05(s, d):
    out = scratch(s, "csv")
    io.write_csv(view(s, d, "raw").select("event_id", "n", "k"), out)
    df = io.read_csv(s, out, all_text=True)
    num = df.select(F.col("event_id").try_cast("long").alias("event_id"), *[F.col(c).try_cast("double").alias(c) for c in ("n", "k")])
    return num.agg(F.count("*").alias("rows"), F.count("n").alias("n_ok"), F.count("k").alias("k_ok"), F.sum("event_id").alias("ids"))


Q["a05_csv_all_text_coerced"] = (a05, oracle("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(TRY_CAST(n AS DOUBLE)) AS BIGINT) AS n_ok,
 CAST(count(TRY_CAST(k AS DOUBLE)) AS BIGINT) AS k_ok, CAST(sum(event_id) AS BIGINT) AS ids FROM raw""", "raw"))


def a06(s, d):
    return io.profile(view(s, d, "raw")).select("position", "column", "rows", "nulls")


Q["a06_table_profile"] = (a06, oracle(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM raw"
    for i, c in enumerate(("event_id", "id", "sid", "did", "cycle", "date", "n", "p", "k", "oc", "ph", "ec", "lon", "lat"))), "raw"))


def a07(s, d):
    return io.peek(view(s, d, "events").select("event_id", "event_type", "value"), 5, "event_id")


Q["a07_peek_first_rows"] = (a07, "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5")


def a08(s, d):
    return io.write_verified(view(s, d, "points"), scratch(s, "verified"))


Q["a08_a09_write_verified"] = (a08, oracle("SELECT CAST(count(*) AS BIGINT) AS rows_written, CAST(count(*) AS BIGINT) AS rows_expected, true AS same_schema FROM points", "points"))


def a11(s, d):
    return view(s, d, "supplier").select("s_suppkey", io.to_json("s_suppkey", "s_name", "s_nationkey").alias("item_json"))


Q["a11_json_out"] = (a11, """SELECT s_suppkey, concat('{"s_suppkey":', s_suppkey, ',"s_name":"', s_name, '","s_nationkey":', s_nationkey, '}') AS item_json FROM supplier""")


def a12(s, d):
    ev = view(s, d, "events").withColumn("k", io.json_field("props", "$.k").try_cast("long"))
    return ev.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


Q["a12_json_fields_in"] = (a12, "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(count(json_extract_string(props, '$.k')) AS BIGINT) AS n FROM events GROUP BY 1")


def a13(s, d):
    p = view(s, d, "points")
    return io.funnel_json(p, [("raw", F.lit(True)), ("region_0_2", F.col("region") <= 2), ("plausible", F.col("n") > 200), ("dated", F.col("ts").isNotNull())])


Q["a13_stage_log_record"] = (a13, oracle("""SELECT concat('{"raw":', count(*), ',"region_0_2":', count(*) FILTER (region <= 2), ',"plausible":', count(*) FILTER (region <= 2 AND n > 200),
 ',"dated":', count(*) FILTER (region <= 2 AND n > 200 AND ts IS NOT NULL), '}') AS log FROM points""", "points"))


def a14(s, d):
    store = scratch(s, "store")
    w = view(s, d, "windows").select("id", "scene_id", "status").dropDuplicates(["id", "scene_id"])
    io.append_missing(w.filter("status <> 'ok'"), store, ["id", "scene_id"])
    io.append_missing(w, store, ["id", "scene_id"])
    io.append_missing(w, store, ["id", "scene_id"])  # a rerun adds nothing
    return s.read.parquet(store).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("scene_id").alias("scenes"))


Q["a14_append_missing_keys"] = (a14, oracle("SELECT id, CAST(count(DISTINCT scene_id) AS BIGINT) AS n, CAST(count(DISTINCT scene_id) AS BIGINT) AS scenes FROM windows GROUP BY id", "windows"))


def a15(s, d):
    from terrasift.plans import jobs

    p = view(s, d, "points")
    score = p.groupBy("region").agg(F.round(F.avg("n"), 6).alias("score"))
    todo = jobs.grid(s, model=["mean", "idw"], region=[0, 1, 2, 3, 4]).join(score, "region")
    done = scratch(s, "results")
    io.append_missing(todo.filter("model = 'mean'"), done, ["model", "region"])
    io.append_missing(todo, done, ["model", "region"])
    return s.read.parquet(done)


Q["a15_resume_result_table"] = (a15, oracle("SELECT m.model, p.region, round(avg(n), 6) AS score FROM points p CROSS JOIN (VALUES ('mean'), ('idw')) m(model) GROUP BY 1, 2", "points"))


def a16(s, d):
    w = view(s, d, "windows")
    kept, again = io.requeue_failed(w, w.select("id", "scene_id", "tile").distinct(), ["id", "scene_id"])
    return (kept.groupBy("tile").agg(F.count("*").alias("kept")).join(again.groupBy("tile").agg(F.count("*").alias("again")), "tile", "left").na.fill(0))


Q["a16_requeue_failed"] = (a16, oracle("""SELECT k.tile, kept, coalesce(again, 0) AS again FROM
 (SELECT tile, CAST(count(*) AS BIGINT) AS kept FROM windows WHERE status NOT LIKE 'failed%' GROUP BY 1) k LEFT JOIN
 (SELECT tile, CAST(count(*) AS BIGINT) AS again FROM (SELECT DISTINCT id, scene_id, tile FROM windows) p
  WHERE EXISTS (SELECT 1 FROM windows f WHERE f.id = p.id AND f.scene_id = p.scene_id AND f.status LIKE 'failed%') GROUP BY 1) a ON k.tile = a.tile""", "windows"))


def a17(s, d):
    from terrasift.functions.clean import strict_bare

    w = view(s, d, "windows")
    ranked = w.select("id", "scene_id", "rank").distinct()
    seen = w.filter("rank < 2")
    return io.next_round(ranked, seen, 2, strict_bare())


Q["a17_next_round_work_list"] = (a17, oracle("""SELECT DISTINCT id, scene_id, rank FROM windows p WHERE rank = 2
 AND id NOT IN (SELECT id FROM windows WHERE rank < 2 AND status = 'ok' AND scl_min = 5 AND scl_max = 5 AND n_px = 9)
 AND NOT EXISTS (SELECT 1 FROM windows r WHERE r.rank < 2 AND r.id = p.id AND r.scene_id = p.scene_id)""", "windows"))


def a18(s, d):
    return io.status_counts(view(s, d, "windows"))


Q["a18_status_accounting"] = (a18, oracle("SELECT substr(status, 1, 40) AS status, CAST(count(*) AS BIGINT) AS n FROM windows GROUP BY 1", "windows"))


def a19(s, d):
    out = scratch(s, "grid")
    io.write(view(s, d, "grid"), out)
    px = io.read_pixels(s, out)
    return px.groupBy("tile").agg(F.count("*").alias("cells"), F.max("r").alias("last_row"), F.max("col").alias("last_col"), F.round(F.sum("value"), 4).alias("total"))


Q["a19_pixel_table"] = (a19, oracle("SELECT tile, CAST(count(*) AS BIGINT) AS cells, max(r) AS last_row, max(col) AS last_col, round(sum(value), 4) AS total FROM grid GROUP BY 1", "grid"))
