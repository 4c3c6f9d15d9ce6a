"""Sample-analytics views derived from the driver tables.

Each view is one SQL text that Spark and DuckDB both understand: coordinates and values come from integer
arithmetic on keys, so both engines agree to the last bit. ``{table}`` marks a base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
BANDS = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"]

_BAND_SQL = ",\n  ".join(
    f"CAST(1000 + (l_orderkey*31 + l_partkey*17 + l_linenumber*13 + {j * 977}) % 6000 AS DOUBLE) AS {b}"
    for j, b in enumerate(BANDS)
)

_SITE = """CASE WHEN event_id % 100 < 12 THEN event_id - event_id % 100
       WHEN event_id % 100 < 50 THEN event_id - event_id % 2 ELSE event_id END"""

VIEWS: dict[str, str] = {
    # one row per sample: position, tile, region, district and six laboratory values
    "points": f"""
SELECT event_id AS id, spot, user_id, ts, event_type, value,
  72.6e0 + ((spot*7919) % 83000)/1e4 + ((event_id*13) % 12)*1e-5 AS lon,
  15.6e0 + ((spot*104729) % 65000)/1e4 AS lat,
  user_id AS tile, user_id % 5 AS region, 466 + user_id % 36 AS did,
  1e2 + ((spot*7919) % 83000)/2e2 + ((event_id*37) % 1000)/1e1 AS n,
  5e0 + ((spot*104729) % 65000)/2e3 + ((event_id*53) % 200)/1e1 AS p,
  6e1 + ((spot*7919) % 83000)/15e1 + ((event_id*71) % 1500)/1e1 AS k,
  1e-1 + ((event_id*29) % 140)/1e2 AS oc,
  55e-1 + ((event_id*17) % 40)/1e1 AS ph,
  1e-2 + ((event_id*19) % 300)/1e2 AS ec
FROM (SELECT *, {_SITE} AS spot FROM {{events}}) e""",
    # the same records as the laboratory delivers them: everything is text
    "raw": """
SELECT event_id, concat(CASE WHEN event_id % 53 = 0 THEN '28' ELSE sid0 END, '_', CAST(466 + user_id % 36 AS STRING), '_s_', CAST(event_id AS STRING)) AS id,
  CASE WHEN event_id % 101 <> 0 THEN sid0 END AS sid,
  CASE WHEN event_id % 103 <> 0 THEN CAST(466 + user_id % 36 AS STRING) END AS did,
  CAST(2022 + event_id % 3 AS STRING) AS cycle,
  CASE WHEN event_id % 61 = 0 THEN 'not recorded'
       WHEN event_id % 71 <> 0 THEN concat(CAST(1 + event_id % 12 AS STRING), '/', CAST(1 + event_id % 28 AS STRING), '/',
            CAST(CASE WHEN event_id % 67 = 0 THEN 13 ELSE 22 + event_id % 4 END AS STRING), ', 12:00 AM') END AS date,
  CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN '-12.5' WHEN event_id % 83 = 0 THEN '6,982'
       WHEN event_id % 79 = 0 THEN '0' WHEN event_id % 73 = 0 THEN ' 7.1 '
       ELSE concat(CAST((event_id*37) % 1600 AS STRING), '.', lpad(CAST(event_id % 100 AS STRING), 2, '0')) END AS n,
  CASE WHEN event_id % 91 = 0 THEN '' ELSE concat(CAST((event_id*53) % 320 AS STRING), '.', CAST(event_id % 10 AS STRING)) END AS p,
  CASE WHEN event_id % 87 = 0 THEN 'NA' ELSE CAST((event_id*71) % 3200 AS STRING) END AS k,
  concat('0.', lpad(CAST((event_id*29) % 140 AS STRING), 3, '0')) AS oc,
  concat(CAST(3 + (event_id*17) % 9 AS STRING), '.', CAST(event_id % 10 AS STRING)) AS ph,
  concat(CAST((event_id*19) % 12 AS STRING), '.', lpad(CAST(event_id % 100 AS STRING), 2, '0')) AS ec,
  72.6e0 + (spot*7919 % 90000)/1e4 AS lon, 15.6e0 + (spot*104729 % 70000)/1e4 AS lat
FROM (SELECT event_id, user_id, CASE WHEN event_id % 20 < 8 THEN event_id - event_id % 4 ELSE event_id END AS spot, CASE WHEN event_id % 10 < 7 THEN '27' ELSE CAST(20 + event_id % 10 AS STRING) END AS sid0 FROM {events}) e""",
    # dated scenes with a five-sided footprint around (cx, cy)
    "scenes": """
SELECT event_id AS scene_id, user_id AS tile, ts AS scene_ts, CAST(event_id % 100 AS DOUBLE) AS cloud,
  72.6e0 + ((event_id*7919) % 83000)/1e4 AS cx, 15.6e0 + ((event_id*104729) % 65000)/1e4 AS cy
FROM {events} WHERE event_type = 'view'""",
    # 3x3-pixel statistics of a sample in a scene, bands as digital numbers
    "windows": f"""
SELECT l_partkey AS id, l_orderkey*10 + l_linenumber AS scene_id, l_shipdate AS dt, l_suppkey AS tile,
  CASE WHEN (l_orderkey*7 + l_linenumber) % 211 = 0 THEN concat('failed: http ', CAST(500 + l_orderkey % 5 AS STRING)) ELSE 'ok' END AS status,
  CASE WHEN l_orderkey % 13 = 0 THEN 8 ELSE 9 END AS n_px,
  CASE WHEN l_orderkey % 4 = 0 THEN 4 ELSE 5 END AS scl_min,
  CASE WHEN l_partkey % 5 = 0 THEN 6 ELSE 5 END AS scl_max,
  CASE WHEN l_linenumber % 3 = 0 THEN 4 ELSE 5 END AS scl_major,
  CAST(l_orderkey % 12 AS BIGINT) AS rank,
  {_BAND_SQL}
FROM {{lineitem}}""",
    # repeated measurements on one key
    "repeated": """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag, l_linestatus,
  CAST(l_quantity AS DOUBLE) AS n, CAST(l_discount AS DOUBLE) AS p, CAST(l_tax AS DOUBLE) AS k, l_shipdate
FROM {lineitem}""",
    # raster cells: tiles of 100 x 100, values and class codes
    "grid": """
SELECT CAST(floor(event_id/1e4) AS BIGINT) AS tile, CAST(floor(event_id/1e2) AS BIGINT) % 100 AS "row", event_id % 100 AS col,
  value, user_id % 12 AS cls
FROM {events}""",
    # dated vegetation values per point
    "series": """
SELECT l_suppkey AS id, l_shipdate AS dt, CAST(l_discount*10 AS DOUBLE) AS ndvi, l_linenumber % 4 AS qa,
  CASE WHEN l_quantity > 2 THEN l_quantity/5e2 END AS vv, l_extendedprice/1e6 AS vh, CAST(l_linenumber AS INTEGER) AS cls,
  l_orderkey, l_linenumber
FROM {lineitem}""",
    # monthly climate grid: node indices, month and a value
    "climate": """
SELECT o_custkey % 100 AS node_x, CAST(floor(o_custkey/1e2) AS BIGINT) AS node_y, o_orderdate AS dt, o_totalprice/1e3 AS ppt,
  2e1 + (o_orderkey % 200)/1e1 AS tmax, 1e1 + (o_orderkey % 130)/1e1 AS tmin
FROM {orders}""",
    # measuring stations with gaps
    "stations": """
SELECT s_suppkey AS st_id, 72.6e0 + ((s_suppkey*7907) % 83000)/1e4 AS lon, 15.6e0 + ((s_suppkey*10007) % 65000)/1e4 AS lat,
  CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS level, s_nationkey % 5 AS region
FROM {supplier}""",
}
VIEWS["grid"] = VIEWS["grid"].replace('"row"', "r")

# feature vectors: list indexing differs between the engines, so the text is made per engine
FEATURE_COLS = [f"f{j + 1:02d}" for j in range(12)]


def _features(first: int) -> str:
    cols = ", ".join(f"6e-1 + CAST(embedding[{first + j}] AS DOUBLE) AS {c}" for j, c in enumerate(FEATURE_COLS))
    return f"SELECT vec_id AS id, label, label % 5 AS region, {cols} FROM {{embeddings}}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a derived view, or of a base table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _features(0) if name == "features" else VIEWS[name]
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE}))


def oracle(sql: str, *names: str) -> str:
    """DuckDB text: the views as common table expressions, then the query."""
    parts = []
    for n in names:
        text = _features(1) if n == "features" else VIEWS[n]
        parts.append(f"{n} AS ({text.format(**{t: t for t in BASE})})")
    head = ("WITH RECURSIVE " if "RECURSIVE" in sql else "WITH ") + ",\n".join(parts) if parts else ""
    body = sql.strip().replace("RECURSIVE", "", 1) if "RECURSIVE" in sql else sql.strip()
    if head and body.upper().startswith("WITH "):
        return head + ",\n" + body[5:]
    return (head + "\n" + body) if head else body
