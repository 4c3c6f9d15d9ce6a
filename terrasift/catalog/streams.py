"""Streaming jobs, run to the end of the available files and compared with the batch answer."""

from pyspark.sql import functions as F

from terrasift.catalog.aggregates import rnd
from terrasift.catalog.columns import AGY, SEASON, _STRICT
from terrasift.catalog.joining import PAIRS
from terrasift.catalog.places import N
from terrasift.functions import clean
from terrasift.session import scratch
from terrasift.sources.views import oracle, view
from terrasift.streaming import incremental as inc

Q = QUERIES = {}


def fed(s, job, *inputs):
    """Write the inputs' steps (frame, conditions) one after another, each in its natural parts, and run the job after each.

    The job's checkpoint carries it from step to step, and a step is one batch however many files it has.
    """
    paths = [scratch(s, "in") for _ in inputs]
    for i in range(len(inputs[0][1])):
        for path, (df, cuts) in zip(paths, inputs, strict=True):
            df.filter(cuts[i]).write.mode("append").parquet(path)
        job(*[inc.source(s, path, df.schema, 1_000_000) for path, (df, _) in zip(paths, inputs, strict=True)])


def l01(s, d):
    ev = view(s, d, "events").select("event_id", "user_id", "value")
    sink, ck = scratch(s, "sink"), scratch(s, "ck")
    fed(s, lambda st: inc.ingest(st, sink, ["event_id"], ck), (ev, ["user_id % 3 = 0", "user_id % 3 < 2", "true"]))
    return inc.ingested(s, sink)


Q["l01_ingest_exactly_once"] = (l01, "SELECT event_id, user_id, value FROM events")
_YEARS = ["dt < '1997-01-01'", "dt >= '1997-01-01' AND dt < '1999-06-01'", "dt >= '1999-06-01'"]


def l02(s, d):
    sink, ck = scratch(s, "sink"), scratch(s, "ck")
    fed(s, lambda st: inc.season_state(st, sink, ck), (view(s, d, "series").select("id", "dt", "ndvi"), _YEARS))
    return rnd(inc.latest(s, sink, ["id", "agyear", "season"]), ["total"])


Q["l02_season_state"] = (l02, oracle(f"SELECT id, {AGY} AS agyear, {SEASON} AS season, max(ndvi) AS hi, min(ndvi) AS lo, round(sum(ndvi), 6) AS total, {N} AS n FROM series GROUP BY 1, 2, 3", "series"))


def l03(s, d):
    sink, ck = scratch(s, "sink"), scratch(s, "ck")
    fed(s, lambda st: inc.composite(st, sink, ck), (view(s, d, "series").select("id", "dt", "ndvi"), _YEARS))
    out = inc.composites(s, sink)
    return out.select("id", F.date_format("start", "yyyy-MM-dd").alias("start"), "best", F.round("mean", 6).alias("mean"), "n")


# files are in time order, so no row is late and the batch answer holds
Q["l03_sixteen_day_composite"] = (l03, oracle(f"SELECT id, strftime(DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(dt AS DATE))/16) AS INTEGER)*16, '%Y-%m-%d') AS start, max(ndvi) AS best, round(avg(ndvi), 6) AS mean, {N} AS n FROM series GROUP BY 1, 2", "series"))


def l04(s, d):
    a = view(s, d, "points").select("id", "tile", "ts"), ["ts < '2024-01-16'", "ts >= '2024-01-16'"]
    b = view(s, d, "scenes").select("scene_id", "tile", "scene_ts"), ["scene_ts < '2024-01-16'", "scene_ts >= '2024-01-16'"]
    sink, ck = scratch(s, "sink"), scratch(s, "ck")
    fed(s, lambda x, y: inc.match(x, y, sink, ck), a, b)
    return s.read.parquet(sink)


Q["l04_scene_match_stream"] = (l04, oracle(f"SELECT id, scene_id, date_difference_days FROM {PAIRS}", "points", "scenes"))


def l05(s, d):
    w = view(s, d, "windows").select("id", "scene_id", "rank", "status", "scl_min", "scl_max", "n_px")
    store, ck = scratch(s, "store"), scratch(s, "ck")
    fed(s, lambda st: inc.rounds(st, store, clean.strict_bare(), ck), (w, [f"rank >= {i} AND rank < {i + 3}" for i in (0, 3, 6, 9)]))
    return inc.served(s, store).groupBy("id").agg(F.count("*").alias("n"), F.max("round").alias("last_round"))


Q["l05_rounds_for_unserved_ids"] = (l05, oracle(f"""WITH w AS (SELECT *, CAST(floor(rank/3) AS BIGINT) AS rd FROM windows), f AS (SELECT id, min(rd) FILTER (WHERE {_STRICT}) AS fr FROM w GROUP BY 1)
 SELECT w.id, {N} AS n, max(rd) AS last_round FROM w JOIN f ON w.id = f.id WHERE fr IS NULL OR rd <= fr GROUP BY 1""", "windows"))
