"""Job tables: every combination of a few small axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows, names) -> DataFrame:
    """Small table of literals, planned on the JVM without a Python worker."""

    def lit(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    # a NULL takes the type of the column's other values
    kinds = [next((type(r[i]) for r in rows if r[i] is not None), str) for i in range(len(names))]
    ddl = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    structs = [F.struct(*[(lit(v) if v is not None else F.lit(None).cast(ddl.get(k, "string"))).alias(n) for v, n, k in zip(r, names, kinds)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def grid(spark: SparkSession, **axes) -> DataFrame:
    """One row per combination of the given value lists (sizes are the caller's literals)."""
    out = None
    for name, values in axes.items():
        t = literal_table(spark, [(v,) for v in values], [name])
        out = t if out is None else out.crossJoin(t)
    return out


def feature_sets(spark: SparkSession, groups: dict) -> DataFrame:
    """Named input lists: each group alone, the growing ladder, and all but one group."""
    names = list(groups)
    rows = [(n, groups[n]) for n in names]
    rows += [("ladder: " + " + ".join(names[: i + 1]), [c for n in names[: i + 1] for c in groups[n]]) for i in range(len(names))]
    rows += [(f"without {n}", [c for m in names if m != n for c in groups[m]]) for n in names]
    return literal_table(spark, rows, ["set_name", "features"])
