"""How the driver's tables stand in for sensors, in DataFrames and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import joins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = joins.HOUR
TOLERANCE = 12 * HOUR
#: Users have a few events a day, so spans of joins are longer than for sensors.
DAYS = 24 * 30 * HOUR


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, us, event_id, event_type, value, k: users are sequences, views are camera frames."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        F.col("user_id").alias("seq_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


EV = """ev AS (SELECT user_id AS seq_id, epoch_us(ts) AS us, event_id, event_type, value,
  regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k FROM events)"""

#: Odd divisors keep rounded results off ties, where sums in another order would differ.
POSE = {
    "px": (lambda: F.col("value") / 9.7, "value / 9.7::DOUBLE"),
    "py": (lambda: F.col("k") / 9.7, "k / 9.7::DOUBLE"),
    "pz": (lambda: (F.col("value") - F.col("k")) / 19.3, "(value - k) / 19.3::DOUBLE"),
    "vx": (lambda: F.col("k") / 9.7 - 5.0, "k / 9.7::DOUBLE - 5.0::DOUBLE"),
    "vy": (lambda: F.col("value") / 97, "value / 97"),
    "vz": (lambda: F.lit(0.5), "0.5::DOUBLE"),
}


def posed(rows: DataFrame) -> DataFrame:
    """Adds position, velocity and unit orientation made of value and k."""
    rows = rows.withColumns({n: f() for n, (f, _) in POSE.items()})
    q = g.q_normalize((F.lit(1.0), F.col("value") / 500, F.col("k") / 100.0, F.lit(0.25)))
    return rows.withColumns(dict(zip(("qw", "qx", "qy", "qz"), q, strict=True)))


QN = "sqrt(1 + (value / 500) * (value / 500) + (k / 100.0::DOUBLE) * (k / 100.0::DOUBLE) + 0.0625)"
POSED = (
    "posed AS (SELECT *, "
    + ", ".join(f"{s} AS {n}" for n, (_, s) in POSE.items())
    + f", 1 / {QN} AS qw, (value / 500) / {QN} AS qx, (k / 100.0::DOUBLE) / {QN} AS qy, 0.25::DOUBLE / {QN} AS qz FROM ev)"
)


def frames(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'view'").select("seq_id", "us")


def samples(spark, sf_dir) -> DataFrame:
    """Inertial samples: ax from value, wx from k, the rest fixed functions of both."""
    rows = events(spark, sf_dir).where("event_type <> 'view'")
    return rows.select("seq_id", "us", "event_id", (F.col("value") / 1.03).alias("ax"), (F.col("k") / 10.3).alias("ay"), (F.col("value") / 51 - 9.81).alias("az"), (F.col("k") / 997.0).alias("wx"), (F.col("value") / 5003).alias("wy"), F.lit(0.01).alias("wz"))


FIELDS = ["event_id", "ax", "ay", "az", "wx", "wy", "wz"]
SYNC = EV + """,
f AS (SELECT seq_id, us, lag(us) OVER (PARTITION BY seq_id ORDER BY us) AS start_us FROM ev WHERE event_type = 'view'),
s AS (SELECT seq_id, us, event_id, value / 1.03::DOUBLE AS ax, k / 10.3::DOUBLE AS ay, value / 51 - 9.81::DOUBLE AS az, k / 997.0::DOUBLE AS wx, value / 5003 AS wy, 0.01::DOUBLE AS wz FROM ev WHERE event_type <> 'view'),
j AS (SELECT f.seq_id, f.us, f.start_us, s.us AS sus, s.event_id, s.ax, s.ay, s.az, s.wx, s.wy, s.wz FROM f LEFT JOIN s ON s.seq_id = f.seq_id AND s.us > f.start_us AND s.us <= f.us)"""


def synced(spark, sf_dir) -> DataFrame:
    return joins.interval_join(frames(spark, sf_dir), samples(spark, sf_dir), FIELDS, span=DAYS)


NAMES = ["px", "py", "pz", "vx", "vy", "vz", "qw", "qx", "qy", "qz"]
TRUE = ["tx", "ty", "tz", "tvx", "tvy", "tvz", "tw", "ti", "tj", "tk"]


def estimates(spark, sf_dir) -> DataFrame:
    return posed(events(spark, sf_dir).where("event_type = 'click'")).select("seq_id", "us", "event_id", *NAMES)


def truths(spark, sf_dir) -> DataFrame:
    return posed(events(spark, sf_dir).where("event_type = 'purchase'")).select("seq_id", "us", "event_id", *NAMES)


def pairs(spark, sf_dir) -> DataFrame:
    """Estimated poses with the nearest true ones: px.. and tx.."""
    near = joins.nearest_asof(estimates(spark, sf_dir), truths(spark, sf_dir), TOLERANCE, span=DAYS).where("other is not null")
    return near.select("seq_id", "us", "event_id", "diff_us", F.col("other.event_id").alias("other_id"), F.col("other.us").alias("other_us"), *NAMES, *(F.col(f"other.{n}").alias(t) for n, t in zip(NAMES, TRUE, strict=True)))


def _side(op: str, name: str) -> str:
    return f"{name} AS (SELECT e.seq_id, e.us, e.event_id, t.us AS o_us, t.event_id AS o_id FROM e ASOF LEFT JOIN t ON e.seq_id = t.seq_id AND e.us {op} t.us)"


NEAR = (
    EV
    + ",\n"
    + POSED
    + """,
e AS (SELECT * FROM posed WHERE event_type = 'click'),
t AS (SELECT * FROM posed WHERE event_type = 'purchase'),
"""
    + _side("<=", "fw")
    + ",\n"
    + _side(">", "bw")
    + f""",
near AS (SELECT fw.seq_id, fw.us, fw.event_id,
  CASE WHEN bw.o_us IS NULL OR fw.o_us - fw.us <= fw.us - bw.o_us THEN fw.o_id ELSE bw.o_id END AS other_id,
  CASE WHEN bw.o_us IS NULL OR fw.o_us - fw.us <= fw.us - bw.o_us THEN fw.o_us - fw.us ELSE fw.us - bw.o_us END AS diff_us
  FROM fw JOIN bw USING (event_id)),
pairs AS (SELECT n.seq_id, n.us, n.event_id, n.diff_us, n.other_id, t.us AS other_us, {', '.join(f'e.{n}' for n in NAMES)}, {', '.join(f't.{n} AS {m}' for n, m in zip(NAMES, TRUE, strict=True))}
  FROM near n JOIN e ON e.event_id = n.event_id JOIN t ON t.event_id = n.other_id WHERE n.diff_us <= {TOLERANCE})"""
)
