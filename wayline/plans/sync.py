"""Queries on stream synchronisation, association, validation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..operators import folds, joins, learning, mapping, points, prefix, validate
from .common import DAYS, EV, FIELDS, HOUR, NEAR, POSED, SYNC, TOLERANCE, estimates, events, frames, pairs, query, samples, synced, truths

DAY = 24 * HOUR


@query(f"""WITH {SYNC} SELECT seq_id, us, start_us, count(event_id) AS n, round(coalesce(avg(ax), 0), 6) AS mean_ax, round(coalesce(var_pop(ax), 0), 6) AS var_ax,
 round(coalesce(avg(wx), 0), 6) AS mean_wx FROM j GROUP BY seq_id, us, start_us""")
def sync_interval_stats(spark, sf_dir):
    rows = synced(spark, sf_dir)
    stats = learning.interval_stats(F.col("samples"), ["ax", "wx"], lambda kind, c: f"{kind}_{c}")
    out = rows.select("seq_id", "us", "start_us", F.size("samples").cast("long").alias("n"), *(c.alias(n) for n, c in stats.items()))
    return out.select("seq_id", "us", "start_us", "n", *(F.round(c, 6).alias(c) for c in ("mean_ax", "var_ax", "mean_wx")))


@query(f"WITH {SYNC} SELECT seq_id, min(us) AS us FROM f WHERE start_us IS NULL GROUP BY seq_id")
def sync_first_frame(spark, sf_dir):
    return synced(spark, sf_dir).where("start_us is null").select("seq_id", "us")


@query(f"WITH {SYNC} SELECT seq_id, us, start_us, round((us - start_us) * 1e-6, 3) AS duration_s FROM j WHERE start_us IS NOT NULL GROUP BY ALL HAVING count(event_id) = 0")
def sync_empty_intervals(spark, sf_dir):
    rows = joins.interval_join(frames(spark, sf_dir), samples(spark, sf_dir), FIELDS, include_first=False, span=DAYS)
    return rows.where(F.size("samples") == 0).select("seq_id", "us", "start_us", F.round((F.col("us") - F.col("start_us")) * 1e-6, 3).alias("duration_s"))


@query(f"WITH {SYNC} SELECT seq_id, us, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY sus, event_id), '') AS ids FROM j GROUP BY seq_id, us")
def sync_nested_samples(spark, sf_dir):
    return synced(spark, sf_dir).select("seq_id", "us", F.array_join(F.transform("samples", lambda s: s["event_id"].cast("string")), ",").alias("ids"))


@query(f"WITH {NEAR} SELECT seq_id, us, event_id, diff_us, other_id FROM pairs")
def nearest_asof_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("seq_id", "us", "event_id", "diff_us", "other_id")


@query(f"""WITH {NEAR}, n AS (SELECT seq_id, count(*) AS n_est FROM e GROUP BY 1), m AS (SELECT seq_id, count(*) AS matched, count(DISTINCT other_id) AS used FROM pairs GROUP BY 1),
 u AS (SELECT seq_id, count(*) AS n_true FROM t GROUP BY 1)
 SELECT seq_id, coalesce(matched, 0) AS matched, n_est - coalesce(matched, 0) AS unmatched_est, coalesce(n_true, 0) - coalesce(used, 0) AS unmatched_true FROM n LEFT JOIN m USING (seq_id) LEFT JOIN u USING (seq_id)""")
def asof_unmatched(spark, sf_dir):
    near = joins.nearest_asof(estimates(spark, sf_dir), truths(spark, sf_dir), TOLERANCE, span=DAYS)
    counts = near.groupBy("seq_id").agg(F.count("other.us").alias("matched"), F.count_if(F.col("other").isNull()).alias("unmatched_est"), F.count_distinct("other.event_id").alias("used"))
    total = truths(spark, sf_dir).groupBy("seq_id").agg(F.count("*").alias("n_true"))
    return counts.join(total, "seq_id", "left").select("seq_id", "matched", "unmatched_est", (F.coalesce("n_true", F.lit(0)) - F.col("used")).alias("unmatched_true"))


@query(f"""WITH {EV}, c AS (SELECT seq_id, us, event_id FROM ev WHERE event_type = 'click'),
 j AS (SELECT a.seq_id, a.event_id, arg_min(b.event_id, b.us) AS ahead_id, min(b.us) - a.us AS gap FROM c a JOIN c b ON a.seq_id = b.seq_id AND b.us >= a.us + {DAY} AND b.us < a.us + {DAY + 12 * HOUR} GROUP BY a.seq_id, a.event_id, a.us) SELECT * FROM j""")
def ahead_pairs_time(spark, sf_dir):
    rows = joins.ahead_in_time(estimates(spark, sf_dir).select("seq_id", "us", "event_id"), DAY, 12 * HOUR, span=DAYS)
    return rows.select("seq_id", "event_id", F.col("ahead.event_id").alias("ahead_id"), (F.col("ahead.us") - F.col("us")).alias("gap"))


@query(f"""WITH {EV}, c AS (SELECT seq_id, us, event_id, last_value(event_id) OVER w AS l_id, last_value(us) OVER w AS l_us FROM ev WHERE event_type = 'click' WINDOW w AS (PARTITION BY seq_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT seq_id, us, event_id FROM c),
 j AS (SELECT a.seq_id, a.us, a.event_id, coalesce(b.event_id, a.l_id) AS ahead_id, coalesce(b.us, a.l_us) - a.us AS gap FROM (SELECT *, us + {DAY} AS goal FROM c) a ASOF LEFT JOIN b ON a.seq_id = b.seq_id AND a.goal <= b.us)
 SELECT seq_id, event_id, ahead_id, gap FROM j WHERE gap >= 0.9::DOUBLE * {DAY}""")
def ahead_pairs_tail(spark, sf_dir):
    rows = joins.ahead_or_last(estimates(spark, sf_dir).select("seq_id", "us", "event_id"), DAY, span=DAYS)
    return rows.select("seq_id", "event_id", F.col("ahead.event_id").alias("ahead_id"), (F.col("ahead.us") - F.col("us")).alias("gap"))


@query(f"WITH {EV}, c AS (SELECT seq_id, event_id, lead(event_id, 3) OVER (PARTITION BY seq_id ORDER BY us) AS ahead_id FROM ev WHERE event_type = 'click') SELECT * FROM c WHERE ahead_id IS NOT NULL")
def frame_lag_pairs(spark, sf_dir):
    return joins.ahead_by_rows(estimates(spark, sf_dir).select("seq_id", "us", "event_id"), 3, DAYS).select("seq_id", "event_id", F.col("ahead.event_id").alias("ahead_id"))


@query(f"WITH {NEAR} SELECT p.seq_id, p.us, x.value, round(p.px - p.tx, 6) AS target FROM pairs p JOIN ev x ON x.seq_id = p.seq_id AND x.us = p.us")
def exact_time_join(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq_id", "us", "value")
    return pairs(spark, sf_dir).join(rows, ["seq_id", "us"]).select("seq_id", "us", "value", F.round(F.col("px") - F.col("tx"), 6).alias("target"))


@query(f"WITH {NEAR} SELECT e.seq_id, e.us, round(coalesce(p.tx, 'NaN'::DOUBLE), 6) AS tx, p.tx IS NULL AS missing FROM e LEFT JOIN pairs p USING (seq_id, us)")
def lookup_left_join(spark, sf_dir):
    found = pairs(spark, sf_dir).select("seq_id", "us", "tx")
    return estimates(spark, sf_dir).join(found, ["seq_id", "us"], "left").select("seq_id", "us", F.round(F.coalesce("tx", F.lit(float("nan"))), 6).alias("tx"), F.col("tx").isNull().alias("missing"))


@query(f"""WITH {EV}, p AS (SELECT seq_id, us // {DAY} AS frame, event_id AS idx, value AS u, k::DOUBLE AS v FROM ev),
 d AS (SELECT a.seq_id, a.frame, a.idx, b.idx AS prev_idx, sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS distance FROM p a JOIN p b ON a.seq_id = b.seq_id AND b.frame = a.frame - 1),
 m AS (SELECT *, row_number() OVER (PARTITION BY seq_id, frame, idx ORDER BY distance, prev_idx) AS r FROM d WHERE distance < 20)
 SELECT p.seq_id, p.frame, p.idx, m.prev_idx, round(m.distance, 6) AS distance FROM p LEFT JOIN m ON m.seq_id = p.seq_id AND m.frame = p.frame AND m.idx = p.idx AND m.r = 1""")
def nearest_neighbour_tracks(spark, sf_dir):
    points = events(spark, sf_dir).select("seq_id", F.floor(F.col("us") / DAY).alias("frame"), F.col("event_id").alias("idx"), F.col("value").alias("u"), F.col("k").cast("double").alias("v"))
    return joins.nearest_points(points, 20.0).select("seq_id", "frame", "idx", "prev_idx", F.round("distance", 6).alias("distance"))


@query(f"""WITH RECURSIVE {EV}, p AS (SELECT seq_id, us // {DAY} AS frame, event_id AS idx, value AS u, k::DOUBLE AS v FROM ev),
 d AS (SELECT a.seq_id, a.frame, a.idx, b.idx AS prev_idx, sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS distance FROM p a JOIN p b ON a.seq_id = b.seq_id AND b.frame = a.frame - 1),
 m AS (SELECT *, row_number() OVER (PARTITION BY seq_id, frame, idx ORDER BY distance, prev_idx) AS r FROM d WHERE distance < 60),
 l AS (SELECT p.seq_id, p.frame, p.idx, m.prev_idx FROM p LEFT JOIN m ON m.seq_id = p.seq_id AND m.frame = p.frame AND m.idx = p.idx AND m.r = 1),
 t AS (SELECT seq_id, frame, idx, frame AS f0, idx AS i0 FROM l WHERE prev_idx IS NULL UNION ALL SELECT l.seq_id, l.frame, l.idx, t.f0, t.i0 FROM l JOIN t ON l.seq_id = t.seq_id AND l.frame = t.frame + 1 AND l.prev_idx = t.idx)
 SELECT seq_id, frame, idx, dense_rank() OVER (PARTITION BY seq_id ORDER BY f0, i0) - 1 AS track FROM t""")
def track_propagation(spark, sf_dir):
    points = events(spark, sf_dir).select("seq_id", F.floor(F.col("us") / DAY).alias("frame"), F.col("event_id").alias("idx"), F.col("value").alias("u"), F.col("k").cast("double").alias("v"))
    return mapping.track_ids(joins.nearest_points(points, 60.0))


@query(f"""WITH RECURSIVE {EV}, p AS (SELECT us // {DAY} AS frame, event_id AS idx, value AS u, k::DOUBLE AS v, (event_id * 7919) % 1009 AS strength FROM ev),
 o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY strength DESC, idx) AS r FROM p),
 t AS (SELECT frame, r, [{{'idx': idx, 'u': u, 'v': v, 'strength': strength}}] AS taken FROM o WHERE r = 1
  UNION ALL SELECT o.frame, o.r, CASE WHEN len(list_filter(taken, lambda a: pow(a.u - o.u, 2) + pow(a.v - o.v, 2) < 900)) = 0 THEN list_append(taken, {{'idx': idx, 'u': o.u, 'v': o.v, 'strength': o.strength}}) ELSE taken END
  FROM t JOIN o ON o.frame = t.frame AND o.r = t.r + 1),
 l AS (SELECT frame, unnest(taken) AS a FROM t QUALIFY row_number() OVER (PARTITION BY frame ORDER BY r DESC) = 1),
 n AS (SELECT frame, a.idx AS idx, a.strength AS strength, row_number() OVER (PARTITION BY frame ORDER BY a.strength DESC, a.idx) AS rank FROM l)
 SELECT frame, idx, strength, rank::INTEGER AS rank FROM n WHERE rank <= 30""")
def strongest_spaced_points(spark, sf_dir):
    """A day's events as points of a frame: the strongest 30 that are 30 apart."""
    rows = events(spark, sf_dir).select(F.lit(0).alias("seq_id"), F.floor(F.col("us") / DAY).alias("frame"), F.col("event_id").alias("idx"), F.col("value").alias("u"), F.col("k").cast("double").alias("v"), ((F.col("event_id") * 7919) % 1009).alias("strength"))
    return points.strongest_points(rows, 30.0, 30).select("frame", "idx", "strength", "rank")


@query(f"""WITH {EV}, w AS (SELECT seq_id, us, event_id, lag(us) OVER (PARTITION BY seq_id ORDER BY us) AS prev_us FROM ev)
 SELECT seq_id, event_id, prev_us, round(CASE WHEN (us - prev_us) IS NULL THEN 0.05 ELSE greatest((us - prev_us) * 1e-6, 1e-4) END, 6) AS dt FROM w""")
def clamped_time_steps(spark, sf_dir):
    rows = learning.with_steps(events(spark, sf_dir), DAYS)
    return rows.select("seq_id", "event_id", "prev_us", F.round("dt", 6).alias("dt"))


@query(f"""WITH {EV}, {POSED}, c AS (SELECT *, CASE WHEN (us - lag(us) OVER w) IS NULL THEN 0.05 ELSE greatest((us - lag(us) OVER w) * 1e-6, 1e-4) END AS dt, row_number() OVER w AS r, first_value(px) OVER w AS p0 FROM posed WHERE event_type = 'click' WINDOW w AS (PARTITION BY seq_id ORDER BY us))
 SELECT seq_id, event_id, round(p0 + sum(CASE WHEN r > 1 THEN vx * dt ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY us ROWS UNBOUNDED PRECEDING), 3) AS corrected_px FROM c""")
def corrected_position(spark, sf_dir):
    rows = learning.with_steps(estimates(spark, sf_dir), DAYS)
    return folds.gated_correction(rows, 1, DAYS).select("seq_id", "event_id", F.round("hybrid_px", 3).alias("corrected_px"))


@query(f"""WITH {EV}, {POSED}, c AS (SELECT *, CASE WHEN (us - lag(us) OVER w) IS NULL THEN 0.05 ELSE greatest((us - lag(us) OVER w) * 1e-6, 1e-4) END AS dt, row_number() OVER w - 1 AS r, first_value(px) OVER w AS p0 FROM posed WHERE event_type = 'click' WINDOW w AS (PARTITION BY seq_id ORDER BY us))
 SELECT seq_id, event_id, CASE WHEN r % 3 = 0 THEN round(p0 + sum(CASE WHEN r > 0 AND r % 3 = 0 THEN vx * dt ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY us ROWS UNBOUNDED PRECEDING), 3) ELSE round(px, 3) END AS hybrid_px FROM c""")
def gated_correction(spark, sf_dir):
    rows = learning.with_steps(estimates(spark, sf_dir), DAYS)
    return folds.gated_correction(rows, 3, DAYS).select("seq_id", "event_id", F.round("hybrid_px", 3).alias("hybrid_px"))


@query(f"WITH {NEAR} SELECT seq_id, event_id, round(sqrt(avg((px - tx) * (px - tx)) OVER w), 6) AS rmse, round(avg(abs(px - tx)) OVER w, 6) AS mean FROM pairs WINDOW w AS (PARTITION BY seq_id ORDER BY us ROWS UNBOUNDED PRECEDING)")
def running_rmse(spark, sf_dir):
    error = F.col("px") - F.col("tx")
    rows = prefix.scan(pairs(spark, sf_dir), DAYS, n=prefix.running_count(), squares=prefix.running_sum(error * error), sizes=prefix.running_sum(F.abs(error)))
    return rows.select("seq_id", "event_id", F.round(F.sqrt(F.col("squares") / F.col("n")), 6).alias("rmse"), F.round(F.col("sizes") / F.col("n"), 6).alias("mean"))


@query(f"WITH {EV}, c AS (SELECT seq_id, event_id, row_number() OVER (PARTITION BY seq_id ORDER BY us) AS r, count(*) OVER (PARTITION BY seq_id) AS n FROM ev) SELECT seq_id, event_id, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM c")
def chrono_split(spark, sf_dir):
    return learning.chronological(events(spark, sf_dir), span=DAYS).select("seq_id", "event_id", "part")


@query(f"WITH {EV}, c AS (SELECT seq_id, event_id, row_number() OVER (PARTITION BY seq_id ORDER BY us) - 1 AS r FROM ev) SELECT * FROM c WHERE r % 5 = 0")
def every_nth_row(spark, sf_dir):
    return prefix.scan(events(spark, sf_dir), DAYS, n=prefix.running_count()).select("seq_id", "event_id", (F.col("n") - 1).alias("r")).where("r % 5 = 0")


@query(f"WITH {EV} SELECT seq_id, event_id, coalesce(us > lag(us) OVER (PARTITION BY seq_id ORDER BY event_id), true) AS ok FROM ev")
def monotonic_flag(spark, sf_dir):
    return events(spark, sf_dir).select("seq_id", "event_id", validate.monotonic().alias("ok"))


@query(f"WITH {EV}, c AS (SELECT seq_id, event_id, us, row_number() OVER (PARTITION BY seq_id ORDER BY us) - 1 AS idx FROM ev) SELECT seq_id, event_id, idx FROM c WHERE idx <= 20")
def playback_prefix(spark, sf_dir):
    return prefix.scan(events(spark, sf_dir), DAYS, n=prefix.running_count()).select("seq_id", "event_id", (F.col("n") - 1).alias("idx")).where("idx <= 20")


@query(f"WITH {EV}, {POSED} SELECT seq_id, event_id, round(px - first_value(px) OVER w, 6) AS px, round(py - first_value(py) OVER w, 6) AS py, round(pz - first_value(pz) OVER w, 6) AS pz, round((us - first_value(us) OVER w) * 1e-6, 3) AS t FROM posed WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY seq_id ORDER BY us)")
def origin_shift(spark, sf_dir):
    rows = prefix.scan(truths(spark, sf_dir), DAYS, start=prefix.first_value(F.struct("us", "px", "py", "pz")))
    moved = [F.round(F.col(c) - F.col(f"start.{c}"), 6).alias(c) for c in ("px", "py", "pz")]
    return rows.select("seq_id", "event_id", *moved, F.round((F.col("us") - F.col("start.us")) * 1e-6, 3).alias("t"))


@query(f"WITH {EV}, {POSED} SELECT event_id, py AS east, px AS north, -pz AS up FROM posed WHERE event_type = 'click'")
def display_axes(spark, sf_dir):
    return estimates(spark, sf_dir).select("event_id", F.col("py").alias("east"), F.col("px").alias("north"), (-F.col("pz")).alias("up"))


@query("""WITH c AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n, label FROM embeddings)
 SELECT vec_id, label FROM c WHERE r % greatest(1, n // 20) = 0""")
def landmark_downsample(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("label")) / 20))
    return rows.withColumns({"r": rank, "step": step}).where("r % step = 0").select("vec_id", "label")


@query(f"""WITH {EV}, c AS (SELECT event_type AS seq_id, event_id, l, lag(l) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM (SELECT event_type, event_id, us // {HOUR} AS l FROM ev))
 SELECT seq_id, event_id, l AS us, before, 'not increasing' AS reason FROM c WHERE l <= before""")
def validate_strict_order(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("seq_id"), "event_id", F.floor(F.col("us") / HOUR).alias("us"))
    return validate.order_violations(rows, True, tie="event_id").select("seq_id", "event_id", "us", "before", "reason")


@query(f"""WITH {EV}, c AS (SELECT seq_id, event_id, k - 1 AS us, lag(k - 1) OVER (PARTITION BY seq_id ORDER BY event_id) AS before FROM ev)
 SELECT seq_id, event_id, us, before, CASE WHEN us < 0 THEN 'negative' ELSE 'decreasing' END AS reason FROM c WHERE us < 0 OR us < before""")
def validate_order(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq_id", "event_id", (F.col("k") - 1).alias("us"))
    return validate.order_violations(rows, False, tie="event_id").select("seq_id", "event_id", "us", "before", "reason")


SCRUB_SQL = f"WITH {EV}, c AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 'NaN'::DOUBLE WHEN k % 10 = 1 THEN 'Infinity'::DOUBLE WHEN k % 10 = 2 THEN '-Infinity'::DOUBLE WHEN k % 10 = 3 THEN NULL ELSE value END AS x FROM ev)"


def broken(spark, sf_dir):
    r = F.col("k") % 10
    x = F.when(r == 0, float("nan")).when(r == 1, float("inf")).when(r == 2, float("-inf")).when(r == 3, F.lit(None).cast("double")).otherwise(F.col("value"))
    return events(spark, sf_dir).select("event_id", "seq_id", x.alias("x"))


@query(SCRUB_SQL + " SELECT event_id, x IS NOT NULL AND isfinite(x) AS valid FROM c")
def numeric_validity(spark, sf_dir):
    return broken(spark, sf_dir).select("event_id", validate.all_finite("x").alias("valid"))


@query(SCRUB_SQL + " SELECT event_id, CASE WHEN x IS NULL OR isnan(x) THEN 0 WHEN isinf(x) THEN CASE WHEN x > 0 THEN 100 ELSE -100 END ELSE x END::DOUBLE AS scrubbed FROM c")
def finite_scrub(spark, sf_dir):
    return broken(spark, sf_dir).select("event_id", g.scrub(F.col("x"), 100.0).alias("scrubbed"))


@query(SCRUB_SQL + " SELECT event_id, x FROM c WHERE NOT isnan(x)")
def nan_mask_filter(spark, sf_dir):
    return broken(spark, sf_dir).where(F.col("x").isNotNull() & ~F.isnan("x"))[["event_id", "x"]]


@query(f"WITH {EV} SELECT event_id, (k % 7 > 0 AND k % 11 > 0 AND value / 300 < 1.0 AND value >= 0 AND value < 400 AND k < 90) AS kept FROM ev")
def track_filter(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("value").alias("u"), F.col("k").cast("double").alias("v"), (F.col("k") % 7 > 0).alias("forward_ok"), (F.col("k") % 11 > 0).alias("backward_ok"), (F.col("value") / 300).alias("back_error"))
    return rows.select("event_id", validate.track_kept(400.0, 90.0).alias("kept"))


@query(f"""WITH {EV}, c AS (SELECT seq_id, us // {DAY} AS frame, count(*) AS points, stddev_pop(value) AS su, stddev_pop(k / 30.0::DOUBLE) AS sv FROM ev GROUP BY ALL)
 SELECT seq_id, frame, points, CASE WHEN points < 3 THEN 'insufficient' WHEN su < 1 OR sv < 1 THEN 'degenerate' ELSE 'ok' END AS status FROM c""")
def degenerate_spread(spark, sf_dir):
    points = events(spark, sf_dir).select("seq_id", F.floor(F.col("us") / DAY).alias("frame"), F.col("value").alias("u"), (F.col("k") / 30.0).alias("v"))
    return validate.spread_status(points, ["seq_id", "frame"], 3)


@query(f"WITH {EV}, c AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY event_id DESC) AS r FROM ev) SELECT seq_id, event_id, value FROM c WHERE r <= 5")
def fifo_last_n(spark, sf_dir):
    newest = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("event_id")))
    return events(spark, sf_dir).withColumn("r", newest).where("r <= 5").select("seq_id", "event_id", "value")


@query(f"""WITH {EV}, h AS (SELECT seq_id, us, event_type <> 'error' AS visual, CASE WHEN k < 15 THEN 5 ELSE 30 END AS features, value < 400 AS valid, event_type <> 'signup' AS ready FROM ev),
 l AS (SELECT seq_id, list({{'us': us, 'visual': visual, 'features': features, 'valid': valid, 'ready': ready}} ORDER BY us) AS rows FROM h GROUP BY seq_id),
 RECURSIVE_STATES AS (SELECT seq_id, list_reduce(list_transform(rows, lambda r: CASE WHEN NOT r.valid THEN 'x' WHEN r.ready AND r.features >= 10 AND r.visual THEN 'B' WHEN r.ready AND r.features >= 10 THEN 'R' WHEN r.visual AND r.features >= 10 THEN 'g' ELSE 'b' END),
   lambda s, c: s || CASE WHEN s[-1:] = 'L' OR c = 'x' THEN 'L' WHEN s[-1:] = 'I' THEN CASE WHEN c IN ('B', 'R') THEN 'T' ELSE 'I' END
     WHEN s[-1:] = 'T' THEN CASE WHEN c IN ('B', 'g') THEN 'T' ELSE 'D' END
     ELSE CASE WHEN c IN ('B', 'g') THEN 'T' WHEN length(s) - length(rtrim(s, 'D')) >= 3 THEN 'L' ELSE 'D' END END, 'I') AS s, rows FROM l)
 SELECT seq_id, rows[i].us AS us, CASE substr(s, i::INTEGER + 1, 1) WHEN 'I' THEN 'INITIALIZING' WHEN 'T' THEN 'TRACKING' WHEN 'D' THEN 'DEGRADED' ELSE 'LOST' END AS state,
  CASE WHEN substr(s, i::INTEGER + 1, 1) = 'D' THEN (i + 1) - length(rtrim(substr(s, 1, i::INTEGER + 1), 'D')) ELSE 0 END::BIGINT AS count
 FROM (SELECT *, unnest(range(1, len(rows) + 1)) AS i FROM RECURSIVE_STATES)""")
def health_fsm(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq_id", "us", (F.col("event_type") != "error").alias("visual"), F.when(F.col("k") < 15, 5).otherwise(30).alias("features"), (F.col("value") < 400).alias("valid"), (F.col("event_type") != "signup").alias("ready"))
    return folds.health_states(rows, 10, 3, DAYS)


@query(f"WITH {EV} SELECT seq_id, count(*) AS frames, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'view') AS tracked FROM ev GROUP BY seq_id")
def run_counters(spark, sf_dir):
    return events(spark, sf_dir).groupBy("seq_id").agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") == "view").alias("tracked"))


@query(f"""WITH {SYNC}, o AS (SELECT *, lead(sus) OVER w AS nus, row_number() OVER w AS r, count(*) OVER (PARTITION BY seq_id, us) AS n FROM j WHERE sus IS NOT NULL WINDOW w AS (PARTITION BY seq_id, us ORDER BY sus)),
 d AS (SELECT seq_id, us, sum(CASE WHEN n = 1 THEN 0.005 WHEN nus IS NOT NULL THEN (nus - sus) * 1e-6 ELSE 0 END) AS total_dt, sum(CASE WHEN n = 1 THEN 0.005 * wx WHEN nus IS NOT NULL THEN (nus - sus) * 1e-6 * wx ELSE 0 END) AS turned FROM o GROUP BY ALL)
 SELECT f.seq_id, f.us, round(coalesce(total_dt, 0), 3) AS total_dt, round(coalesce(turned, 0), 3) AS turned FROM f LEFT JOIN d USING (seq_id, us)""")
def interval_steps(spark, sf_dir):
    """Integrated time and turn of each interval: n samples make n - 1 steps, one alone a nominal step."""
    n = F.size("samples")
    lone = F.col("samples")[0]
    steps = F.zip_with(F.slice("samples", 1, n), F.slice("samples", 2, n), lambda a, b: F.struct(((b["us"] - a["us"]) * 1e-6).alias("dt"), a["wx"].alias("wx")))
    kept = F.when(n > 1, F.filter(steps, lambda s: s["dt"].isNotNull())).when(n == 1, F.array(F.struct(F.lit(folds.NOMINAL_DT).alias("dt"), lone["wx"].alias("wx"))))
    total = lambda f: F.round(F.coalesce(F.aggregate(kept, F.lit(0.0), lambda s, x: s + f(x)), F.lit(0.0)), 3)
    return synced(spark, sf_dir).select("seq_id", "us", total(lambda x: x["dt"]).alias("total_dt"), total(lambda x: x["dt"] * x["wx"]).alias("turned"))
