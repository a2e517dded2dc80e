"""Queries on trajectory errors, alignment and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import joins, metrics, order
from ..operators.tables import saved
from ..sources import files
from .common import DAYS, EV, HOUR, NAMES, NEAR, POSED, TRUE, estimates, events, pairs, posed, query, samples, truths

DAY = 24 * HOUR
P, T = NAMES[:3], TRUE[:3]
ERR = "sqrt((px - tx) * (px - tx) + (py - ty) * (py - ty) + (pz - tz) * (pz - tz))"
VERR = "sqrt((vx - tvx) * (vx - tvx) + (vy - tvy) * (vy - tvy) + (vz - tvz) * (vz - tvz))"
DOT = "(qw * tw + qx * ti + qy * tj + qz * tk)"


def between(a, b):
    return g.norm(g.sub(g.vec(*a), g.vec(*b)))


def rounded(cols, digits=6):
    return [F.round(c, digits).alias(n) for n, c in cols]


def summary(rows, error, by, digits=6):
    rows = rows.select(*by, "us", "event_id", error.alias("_error"))
    out = order.summarize(rows, by, metrics.error_summary(F.col("_error"), F.struct("us", "event_id")), {"median": ("_error", 0.5)})
    return out.select(*by, *(F.round(c, digits).alias(c) for c in ("rmse", "mean", "median", "std", "min", "max", "final")))


def summary_sql(error, source, by, digits=6):
    cols = {"rmse": "sqrt(avg(x * x))", "mean": "avg(x)", "median": "median(x)", "std": "stddev_pop(x)", "min": "min(x)", "max": "max(x)", "final": "arg_max(x, (us, event_id))"}
    return f"SELECT {by}, {', '.join(f'round({c}, {digits}) AS {n}' for n, c in cols.items())} FROM (SELECT *, {error} AS x FROM {source}) GROUP BY {by}"


@query(f"WITH {NEAR} {summary_sql(ERR, 'pairs', 'seq_id')}")
def ate_summary(spark, sf_dir):
    return summary(pairs(spark, sf_dir), between(P, T), ["seq_id"])


@query(f"WITH {NEAR} {summary_sql(VERR, 'pairs', 'seq_id')}")
def velocity_errors(spark, sf_dir):
    return summary(pairs(spark, sf_dir), between(NAMES[3:6], TRUE[3:6]), ["seq_id"])


@query(f"WITH {NEAR} SELECT seq_id, " + ", ".join(f"round(sqrt(avg(({p} - {t}) * ({p} - {t}))), 6) AS rmse_{a}, round(avg(abs({p} - {t})), 6) AS mae_{a}, round(max(abs({p} - {t})), 6) AS max_{a}" for p, t, a in zip(P, T, "xyz")) + " FROM pairs GROUP BY seq_id")
def axis_errors(spark, sf_dir):
    named = [c for p, t, a in zip(P, T, "xyz", strict=True) for c in metrics.axis_summary(F.col(p) - F.col(t), a)]
    out = pairs(spark, sf_dir).groupBy("seq_id").agg(*named)
    return out.select("seq_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"WITH {NEAR} SELECT seq_id, count(*) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(max(x), 4) AS max FROM (SELECT seq_id, degrees(2 * acos(least(1.0::DOUBLE, abs({DOT})))) AS x FROM pairs) GROUP BY seq_id")
def orientation_error(spark, sf_dir):
    x = g.q_angle(g.vec(*NAMES[6:]), g.vec(*TRUE[6:]))
    rows = pairs(spark, sf_dir).select("seq_id", x.alias("x"))
    out = order.summarize(rows, ["seq_id"], [F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("max")], {"median": ("x", 0.5)})
    return out.select("seq_id", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "max")))


def rel_sql(ahead: str) -> str:
    q = lambda w, x, y, z, p: (f"({p}{w}*b.{w} + {p}{x}*b.{x} + {p}{y}*b.{y} + {p}{z}*b.{z})", f"({p}{w}*b.{x} - {p}{x}*b.{w} - {p}{y}*b.{z} + {p}{z}*b.{y})", f"({p}{w}*b.{y} + {p}{x}*b.{z} - {p}{y}*b.{w} - {p}{z}*b.{x})", f"({p}{w}*b.{z} - {p}{x}*b.{y} + {p}{y}*b.{x} - {p}{z}*b.{w})")
    e, t = q("qw", "qx", "qy", "qz", "a."), q("tw", "ti", "tj", "tk", "a.")
    move = " + ".join(f"pow((b.{p} - a.{p}) - (b.{t_} - a.{t_}), 2)" for p, t_ in zip(P, T, strict=True))
    dot = " + ".join(f"{x} * {y}" for x, y in zip(e, t, strict=True))
    return f"""WITH {NEAR}, {ahead},
 x AS (SELECT a.seq_id, sqrt({move}) AS tr, degrees(2 * acos(least(1.0::DOUBLE, abs({dot})))) AS ro FROM h JOIN pairs a ON a.event_id = h.event_id JOIN pairs b ON b.event_id = h.ahead_id)
 SELECT seq_id, count(*) AS n, round(sqrt(avg(tr * tr)), 5) AS translation_rmse, round(avg(tr), 5) AS translation_mean, round(median(tr), 5) AS translation_median, round(max(tr), 5) AS translation_max, round(avg(ro), 3) AS rotation_mean, round(max(ro), 3) AS rotation_max FROM x GROUP BY seq_id"""


def rpe(ahead):
    rows = metrics.relative_errors(ahead).select("seq_id", "translation", "rotation")
    aggs = [F.count("*").alias("n"), metrics.rmse(F.col("translation")).alias("translation_rmse"), F.avg("translation").alias("translation_mean"), F.max("translation").alias("translation_max"), F.avg("rotation").alias("rotation_mean"), F.max("rotation").alias("rotation_max")]
    out = order.summarize(rows, ["seq_id"], aggs, {"translation_median": ("translation", 0.5)})
    return out.select("seq_id", "n", *(F.round(c, 5).alias(c) for c in ("translation_rmse", "translation_mean", "translation_median", "translation_max")), *(F.round(c, 3).alias(c) for c in ("rotation_mean", "rotation_max")))


@query(rel_sql("h AS (SELECT event_id, lead(event_id) OVER (PARTITION BY seq_id ORDER BY us) AS ahead_id FROM pairs)"))
def rpe_frame(spark, sf_dir):
    return rpe(joins.ahead_by_rows(pairs(spark, sf_dir), 1, DAYS))


@query(rel_sql(f"h AS (SELECT a.event_id, arg_min(b.event_id, b.us) AS ahead_id FROM pairs a JOIN pairs b ON a.seq_id = b.seq_id AND b.us >= a.us + {DAY} AND b.us < a.us + {2 * DAY} GROUP BY a.event_id)"))
def rpe_time(spark, sf_dir):
    return rpe(joins.ahead_in_time(pairs(spark, sf_dir), DAY, DAY, span=DAYS))


def lengths_sql(source):
    step = " + ".join(f"pow({p} - lag({p}) OVER w, 2)" for p in P)
    return f"SELECT seq_id, coalesce(sum(s), 0) AS length FROM (SELECT seq_id, sqrt({step}) AS s FROM {source} WINDOW w AS (PARTITION BY seq_id ORDER BY us)) GROUP BY seq_id"


@query(f"WITH {NEAR}, a AS ({lengths_sql('e')}), b AS ({lengths_sql('t')}) SELECT seq_id, round(a.length, 4) AS est, round(b.length, 4) AS true_length, round(CASE WHEN b.length <= 1e-6 THEN 1 ELSE a.length / b.length END, 6) AS ratio, round(a.length / nullif(b.length, 0), 6) AS raw_ratio FROM a JOIN b USING (seq_id)")
def path_length_ratio(spark, sf_dir):
    """Guarded ratio, and the unguarded one of the stand-alone recomputation."""
    est = metrics.path_length(estimates(spark, sf_dir), tuple(P), span=DAYS).withColumnRenamed("length", "est")
    true = metrics.path_length(truths(spark, sf_dir), tuple(P), span=DAYS).withColumnRenamed("length", "true_length")
    out = est.join(true, "seq_id").withColumn("ratio", metrics.length_ratio(F.col("est"), F.col("true_length"))).withColumn("raw_ratio", F.try_divide("est", "true_length"))
    return out.select("seq_id", F.round("est", 4).alias("est"), F.round("true_length", 4).alias("true_length"), F.round("ratio", 6).alias("ratio"), F.round("raw_ratio", 6).alias("raw_ratio"))


@query(f"WITH {NEAR} SELECT seq_id, count(*) AS n, round(var_pop(px) + var_pop(py) + var_pop(pz), 3) AS variance, " + ", ".join(f"round(covar_pop({T[i]}, {P[j]}), 3) AS c{i}{j}" for i in range(3) for j in range(3)) + " FROM pairs GROUP BY seq_id")
def umeyama_moments(spark, sf_dir):
    m = metrics.alignment_moments(pairs(spark, sf_dir), tuple(P), tuple(T), ["seq_id"])
    return m.select("seq_id", "n", F.round("variance", 3).alias("variance"), *(F.round(f"c{i}{j}", 3).alias(f"c{i}{j}") for i in range(3) for j in range(3)))


def aligned(spark, sf_dir, with_scale):
    rows = pairs(spark, sf_dir)
    fit = metrics.solve_alignment(metrics.alignment_moments(rows, tuple(P), tuple(T), ["seq_id"]), with_scale, ["seq_id"])
    error = g.norm(g.sub(g.vec("ax", "ay", "az"), g.vec(*T)))
    return summary(metrics.apply_alignment(rows, fit, tuple(P), ["seq_id"]).where("ax is not null"), error, ["seq_id"])


@query()
def umeyama_rigid(spark, sf_dir):
    return aligned(spark, sf_dir, False)


@query()
def umeyama_similarity(spark, sf_dir):
    return aligned(spark, sf_dir, True)


@query(f"WITH {EV} SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max, round(sum(value), 2) AS total FROM ev GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "value")
    out = order.summarize(rows, ["event_type"], metrics.latency_summary(F.col("value")), {"median": ("value", 0.5), "p95": ("value", 0.95)})
    return out.select("event_type", "count", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95")), "min", "max", F.round("total", 2).alias("total"))


@query(f"WITH {EV}, {POSED} SELECT event_type, " + ", ".join(f"{f}({p}) AS {f}_{p}" for p in P for f in ("min", "max")) + " FROM posed GROUP BY event_type")
def bounding_box(spark, sf_dir):
    return posed(events(spark, sf_dir)).groupBy("event_type").agg(*metrics.bounding_box(tuple(P)))


@query(f"""WITH {EV}, s AS (SELECT seq_id, value / 1.03::DOUBLE AS ax, k / 10.3::DOUBLE AS ay, value / 51 - 9.81::DOUBLE AS az FROM ev WHERE event_type <> 'view'),
 m AS (SELECT seq_id, count(*) AS n, avg(ax) AS ax, avg(ay) AS ay, avg(az) AS az FROM s GROUP BY seq_id HAVING count(*) >= 5),
 r AS (SELECT seq_id, n, atan2(-ay, -az) AS roll, atan2(ax, sqrt(ay * ay + az * az)) AS pitch FROM m)
 SELECT seq_id, n, round(cos(roll / 2) * cos(pitch / 2), 6) AS qw, round(sin(roll / 2) * cos(pitch / 2), 6) AS qx, round(cos(roll / 2) * sin(pitch / 2), 6) AS qy, round(-sin(roll / 2) * sin(pitch / 2), 6) AS qz FROM r""")
def gravity_levelling(spark, sf_dir):
    ok = g.finite(F.col("ax"), F.col("ay"), F.col("az"))
    m = samples(spark, sf_dir).where(ok).groupBy("seq_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("ax", "ay", "az"))).where("n >= 5")
    q = g.levelling(g.vec("ax", "ay", "az"))
    return m.select("seq_id", "n", *(F.round(c, 6).alias(n) for n, c in zip(("qw", "qx", "qy", "qz"), q, strict=True)))


@query(f"WITH {NEAR} SELECT seq_id, event_id, round(tvx - vx, 6) AS dvx, round(tvy - vy, 6) AS dvy, round(tvz - vz, 6) AS dvz FROM pairs")
def residual_target(spark, sf_dir):
    return pairs(spark, sf_dir).select("seq_id", "event_id", *(F.round(F.col(f"t{c}") - F.col(c), 6).alias(f"d{c}") for c in ("vx", "vy", "vz")))


REPORT = f"WITH {NEAR}, a AS (SELECT seq_id, sqrt(avg(pow(px - tx, 2))) AS base, sqrt(avg(pow(0.5 * (px - tx), 2) + 0.01)) AS hybrid FROM pairs GROUP BY seq_id)"


def two_errors(spark, sf_dir):
    d = F.col("px") - F.col("tx")
    return pairs(spark, sf_dir).groupBy("seq_id").agg(metrics.rmse(d).alias("base"), F.sqrt(F.avg(F.pow(0.5 * d, 2) + 0.01)).alias("hybrid"))


@query(REPORT + " SELECT seq_id, round(base, 6) AS base, round(hybrid, 6) AS hybrid, round(base - hybrid, 6) AS delta, round(100 * (base - hybrid) / greatest(abs(base), 1e-6), 4) AS percent FROM a")
def improvement_report(spark, sf_dir):
    delta = F.col("base") - F.col("hybrid")
    return two_errors(spark, sf_dir).select("seq_id", *rounded([("base", F.col("base")), ("hybrid", F.col("hybrid")), ("delta", delta)]), F.round(100 * delta / F.greatest(F.abs("base"), F.lit(1e-6)), 4).alias("percent"))


@query(REPORT + " SELECT seq_id, CASE WHEN abs(base - hybrid) <= 1 THEN 'PASS' ELSE 'FAIL' END AS verdict, bool_and(abs(base - hybrid) <= 1) OVER () AS all_pass FROM a")
def metric_comparison(spark, sf_dir):
    rows = two_errors(spark, sf_dir).withColumn("ok", F.abs(F.col("base") - F.col("hybrid")) <= 1)
    whole = rows.agg(F.bool_and("ok").alias("all_pass"))
    return rows.crossJoin(F.broadcast(whole)).select("seq_id", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("verdict"), "all_pass")



def _text(cols: dict[str, str]) -> str:
    return ", ".join(f"printf('%.{4 if n.endswith('deg') else 6}f', {c}) AS {n}" for n, c in cols.items())


TABLE = {"timestamp": "us * 1e-6::DOUBLE"} | {f"estimated_{a}": f"p{a}" for a in "xyz"} | {f"groundtruth_{a}": f"t{a}" for a in "xyz"} | {f"error_{a}": f"p{a} - t{a}" for a in "xyz"} | {"position_error": ERR, "orientation_error_deg": f"degrees(2 * acos(least(1.0::DOUBLE, abs({DOT}))))"}


@query(f"WITH {NEAR} SELECT seq_id, {_text(TABLE)} FROM pairs")
def error_table(spark, sf_dir):
    """The per-frame error table as it is written to CSV."""
    return files.error_rows(pairs(spark, sf_dir))


def _whole(x, name):
    return f"sqrt(avg({x} * {x})) AS {name}_rmse, avg({x}) AS {name}_mean, median({x}) AS {name}_median, max({x}) AS {name}_max"


def _turned(a):
    """Dot product of the turns, estimated and true, from the row's first orientation to its own."""
    parts = []
    for (w, x, y, z) in (("qw", "qx", "qy", "qz"), ("tw", "ti", "tj", "tk")):
        b = {c: f"{a}{c}" for c in (w, x, y, z)}
        parts.append((f"({b[w]}*{w} + {b[x]}*{x} + {b[y]}*{y} + {b[z]}*{z})", f"({b[w]}*{x} - {b[x]}*{w} - {b[y]}*{z} + {b[z]}*{y})", f"({b[w]}*{y} + {b[x]}*{z} - {b[y]}*{w} - {b[z]}*{x})", f"({b[w]}*{z} - {b[x]}*{y} + {b[y]}*{x} - {b[z]}*{w})"))
    return " + ".join(f"{e} * {t}" for e, t in zip(*parts, strict=True))


def _length(p, name):
    step = " + ".join(f"pow({c} - lag({c}) OVER w, 2)" for c in p)
    return f"(SELECT seq_id, coalesce(sum(s), 0) AS {name} FROM (SELECT seq_id, sqrt({step}) AS s FROM pairs WINDOW w AS (PARTITION BY seq_id ORDER BY us)) GROUP BY seq_id)"


def _ahead(name, ahead):
    body = rel_sql(ahead).split(",\n x AS ", 1)[1].rsplit("\n SELECT", 1)[0]
    return f"{name} AS (WITH {ahead}, x AS {body} SELECT seq_id, count(*) AS {name}_n, sqrt(avg(tr * tr)) AS {name}_translation_rmse, avg(ro) AS {name}_rotation_mean FROM x GROUP BY seq_id)"


#: The sum of C's singular values, the last signed by det C: the first by the closed form of the eigenvalues of
#: C'C, the sum of the others by the squared minors, as (s2 + s3)^2 = (minors - (det/s1)^2) / s1^2 + 2 det/s1.
MINORS = [f"pow(c{i}{k}*c{j}{l} - c{i}{l}*c{j}{k}, 2)" for i, j in ((0, 1), (0, 2), (1, 2)) for k, l in ((0, 1), (0, 2), (1, 2))]
ALIGN = f"""mo AS (SELECT seq_id, count(*) AS n, var_pop(px) + var_pop(py) + var_pop(pz) AS vs, var_pop(tx) + var_pop(ty) + var_pop(tz) AS vd, {', '.join(f'covar_pop({T[i]}, {P[j]}) AS c{i}{j}' for i in range(3) for j in range(3))} FROM pairs GROUP BY seq_id),
 gg AS (SELECT *, {', '.join(f'c0{i}*c0{j} + c1{i}*c1{j} + c2{i}*c2{j} AS g{i}{j}' for i in range(3) for j in range(i, 3))}, c00*(c11*c22 - c12*c21) - c01*(c10*c22 - c12*c20) + c02*(c10*c21 - c11*c20) AS det FROM mo WHERE n >= 3 AND vs >= 1e-12),
 ge AS (SELECT *, (g00 + g11 + g22) / 3 AS m FROM gg),
 gp AS (SELECT *, sqrt((pow(g00 - m, 2) + pow(g11 - m, 2) + pow(g22 - m, 2) + 2 * (g01*g01 + g02*g02 + g12*g12)) / 6) AS p FROM ge),
 gr AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((g00-m)*((g11-m)*(g22-m) - g12*g12) - g01*(g01*(g22-m) - g12*g02) + g02*(g01*g12 - (g11-m)*g02)) / nullif(2*p*p*p, 0)))) / 3 AS phi FROM gp),
 gs AS (SELECT *, sqrt(m + 2*p*cos(phi)) AS s1, {' + '.join(MINORS)} AS minors FROM gr),
 al AS (SELECT seq_id, vs, vd, s1 + sqrt(greatest(0.0::DOUBLE, (minors - pow(det / s1, 2)) / (s1*s1) + 2 * det / s1)) AS tr FROM gs)"""

DAY_AHEAD = f"h AS (SELECT a.event_id, arg_min(b.event_id, b.us) AS ahead_id FROM pairs a JOIN pairs b ON a.seq_id = b.seq_id AND b.us >= a.us + {DAY} AND b.us < a.us + {2 * DAY} GROUP BY a.event_id)"
ROW_AHEAD = "h AS (SELECT event_id, lead(event_id) OVER (PARTITION BY seq_id ORDER BY us) AS ahead_id FROM pairs)"
COARSE = ("rotation_mean", "orientation_", "drift_")


def _digits(c):
    return 3 if any(x in c for x in COARSE) else 4


MEASURES = [f"ate_{n}" for n in ("rmse", "mean", "median", "std", "min", "max", "final")] + [f"{n}_{a}" for a in "xyz" for n in ("rmse", "mae", "max")]
MEASURES += [f"{k}_{n}" for k in ("orientation", "drift", "velocity") for n in ("rmse", "mean", "median", "max")] + ["est_length", "true_length", "length_ratio"]
MEASURES += [f"{k}_{n}" for k in ("row", "day") for n in ("translation_rmse", "rotation_mean")] + ["rigid_rmse", "similarity_rmse", "similarity_scale"]
COUNTS = ["n_est", "n_true", "matched", "unmatched_est", "unmatched_true"]
AXES = ", ".join(f"sqrt(avg(({p} - {t}) * ({p} - {t}))) AS rmse_{a}, avg(abs({p} - {t})) AS mae_{a}, max(abs({p} - {t})) AS max_{a}" for p, t, a in zip(P, T, "xyz", strict=True))


@query(f"""WITH {NEAR}, st AS (SELECT seq_id, {', '.join(f'arg_min({c}, (us, event_id)) AS f{c}' for c in (*NAMES[6:], *TRUE[6:]))} FROM pairs GROUP BY seq_id),
 x AS (SELECT *, {ERR} AS pe, {VERR} AS ve, degrees(2 * acos(least(1.0::DOUBLE, abs({DOT})))) AS oe, degrees(2 * acos(least(1.0::DOUBLE, abs({_turned('f')})))) AS de FROM pairs JOIN st USING (seq_id)),
 a AS (SELECT seq_id, count(*) AS matched, count(DISTINCT other_id) AS used, {_whole('pe', 'ate')}, stddev_pop(pe) AS ate_std, min(pe) AS ate_min, arg_max(pe, (us, event_id)) AS ate_final, {AXES}, {_whole('oe', 'orientation')}, {_whole('de', 'drift')}, {_whole('ve', 'velocity')} FROM x GROUP BY seq_id),
 ne AS (SELECT seq_id, count(*) AS n_est FROM e GROUP BY 1), nt AS (SELECT seq_id, count(*) AS n_true FROM t GROUP BY 1),
 le AS {_length(P, 'est_length')}, lt AS {_length(T, 'true_length')}, {_ahead('row', ROW_AHEAD).replace('row AS', 'row_ AS', 1)}, {_ahead('day', DAY_AHEAD).replace('day AS', 'day_ AS', 1)}, {ALIGN},
 o AS (SELECT *, n_est - matched AS unmatched_est, n_true - used AS unmatched_true, CASE WHEN true_length <= 1e-6 THEN 1 ELSE est_length / true_length END AS length_ratio,
  CASE WHEN tr IS NOT NULL THEN sqrt(greatest(0.0::DOUBLE, vs + vd - 2 * tr)) END AS rigid_rmse, CASE WHEN tr IS NOT NULL THEN sqrt(greatest(0.0::DOUBLE, vd - tr * tr / vs)) END AS similarity_rmse, tr / vs AS similarity_scale
  FROM a JOIN ne USING (seq_id) JOIN nt USING (seq_id) JOIN le USING (seq_id) JOIN lt USING (seq_id) LEFT JOIN row_ USING (seq_id) LEFT JOIN day_ USING (seq_id) LEFT JOIN al USING (seq_id))
 SELECT seq_id, {', '.join(COUNTS)}, {', '.join(f'round({c}, {_digits(c)}) AS {c}' for c in MEASURES)}, row_n, day_n FROM o""")
def evaluation_report(spark, sf_dir):
    """Every measure of each sequence in one row."""
    rows = saved(pairs(spark, sf_dir))
    ahead = {"row": joins.ahead_by_rows(rows, 1, DAYS), "day": joins.ahead_in_time(rows, DAY, DAY, span=DAYS)}
    out = metrics.evaluation(rows, estimates(spark, sf_dir), truths(spark, sf_dir), ahead, DAYS)
    return out.select("seq_id", *COUNTS, *(F.round(c, _digits(c)).alias(c) for c in MEASURES), "row_n", "day_n")
