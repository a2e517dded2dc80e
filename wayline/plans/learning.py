"""Queries on features, scaling, scoring and training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import joins, learning, metrics, prefix
from ..operators.tables import saved
from .common import DAYS, EV, NEAR, POSED, SYNC, TOLERANCE, events, pairs, posed, query, synced, truths

INPUTS = [f"x{i}" for i in range(18)]
X = "x AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(INPUTS)) + " FROM embeddings)"
STATS = "st AS (SELECT " + ", ".join(f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) < 1e-4 THEN 1 ELSE stddev_pop({c}) END AS std_{c}" for c in INPUTS) + " FROM x)"
SCALED = "z AS (SELECT vec_id, " + ", ".join(f"({c} - mean_{c}) / std_{c} AS {c}" for c in INPUTS) + " FROM x CROSS JOIN st)"


def inputs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(INPUTS)))


@query(f"WITH {X}, {STATS} SELECT " + ", ".join(f"round(mean_{c}, 6) AS mean_{c}, round(std_{c}, 6) AS std_{c}" for c in INPUTS) + " FROM st")
def scaler_fit(spark, sf_dir):
    out = learning.scaler_stats(inputs(spark, sf_dir), INPUTS)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"WITH {X}, {STATS}, {SCALED} SELECT vec_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in INPUTS) + " FROM z")
def scaler_transform(spark, sf_dir):
    rows = inputs(spark, sf_dir)
    out = learning.scaled(rows, learning.scaler_stats(rows, INPUTS), INPUTS)
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in INPUTS))


def layer_sql(source: str, name: str, w: np.ndarray, b: np.ndarray, relu: bool) -> str:
    units = []
    for row, bias in zip(w, b, strict=True):
        dot = f"list_dot_product({source}, [{', '.join(f'{v}::DOUBLE' for v in row)}]) + ({bias})"
        units.append(f"greatest({dot}, 0)" if relu else dot)
    return f"[{', '.join(units)}] AS {name}"


W = learning.seeded_weights()
MLP = f"""{X}, {STATS}, {SCALED}, v AS (SELECT vec_id, [{', '.join(INPUTS)}] AS v FROM z),
 h1 AS (SELECT vec_id, {layer_sql('v', 'h', W['shared.0.weight'], W['shared.0.bias'], True)} FROM v),
 h2 AS (SELECT vec_id, {layer_sql('h', 'h', W['shared.2.weight'], W['shared.2.bias'], True)} FROM h1),
 o AS (SELECT vec_id, {layer_sql('h', 'dv', W['residual_head.weight'], W['residual_head.bias'], False)}, {layer_sql('h', 'lg', W['confidence_head.0.weight'], W['confidence_head.0.bias'], False)} FROM h2),
 m AS (SELECT vec_id, dv[1] AS dvx, dv[2] AS dvy, dv[3] AS dvz, 1 / (1 + exp(-greatest(-15, least(15, lg[1])))) AS confidence FROM o)"""


def scored(spark, sf_dir):
    rows = inputs(spark, sf_dir)
    z = learning.scaled(rows, learning.scaler_stats(rows, INPUTS), INPUTS)
    return learning.network(z.select("vec_id", F.array(*INPUTS).alias("v")), "v", W)


OUT = ["dvx", "dvy", "dvz", "confidence"]


@query(f"WITH {MLP} SELECT vec_id, {', '.join(f'round({c}, 6) AS {c}' for c in OUT)} FROM m")
def mlp_forward(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", *(F.round(c, 6).alias(c) for c in OUT))


@query(f"WITH {MLP}, g AS (SELECT *, CASE WHEN confidence <= 0.2 THEN 0 WHEN confidence < 0.5 THEN (confidence - 0.2) / 0.3 ELSE 1 END AS s FROM m) SELECT vec_id, {', '.join(f'round(greatest(-3, least(3, {c})) * s, 6) AS {c}' for c in OUT[:3])}, round(confidence, 6) AS confidence FROM g")
def confidence_gate(spark, sf_dir):
    dv, c = learning.gate(tuple(F.col(c) for c in OUT[:3]), F.col("confidence"))
    return scored(spark, sf_dir).select("vec_id", *(F.round(x, 6).alias(n) for n, x in zip(OUT[:3], dv, strict=True)), F.round(c, 6).alias("confidence"))


def featured(spark, sf_dir):
    """The 18 features of each frame: interval statistics and the state at the frame."""
    rows = synced(spark, sf_dir)
    stats = learning.interval_stats(F.col("samples"), ["ax", "ay", "az", "wx", "wy", "wz"], lambda kind, c: f"{kind}_{c}")
    state = posed(events(spark, sf_dir).where("event_type = 'view'")).select("seq_id", "us", "event_id", "k", "vx", "vy", "vz")
    rows = rows.select("seq_id", "us", *(c.alias(n) for n, c in stats.items() if not n.startswith("var_w")))
    rows = learning.with_steps(rows, DAYS, "step").drop("prev_us").join(state, ["seq_id", "us"])
    ok = F.col("k") % 4 > 0
    rows = rows.withColumns(
        {
            "tracked_features": F.when(ok, F.col("k").cast("double")).otherwise(0.0),
            "inlier_ratio": F.when(ok, 0.8).otherwise(0.0),
            "mean_flow": F.lit(0.0),
            "std_flow": F.lit(0.0),
            "speed": F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2),
            "dt": F.greatest(F.lit(1e-4), F.least(F.lit(1.0), F.col("step"))),
        }
    )
    return rows.select("seq_id", "us", "event_id", *learning.FEATURES)


RAW = f"""a AS (SELECT seq_id, us, {', '.join(f'coalesce(avg({c}), 0) AS mean_{c}' for c in ('ax', 'ay', 'az', 'wx', 'wy', 'wz'))}, {', '.join(f'coalesce(var_pop({c}), 0) AS var_{c}' for c in ('ax', 'ay', 'az'))} FROM j GROUP BY seq_id, us),
 p AS (SELECT *, CASE WHEN (us - lag(us) OVER (PARTITION BY seq_id ORDER BY us)) IS NULL THEN 0.05 ELSE greatest((us - lag(us) OVER (PARTITION BY seq_id ORDER BY us)) * 1e-6, 1e-4) END AS step FROM posed WHERE event_type = 'view'),
 raw AS (SELECT p.seq_id, p.us, p.event_id, px, py, pz, CASE WHEN k % 4 > 0 THEN k ELSE 0 END::DOUBLE AS tracked_features, CASE WHEN k % 4 > 0 THEN 0.8::DOUBLE ELSE 0 END AS inlier_ratio, 0::DOUBLE AS mean_flow, 0::DOUBLE AS std_flow,
 {', '.join(learning.FEATURES[4:16])}, sqrt(vx * vx + vy * vy + vz * vz) AS speed, greatest(1e-4, least(1.0::DOUBLE, step)) AS dt FROM p JOIN a USING (seq_id, us))"""


@query(f"WITH {SYNC}, {POSED}, {RAW} SELECT event_id, tracked_features, inlier_ratio, mean_flow, std_flow, {', '.join(f'round({c}, 5) AS {c}' for c in learning.FEATURES[4:])} FROM raw")
def feature_rows(spark, sf_dir):
    keep = ["tracked_features", "inlier_ratio", "mean_flow", "std_flow"]
    return featured(spark, sf_dir).select("event_id", *keep, *(F.round(c, 5).alias(c) for c in learning.FEATURES if c not in keep))


@query(f"WITH {NEAR}, s AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY us) AS r, count(*) OVER (PARTITION BY seq_id) AS n FROM pairs) SELECT CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part, count(*) AS rows, round(avg(tvx - vx), 6) AS mean_dvx, round(avg(tvy - vy), 6) AS mean_dvy FROM s GROUP BY 1")
def training_set(spark, sf_dir):
    rows = learning.chronological(pairs(spark, sf_dir), span=DAYS).withColumns({"dvx": F.col("tvx") - F.col("vx"), "dvy": F.col("tvy") - F.col("vy")})
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.round(F.avg("dvx"), 6).alias("mean_dvx"), F.round(F.avg("dvy"), 6).alias("mean_dvy"))



#: The frames' states with the nearest true ones, as NEAR has them for the estimates.
FRAMES_NEAR = NEAR.replace("event_type = 'click'", "event_type = 'view'")
RAW_TOO = f"{SYNC.removeprefix(EV + ',').replace('f AS (', 'fr AS (').replace('FROM f ', 'FROM fr f ').replace('s AS (SELECT seq_id, us, event_id, value', 'sa AS (SELECT seq_id, us, event_id, value').replace('JOIN s ON', 'JOIN sa s ON')}, {RAW}"
RESIDUALS = [f"d{c}" for c in ("vx", "vy", "vz")]


def training_examples(spark, sf_dir):
    """seq_id, us, event_id, part, the 18 features scaled by the train part, and the velocity residuals of
    every frame with a true state near it."""
    state = posed(events(spark, sf_dir).where("event_type = 'view'")).select("seq_id", "us", "vx", "vy", "vz")
    near = joins.nearest_asof(state, truths(spark, sf_dir), TOLERANCE, span=DAYS).where("other is not null")
    residual = near.select("seq_id", "us", *((F.col(f"other.v{a}") - F.col(f"v{a}")).alias(f"dv{a}") for a in "xyz"))
    rows = saved(learning.chronological(featured(spark, sf_dir).join(residual, ["seq_id", "us"]), span=DAYS))
    return learning.scaled(rows, learning.scaler_stats(rows.where("part = 'train'"), learning.FEATURES), learning.FEATURES)


@query(f"""WITH {FRAMES_NEAR}, {RAW_TOO},
 ex AS (SELECT raw.*, tvx - pairs.vx AS dvx, tvy - pairs.vy AS dvy, tvz - pairs.vz AS dvz, row_number() OVER w AS r, count(*) OVER (PARTITION BY raw.seq_id) AS n FROM raw JOIN pairs ON pairs.event_id = raw.event_id WINDOW w AS (PARTITION BY raw.seq_id ORDER BY raw.us)),
 parted AS (SELECT *, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM ex),
 st AS (SELECT {', '.join(f"avg({c}) AS mean_{c}_, CASE WHEN stddev_pop({c}) < 1e-4 THEN 1 ELSE stddev_pop({c}) END AS std_{c}_" for c in learning.FEATURES)} FROM parted WHERE part = 'train')
 SELECT event_id, part, {', '.join(f'round(({c} - mean_{c}_) / std_{c}_, 4) AS {c}' for c in learning.FEATURES)}, {', '.join(f'round({c}, 6) AS {c}' for c in RESIDUALS)} FROM parted CROSS JOIN st""")
def training_rows(spark, sf_dir):
    rows = training_examples(spark, sf_dir)
    return rows.select("event_id", "part", *(F.round(c, 4).alias(c) for c in learning.FEATURES), *(F.round(c, 6).alias(c) for c in RESIDUALS))


@query()
def training_losses(spark, sf_dir):
    """Losses by epoch of the network fitted to the whole train part."""
    rows = saved(training_examples(spark, sf_dir).where("part = 'train'").select(*learning.FEATURES, *RESIDUALS))
    _, losses = learning.train_rows(rows, learning.FEATURES, RESIDUALS, epochs=15)
    return spark.createDataFrame([(i, v) for i, v in enumerate(losses)], "epoch int, loss double")


H = ("x", "y", "z")


@query(f"""WITH {FRAMES_NEAR}, {RAW_TOO},
 st AS (SELECT {', '.join(f"avg({c}) AS mean_{c}_, CASE WHEN stddev_pop({c}) < 1e-4 THEN 1 ELSE stddev_pop({c}) END AS std_{c}_" for c in learning.FEATURES)} FROM raw),
 v AS (SELECT event_id, [{', '.join(f'({c} - mean_{c}_) / std_{c}_' for c in learning.FEATURES)}] AS v FROM raw CROSS JOIN st),
 h1 AS (SELECT event_id, {layer_sql('v', 'h', W['shared.0.weight'], W['shared.0.bias'], True)} FROM v),
 h2 AS (SELECT event_id, {layer_sql('h', 'h', W['shared.2.weight'], W['shared.2.bias'], True)} FROM h1),
 o AS (SELECT event_id, {layer_sql('h', 'dv', W['residual_head.weight'], W['residual_head.bias'], False)}, {layer_sql('h', 'lg', W['confidence_head.0.weight'], W['confidence_head.0.bias'], False)} FROM h2),
 c AS (SELECT event_id, dv, 1 / (1 + exp(-greatest(-15, least(15, lg[1])))) AS confidence FROM o),
 g AS (SELECT event_id, dv, CASE WHEN confidence <= 0.2 THEN 0 WHEN confidence < 0.5 THEN (confidence - 0.2) / 0.3 ELSE 1 END AS share FROM c),
 m AS (SELECT p.seq_id, p.us, p.event_id, step, {', '.join(f'p.p{a}, p.v{a} + greatest(-3, least(3, dv[{i + 1}])) * share AS hv{a}' for i, a in enumerate(H))} FROM p JOIN g USING (event_id)),
 mp AS (SELECT *, {', '.join(f'first_value(p{a}) OVER w + sum(hv{a} * step) OVER w - first_value(hv{a} * step) OVER w AS hp{a}' for a in H)} FROM m WINDOW w AS (PARTITION BY seq_id ORDER BY us)),
 e2 AS (SELECT pairs.seq_id, sqrt({' + '.join(f'pow(pairs.p{a} - t{a}, 2)' for a in H)}) AS b, sqrt({' + '.join(f'pow(hp{a} - t{a}, 2)' for a in H)}) AS h, sqrt({' + '.join(f'pow(v{a} - tv{a}, 2)' for a in H)}) AS bv, sqrt({' + '.join(f'pow(hv{a} - tv{a}, 2)' for a in H)}) AS hv FROM pairs JOIN mp USING (event_id)),
 r AS (SELECT seq_id, count(*) AS n, sqrt(avg(b*b)) AS base_ate, sqrt(avg(h*h)) AS hybrid_ate, sqrt(avg(bv*bv)) AS base_velocity, sqrt(avg(hv*hv)) AS hybrid_velocity FROM e2 GROUP BY seq_id)
 SELECT seq_id, n, {', '.join(f'round({k}_{m}, 3) AS {k}_{m}' for m in ('ate', 'velocity') for k in ('base', 'hybrid'))}, {', '.join(f'round(100 * (base_{m} - hybrid_{m}) / greatest(abs(base_{m}), 1e-6), 2) AS {m}_percent' for m in ('ate', 'velocity'))} FROM r""")
def hybrid_report(spark, sf_dir):
    """Frames' trajectories as they are and with the network's gated velocity corrections, both held against the truth."""
    state = posed(events(spark, sf_dir).where("event_type = 'view'")).select("seq_id", "us", "event_id", *(f"{k}{a}" for k in "pv" for a in H))
    state = learning.with_steps(state, DAYS, "step")
    rows = saved(featured(spark, sf_dir))
    z = learning.scaled(rows, learning.scaler_stats(rows, learning.FEATURES), learning.FEATURES)
    dv, _ = learning.gate(tuple(F.col(c) for c in OUT[:3]), F.col("confidence"))
    out = learning.network(z.select("event_id", F.array(*learning.FEATURES).alias("v")), "v", W).select("event_id", *(d.alias(f"g{a}") for a, d in zip(H, dv, strict=True)))
    moved = state.join(out, "event_id").withColumns({f"hv{a}": F.col(f"v{a}") + F.col(f"g{a}") for a in H})
    later = lambda a: F.when(F.col("prev_us").isNotNull(), F.col(f"hv{a}") * F.col("step")).otherwise(0.0)
    moved = prefix.scan(saved(moved), DAYS, start=prefix.first_value(F.struct(*(f"p{a}" for a in H))), **{f"gone{a}": prefix.running_sum(later(a)) for a in H})
    moved = moved.withColumns({f"hp{a}": F.col(f"start.p{a}") + F.col(f"gone{a}") for a in H})
    near = joins.nearest_asof(moved, truths(spark, sf_dir), TOLERANCE, span=DAYS).where("other is not null")
    error = lambda mine, true: metrics.rmse(F.sqrt(sum(((F.col(f"{mine}{a}") - F.col(f"other.{true}{a}")) ** 2 for a in H), F.lit(0.0))))
    kinds = {"base_ate": ("p", "p"), "hybrid_ate": ("hp", "p"), "base_velocity": ("v", "v"), "hybrid_velocity": ("hv", "v")}
    got = near.groupBy("seq_id").agg(F.count("*").alias("n"), *(error(*of).alias(name) for name, of in kinds.items()))
    gain = lambda m: F.round(100 * (F.col(f"base_{m}") - F.col(f"hybrid_{m}")) / F.greatest(F.abs(f"base_{m}"), F.lit(1e-6)), 2).alias(f"{m}_percent")
    return got.select("seq_id", "n", *(F.round(c, 3).alias(c) for c in kinds), gain("ate"), gain("velocity"))
