"""Mixing sources to target weights by iterative proportional fitting; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import Workspace

DIMENSIONS = ("source", "lang", "topic")
#: Rounds over the three marginals.
ROUNDS = 8


def topic_of(text: Column) -> Column:
    """A coarse topic by form, for tables without a topic of their own."""
    return (
        F.when(F.instr(text, "|") > 0, "tables")
        .when(F.instr(text, "icense") > 0, "legal")
        .when(F.instr(text, "@") > 0, "contact")
        .when(F.length(text) < 500, "notes")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """About four characters make a token; one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4.0)).cast("long")


def filled(df: DataFrame, value: str, most: str, goal: str, by: list[str]) -> DataFrame:
    """value scaled by one factor for each group, but to `most` at most, so that its sum is the group's goal.

    In order of most / value, the rows up to some place are at their most; the factor of the rest is the
    greatest of what each place would give.
    """
    group, order = Window.partitionBy(*by), F.coalesce(F.try_divide(most, value), F.lit(float("inf")))
    before = Window.partitionBy(*by).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.withColumn("_order", order).withColumns({"_full": F.coalesce(F.sum(most).over(before), F.lit(0.0)), "_rest": F.sum(value).over(group) - F.coalesce(F.sum(value).over(before), F.lit(0.0))})
    factor = F.max(F.when(F.col(value) > 0, F.try_divide(F.col(goal) - F.col("_full"), F.greatest("_rest", value)))).over(group)
    out = sums.withColumn("_factor", factor)
    return out.withColumn(value, F.least(F.col(most), F.col(value) * F.coalesce("_factor", F.lit(0.0)))).drop("_order", "_full", "_rest", "_factor")


def raked(cells: DataFrame, share: float, power: float, rounds: int, targets: dict[str, DataFrame] | None = None, ws: Workspace | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight, and the marginals to_source, to_lang, to_topic it is fitted to.

    The target share of a value is given in targets[dimension] (value, share), or else its token share to
    the given power, made to sum to one. No weight exceeds tokens / share, so that share * weight / tokens
    is a probability: a value whose target is more than all its tokens takes them all, and what is over
    goes to the others. Each round fits the weights to one marginal after another under these bounds.
    """
    ws = ws or Workspace(cells.sparkSession)
    out = cells.withColumns({"weight": F.col("tokens").cast("double"), "most": F.col("tokens") / share})
    for d in DIMENSIONS:
        marginal = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("n"))
        if targets and d in targets:
            marginal = marginal.join(targets[d].select(F.coalesce(F.col("value"), F.lit("")).alias(d), F.col("share").alias(f"to_{d}")), d, "left").fillna(0.0, [f"to_{d}"])
        else:
            marginal = marginal.withColumn(f"to_{d}", F.pow("n", F.lit(power)))
        marginal = marginal.withColumns({"most": F.col("n") / share, "all": F.sum("n").over(Window.partitionBy())})
        out = out.join(filled(marginal, f"to_{d}", "most", "all", []).select(d, f"to_{d}"), d)
    out = ws.save(out)
    for n in range(rounds):
        for d in DIMENSIONS:
            out = filled(out, "weight", "most", f"to_{d}", [d])
        if n % 4 == 3:  # keeps plans short
            out = ws.save(out)
    return out.select(*DIMENSIONS, "tokens", "weight", *(f"to_{d}" for d in DIMENSIONS))


def residuals(fitted: DataFrame) -> DataFrame:
    """dimension, value, target, fitted: how near the weights of raked() come to each marginal, in tokens."""
    parts = [fitted.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.first(f"to_{d}").alias("target"), F.sum("weight").alias("fitted")) for d in DIMENSIONS]
    return parts[0].union(parts[1]).union(parts[2])


def lot(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the document's id (its text where that is null) and the seed."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.md5(text)), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_sources(docs: DataFrame, share: float = 0.5, power: float = 0.7, rounds: int = ROUNDS, seed: int = 17, targets: dict[str, DataFrame] | None = None, tokens: Column | None = None, topic: Column | None = None) -> DataFrame:
    """The rows of docs with _topic, _tokens, _weight, _probability, _chosen added; a name that docs has already,
    in either case, gets another underscore in front.

    _weight is the factor by which a cell's tokens are to count after raking to source, language and topic
    marginals; a row is chosen with probability share * _weight, which is never above 1, by a lot drawn
    from its id. So the expected tokens are `share` of all, dealt by the marginals, as far as they have the
    tokens. Null texts count as empty, null sources and languages are values of their own. Rows with equal
    ids share their lot, so they come or go together where their cells agree. Long texts count whole; docs'
    own columns stay as they are, whatever their names. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": F.coalesce(topic if topic is not None else topic_of(text), F.lit(""))}
    count = tokens if tokens is not None else tokens_of(text)
    cells = docs.select(*(c.alias(d) for d, c in key.items()), count.alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    # one row for each source, language and topic that occur together; saved, so that its size is known
    fitted = ws.save(raked(ws.save(cells), share, power, rounds, targets, ws))
    factor = fitted.select(*DIMENSIONS, F.round(F.col("weight") / F.col("tokens"), 8).alias("weight"))
    # docs' columns travel as one, so that none can be taken for one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(c.alias(d) for d, c in key.items()), count.alias("tokens"), lot(F.col("doc_id"), text, seed).alias("lot"))
    probability = F.round(F.least(F.lit(1.0), share * F.col("weight")), 8)
    added = {"_topic": F.col("topic"), "_tokens": F.col("tokens"), "_weight": F.col("weight"), "_probability": probability, "_chosen": F.col("lot") < probability}
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name = "_" + name
        return name

    return rows.join(factor, list(DIMENSIONS)).select("doc.*", *(c.alias(free(n)) for n, c in added.items()))


def filled_sql(name: str, source: str, value: str, most: str, goal: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    before = f"OVER ({part} ORDER BY coalesce({most} / nullif({value}, 0), 'Infinity'::DOUBLE) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name} AS (SELECT * EXCLUDE (_full, _rest, _factor) REPLACE (least({most}, {value} * coalesce(_factor, 0)) AS {value}) FROM (
  SELECT *, max(CASE WHEN {value} > 0 THEN ({goal} - _full) / nullif(greatest(_rest, {value}), 0) END) OVER ({part}) AS _factor FROM (
  SELECT *, coalesce(sum({most}) {before}, 0) AS _full, sum({value}) OVER ({part}) - coalesce(sum({value}) {before}, 0) AS _rest FROM {source})))"""


def mixing_sql(share: float = 0.5, power: float = 0.7, rounds: int = ROUNDS, seed: int = 17, docs: str = "documents") -> str:
    """The same in SQL, its rounds unrolled."""
    parts = [
        f"""rows0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN instr(coalesce(text, ''), '|') > 0 THEN 'tables' WHEN instr(coalesce(text, ''), 'icense') > 0 THEN 'legal'
         WHEN instr(coalesce(text, ''), '@') > 0 THEN 'contact' WHEN length(coalesce(text, '')) < 500 THEN 'notes' ELSE 'prose' END AS topic,
    greatest(1, ceil(length(coalesce(text, '')) / 4.0::DOUBLE))::BIGINT AS tokens,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '-{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS lot
  FROM {docs})""",
        "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows0 GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"n_{d} AS (SELECT {d}, sum(tokens) AS n, pow(sum(tokens), {power}) AS to_{d}, sum(tokens) / {share}::DOUBLE AS most, sum(sum(tokens)) OVER () AS everything FROM cells GROUP BY {d})")
        parts.append(filled_sql(f"m_{d}", f"n_{d}", f"to_{d}", "most", "everything"))
    goals = " ".join(f"JOIN (SELECT {d}, to_{d} FROM m_{d}) USING ({d})" for d in DIMENSIONS)
    parts.append(f"w0 AS (SELECT *, tokens AS weight, tokens / {share}::DOUBLE AS most FROM cells {goals})")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            parts.append(filled_sql(f"w{n + 1}", f"w{n}", "weight", "most", f"to_{d}", d))
            n += 1
    parts.append(f"factor AS (SELECT source, lang, topic, round(weight / tokens, 8) AS weight FROM w{n})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, tokens AS n_tokens, round(weight, 6) AS weight, round(least(1.0::DOUBLE, {share} * weight), 6) AS probability,
  lot < round(least(1.0::DOUBLE, {share} * weight), 8) AS chosen
FROM rows0 JOIN factor USING (source, lang, topic)"""
