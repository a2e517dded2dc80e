"""How filters interact: what each removes, alone and in every order, from counts of rows by failed filters.

Words are exploded and aggregated to (document, word), then to the document; other flags are outer-joined;
then one aggregation counts every combination of failed filters in a column of its own. What any order of the
filters does follows from those columns. All of it is DataFrame functions.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = 1 << len(FILTERS)
ORDERS = factorial(len(FILTERS))
WORD_BREAK = r"[\x20\x09-\x0D]+"
MARKS = "#$%&*|"
#: What is counted for each combination: all rows, those of good quality, toxic ones.
COUNTED = ("n", "good", "toxic")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_id` and `_hash`, never null, of id and whole text: rows that share both have equal texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return rows.withColumns({"_id": F.coalesce("doc_id", F.lit(0).cast("long")), "_hash": F.xxhash64(F.col("doc_id").isNull(), "text")})


def word_totals(rows: DataFrame) -> DataFrame:
    """_id, _hash, words, distinct_words of each document.

    Each text comes with one null besides its words, so wordless texts stay, and a document that comes in
    several equal rows is counted once.  Texts are dealt by document before they are exploded, so that no
    word is shuffled.
    """
    words = rows.select("_id", "_hash", "text").repartition("_id", "_hash")
    words = words.select("_id", "_hash", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("text", WORD_BREAK))).alias("word"))
    words = words.where(F.col("word").isNull() | (F.col("word") != ""))
    by_word = words.groupBy("_id", "_hash", "word").agg(F.count(F.lit(1)).alias("n"))
    copies = F.max(F.when(F.col("word").isNull(), F.col("n")))
    totals = by_word.groupBy("_id", "_hash").agg(F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("_all"), F.count("word").alias("distinct_words"), copies.alias("_copies"))
    return totals.select("_id", "_hash", F.expr("_all div _copies").alias("words"), "distinct_words")


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: whether any label of a document says so."""
    says = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (filters failed but the last, one bit each), copy (fails the last), n, good, toxic: numbers of rows.

    A, under 200 words; B, fewer than half of the words distinct; C, over 3 % of code points capitals; D, a
    mark; E, a text that a smaller doc_id has too. Rows of null doc_id are copies where any row has their
    text and an id. Copies need no join with their first: rows are added up by text and by what else is
    counted, then each text's least doc_id is looked for among those few sums, so a group of any size meets
    in map-side sums.
    """
    rows = keyed(docs)
    flags = rows.select(
        "_id",
        "_hash",
        "doc_id",
        "part",
        F.sha2("text", 256).alias("same"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text")).alias("C"),
        F.col("text").rlike(f"[{MARKS}]").alias("D"),
    )
    flags = flags.join(marked(labels), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    both = flags.join(word_totals(rows), ["_id", "_hash"], "full_outer")  # each side has every document
    a, b = F.col("words") < 200, 100 * F.col("distinct_words") < 50 * F.col("words")
    mask = sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate((a, b, F.col("C"), F.col("D")))), F.lit(0))
    same = both.select("same", "part", mask.alias("mask"), "good", "toxic", "doc_id")
    kinds = same.groupBy("same", "part", "mask", "good", "toxic", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("head"))
    texts = kinds.groupBy("same").agg(F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "head")).alias("kinds"), F.min("head.doc_id").alias("first"))
    # few kinds a text: its languages times its labels
    kinds = texts.select("first", F.inline("kinds"))
    firsts = F.when(F.col("first").isNull(), F.col("n")).when(F.col("head.doc_id") == F.col("first"), F.col("head.n")).otherwise(0)
    split = kinds.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(False).alias("copy"), firsts.alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("n") - firsts).alias("n")))).alias("s"))
    split = split.select("part", "mask", "good", "toxic", "s.copy", "s.n").where("n > 0")
    return split.groupBy("part", "mask", "copy").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in COUNTED[1:]))


def combination_counts(failed: DataFrame) -> DataFrame:
    """part and, for all rows, good ones and toxic ones, 32 columns: rows that fail exactly those filters."""
    mask = F.col("mask") + F.when(F.col("copy"), 1 << (len(FILTERS) - 1)).otherwise(0)
    return failed.groupBy("part").agg(*(F.sum(F.when(mask == m, F.col(c)).otherwise(0)).alias(f"{c}_{m}") for c in COUNTED for m in range(ALL)))


def audit_orders(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: what each
    step of every order of the filters does, from combination_counts.

    A row that fails k filters is removed by each of them in 1/k of the orders. Of a part's columns there is a
    row for each combination, which meets every step of every order: 19,200 rows a part.
    """
    combos = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(ORDERS // max(1, m.bit_count())).cast("long").alias("turns"), *(F.col(f"{c}_{m}").alias(c) for c in COUNTED)) for m in range(ALL)))
    rows = counts.select("part", F.inline(combos))
    rows = rows.withColumn("filter_order", F.explode(F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda text: sum((F.when(F.contains(text, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"own": bits(F.substr("filter_order", F.col("step"), F.lit(1))), "before": bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    m = F.col("m")
    fails, gone, alone = m.bitwiseAND(F.col("own")) != 0, m.bitwiseAND(F.col("before")) != 0, m == F.col("own")
    total = lambda test, x: F.sum(F.when(test, x).otherwise(F.lit(0).cast("long")))
    measures = {
        "kept": total(~fails & ~gone, F.col("n")),
        "removed": total(fails & ~gone, F.col("n")),
        "redundant": total(fails & gone, F.col("n")),
        "unique_fails": total(alone, F.col("n")),
        "good_lost": total(fails & ~gone, F.col("good")),
        "toxic_lost": total(fails & ~gone, F.col("toxic")),
        "shapley": total(fails, F.col("n") * F.col("turns")),
    }
    out = rows.groupBy("part", "filter_order", "step").agg(*(c.alias(n) for n, c in measures.items()))
    return out.withColumn("step", F.col("step").cast("int"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over docs (doc_id, text, lang) and labels (doc_id, quality, toxic).

    Every row of docs counts, repeated ones too; equal rows aren't copies of each other, only of a smaller
    doc_id. Null texts are empty: they fail A alone of the first four. Null languages make the part "", null
    doc_ids have no labels. Texts are split whole, whatever their length. An empty table has no parts and so no
    rows; labels may be empty. Other columns aren't read, whatever their names.
    """
    return audit_orders(combination_counts(failures(docs, labels)))


AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
 w AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
 l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': w.doc_id > first} AS bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
 k AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN bad.A WHEN 'B' THEN bad.B WHEN 'C' THEN bad.C WHEN 'D' THEN bad.D ELSE bad.E END) AS fails,
   count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
 s AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
 r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS kept,
   coalesce(sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS removed,
   coalesce(sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, before)), 0) AS redundant,
   coalesce(sum(n) FILTER (fails = [own]), 0) AS unique_fails,
   coalesce(sum(good) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS good_lost,
   coalesce(sum(toxic) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS toxic_lost FROM k, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
