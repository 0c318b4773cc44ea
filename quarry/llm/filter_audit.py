"""Filter interaction audit: every order of five filters, replayed on every document.

A document's flags say which filters it fails.  They are crossed with the 120 orders
(a broadcast table of that many rows); the first failure of an order is the least
place of a failing filter; the order's five steps are exploded, and conditional sums
by part, order and step, combined on the map side, say what each step does.  The
filters see the whole text: four by expressions on it, the fifth by the least id that
has the same text anywhere in the table, told by its SHA-256.

Defined results: a null text counts as empty; a null lang is part ""; a null doc_id
has no smaller ids and is none; rows of one id and text are no copies of each other;
of several labels of an id the greatest counts; very long texts are like any other;
repeated rows count as often as they are there; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import gathered, staged, table

FILTERS = "ABCDE"
#: Words are runs of anything but these.
BLANKS = r"[\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
MARKS = "[#$%&*|]"


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): one row per document; true: it fails that filter."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    rows = gathered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n, kinds = F.size("words"), F.size(F.array_distinct("words"))
    rows = rows.select(
        "doc_id", "part", (n < LEAST_WORDS).alias("A"), (100 * kinds.cast("long") < DISTINCT_PERCENT * n.cast("long")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > CAPITALS_PERCENT * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(MARKS).alias("D"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    rows = staged(rows, "audit-flags")
    # tables of their own, so that a join can split the rows of a frequent text or id
    first = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first"), "audit-first", narrow=True)
    known = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = staged(known, "audit-labels", narrow=True)
    rows = rows.join(first, "digest", "left").join(known, "doc_id", "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.select("part", "A", "B", "C", "D", later.alias("E"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, at_A, at_B, ...): every order, and each filter's place in it, from 1."""
    found = ["".join(p) for p in itertools.permutations(filters)]
    return spark.createDataFrame([(o, *(o.index(x) + 1 for x in filters)) for o in found], "filter_order string, " + ", ".join(f"at_{x} int" for x in filters))


def replayed(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    flags = flags.withColumn("n_fails", reduce(add, (F.col(x).cast("int") for x in filters)))
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession, filters)))  # 120 rows
    never = len(filters) + 1
    first = F.least(*(F.when(F.col(x), F.col(f"at_{x}")).otherwise(never) for x in filters))
    steps = crossed.withColumn("first", first).withColumn("step", F.explode(F.array(*(F.lit(i) for i in range(1, never)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    fails = reduce(lambda found, x: found | (F.col(x) & (F.col(f"at_{x}") == F.col("step"))), filters, F.lit(False))
    steps = steps.withColumn("fails", fails)
    here = F.col("first") == F.col("step")
    found = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"), F.count_if(here).alias("removed"), F.count_if(F.col("fails") & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") & (F.col("n_fails") == 1)).alias("unique_fails"), F.count_if(here & F.col("good")).alias("good_lost"), F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    return found.withColumn("filter", letter).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))  # 120 rows each


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM t LEFT JOIN known USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS place
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
crossed AS (
  SELECT part, good, toxic, fails, filter_order, place,
         coalesce(list_position(list_transform(place, lambda p: fails[p]), true), 6) AS first,
         len(list_filter(fails, lambda f: f)) AS n_fails
  FROM flags, orders),
steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
         count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (fails[place[step]] AND first < step) AS redundant,
         count(*) FILTER (fails[place[step]] AND n_fails = 1) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM crossed, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM steps
"""
