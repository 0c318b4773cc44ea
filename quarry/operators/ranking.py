"""Relevance as Column arithmetic, and the sort orders.

Bands are fixed values, far enough apart that additions never cross them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import stem_of
from quarry.model import SortField
from quarry.plans.patterns import any_of
from quarry.plans.query import Term

# Fixed values.
EXACT, STEM, PREFIX, AT_WORD, SUBSTRING = 1000.0, 900.0, 800.0, 700.0, 600.0
PHRASE, TERM = 400.0, 200.0
BOTH, PER_MATCH, MATCH_CAP, RECENCY, HALF_LIFE_DAYS = 60.0, 4.0, 40.0, 15.0, 90.0
SEPARATORS = (" ", "_", "-", ".", "(", "[", ",", "+")


def name_score(terms: tuple[Term, ...], name: Column, match_case: bool = False) -> Column:
    """The best band over the terms, at least the substring band (for a verified name hit)."""
    own = name if match_case else F.lower(name)
    stem = stem_of(own)
    bands = []
    for t in terms:
        text = t.text if match_case else t.text.lower()
        bands.append(
            F.when(own == text, EXACT).when(stem == text, STEM).when(own.startswith(text), PREFIX)
            .when(any_of([own.contains(s + text) for s in SEPARATORS]), AT_WORD).otherwise(SUBSTRING)
        )
    return F.greatest(*bands) if len(bands) > 1 else bands[0]


def content_score(terms: tuple[Term, ...], match_count: Column) -> Column:
    base = PHRASE if any(t.phrase for t in terms) else TERM
    return F.lit(base) + F.least(F.lit(MATCH_CAP), F.greatest(F.lit(0.0), (match_count - 1) * PER_MATCH))


def recency(modified: Column, newest: Column) -> Column:
    days = F.greatest(F.lit(0.0), (newest - modified) / 86400.0)
    known = (F.coalesce(modified, F.lit(0.0)) != 0) & (F.coalesce(newest, F.lit(0.0)) > 0)
    return F.when(known, F.lit(RECENCY) / (1.0 + days / HALF_LIFE_DAYS)).otherwise(0.0)


def with_totals(hits: DataFrame) -> DataFrame:
    """``newest``, the latest modification in the whole result, and ``n_hits``, its rows: one row joined by a constant key."""
    newest = hits.agg(F.max("modified_time").alias("newest"), F.count(F.lit(1)).alias("n_hits")).withColumn("one", F.lit(1))
    return hits.withColumn("one", F.lit(1)).join(F.broadcast(newest), "one").drop("one")  # a single row


def order_by(sort: SortField, descending: bool) -> list[Column]:
    """Sort keys, closed by file_id so that pages are stable."""
    way = lambda c: c.desc() if descending else c.asc()
    name, path = F.lower("file_name"), F.lower("display_path")
    if sort == SortField.RELEVANCE:  # ascending is the exact reverse of the list
        return [F.col("score").desc(), name.asc(), path.asc(), F.col("file_id").asc()] if descending else [F.col("score").asc(), name.desc(), path.desc(), F.col("file_id").desc()]
    keys = {
        SortField.NAME: [name], SortField.TYPE: [F.col("extension"), name], SortField.SIZE: [F.col("size_bytes")],
        SortField.MODIFIED: [F.coalesce("modified_time", F.lit(0.0))], SortField.PATH: [path],
    }[sort]
    return [*(way(k) for k in keys), F.col("file_id").asc()]

