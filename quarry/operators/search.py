"""Search: per-term evidence in one pass over units, joined with names, ranked, paged.

Plan: the metadata filter and the root prune ``files``; units are scanned once,
with cheap substring prefilters before regexes, and reduced map-side to one row
per file; the join is on file_id, by which the aggregate is already partitioned.
The newest time and the number of hits need all hits before any can be scored:
both branches read the same exchange of the per-file aggregate, which Spark then
runs once.  ``search`` takes its total from the page's own rows.  Scores need only
flags and counts, so texts are read again for the page's rows alone (``locations``).
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import model as M
from quarry.functions.text import normalized_path_str
from quarry.operators import context, grams, ranking, snippets
from quarry.plans.patterns import all_of, any_of, candidate, name_matches, unit_matches
from quarry.plans.query import Parsed, QueryError, Term, parse
from quarry.sources.store import WHOLE, Snapshot, SnapshotStore


#: Units from which on a search asks the gram index first: below, one scan takes less time than the index's two small jobs.
INDEXED_ROWS = 1_000_000


def metadata_filter(f: M.Filters, compat: bool = False) -> Column:
    """Inclusive bounds; a null time passes no time bound.  compat: the subfolder is a plain prefix."""
    tests = []
    if f.extensions:
        tests.append(F.col("extension").isin(sorted(f.extensions)))
    for column, low, high in (("modified_time", f.modified_after, f.modified_before), ("size_bytes", f.min_size, f.max_size)):
        if low is not None:
            tests.append(F.col(column) >= low)
        if high is not None:
            tests.append(F.col(column) <= high)
    if f.subfolder:
        folder = normalized_path_str(f.subfolder)
        path = F.col("normalized_path")
        tests.append(path.startswith(folder) if compat else (path == folder) | path.startswith(folder.rstrip("\\") + "\\"))
    return all_of(tests)


def may_hold(facts: dict | None, f: M.Filters, compat: bool = False) -> bool:
    """Whether files of these bounds (``indexing.part_facts``) can pass ``metadata_filter``; of unknown ones, yes."""
    if facts is None:
        return True

    def apart(name: str, low, high) -> bool:
        least, most = facts.get(name) or (None, None)
        if least is None:  # no file has that attribute, or nothing is known
            return name in facts and (low is not None or high is not None)
        return low is not None and most < low or high is not None and least > high

    if apart("size_bytes", f.min_size, f.max_size) or apart("modified_time", f.modified_after, f.modified_before):
        return False
    if f.extensions and "extension" in facts and not f.extensions & set(facts["extension"]):
        return False
    if f.subfolder:
        folder = normalized_path_str(f.subfolder)
        if not compat:
            folder = folder.rstrip("\\")
        return not apart("normalized_path", folder, folder + chr(0x10FFFF))
    return True


@dataclass
class Page:
    rows: DataFrame
    total: int
    truncated: bool
    warnings: tuple[str, ...]


def _bounds(request: M.Request) -> tuple[int, int]:
    """Limit and offset inside what is allowed."""
    return min(max(request.limit or M.DEFAULT_LIMIT, 1), M.MAX_LIMIT), max(0, request.offset)


class SearchEngine:
    """``files`` and ``units`` as in ``quarry.model``; display_path falls back to normalized_path.

    ``at``: the snapshot that both are from; its parts are pruned by root and, where
    ``indexed``, by the gram index.
    """

    def __init__(self, files: DataFrame, units: DataFrame, at: Snapshot | None = None, indexed: bool = False):
        if "display_path" not in files.columns:
            files = files.withColumn("display_path", F.col("normalized_path"))
        self.files, self.units, self.at, self.indexed = files, units, at, indexed and at is not None

    @classmethod
    def open(cls, store: SnapshotStore, indexed: bool | None = None) -> SearchEngine:
        """An engine over the store's present snapshot.

        ``indexed``: whether to ask the gram index first; by default where ``units``
        has INDEXED_ROWS rows or more.  The hits are the same.
        """
        at = store.snapshot()
        if indexed is None:
            indexed = sum(p.get("rows", 0) for p in at.tables.get("units", {}).values()) >= INDEXED_ROWS
        return cls(at.read("files"), at.read("units"), at, indexed)

    def _filters(self, request: M.Request) -> M.Filters:
        """A subfolder that lies outside the request's root is ignored."""
        if not request.filters.subfolder or request.root_id is None or self.at is None or "roots" not in self.at.tables:
            return request.filters
        root = self.at.read("roots").filter(F.col("root_id") == request.root_id).first()
        return within_root(request.filters, root["display_path"]) if root is not None else request.filters

    def _files(self, request: M.Request) -> DataFrame:
        rows, filters = self.files if request.root_id is None else self.files.filter(F.col("root_id") == request.root_id), self._filters(request)
        return rows.filter(metadata_filter(filters, request.compat)) if filters.active else rows

    def _units(self, request: M.Request, parsed: Parsed | None = None) -> DataFrame:
        """The units of the request's root; for a parsed query only those of files that may match."""
        units = self.units
        found = grams.candidates(self.at, units.sparkSession, parsed) if self.indexed and parsed is not None else None
        if self.at is not None and WHOLE not in (parts := self.at.parts("units")):
            if request.root_id is not None:
                parts = [p for p in parts if p.startswith(f"{request.root_id}-")]
            if (filters := self._filters(request)).active:
                parts = [p for p in parts if may_hold(self.at.tables["units"][p].get("files"), filters, request.compat)]
            if found is not None:
                parts = found.parts(parts)
            units = self.at.read("units", parts)
        if found is not None:
            units = units.join(found.rows, "file_id", "left_semi")
        return units if request.root_id is None else units.filter(F.col("root_id") == request.root_id)

    def name_hits(self, request: M.Request, parsed: Parsed) -> Column:
        """Every term matches the file name or the relative path."""
        args = (request.match_case, request.whole_word)
        return all_of([name_matches(t, F.col("file_name"), *args) | name_matches(t, F.col("relative_path"), *args) for t in parsed.terms])

    def content_hits(self, request: M.Request, parsed: Parsed) -> DataFrame:
        """(file_id, match_count): files in which every term has a unit.

        By default a term's unit is a verified one, and verified units count.
        compat: candidates decide and count, and one verified unit among the
        first candidates suffices.
        """
        text, args = F.col("text"), (request.match_case, request.whole_word)
        verified = [unit_matches(t, text, *args) for t in parsed.terms]
        flags = [candidate(t, text) for t in parsed.terms] if request.compat else verified
        names = [f"m{i}" for i in range(len(flags))]
        found = self._units(request, parsed).filter(any_of(flags))
        if request.compat:
            first = Window.partitionBy("file_id").orderBy("unit_id")
            found = found.withColumn("early", F.row_number().over(first) <= M.CANDIDATE_UNITS_PER_FILE)
        else:
            found = found.withColumn("early", F.lit(True))
        marked = found.select("file_id", *(f.alias(n) for f, n in zip(flags, names)), (F.col("early") & any_of(verified)).alias("shown"))
        per_file = marked.groupBy("file_id").agg(F.count(F.lit(1)).alias("match_count"), F.bool_or("shown").alias("shown"), *(F.bool_or(n).alias(n) for n in names))
        return per_file.filter(all_of([F.col("shown"), *(F.col(n) for n in names)])).select("file_id", "match_count")

    def _hits(self, request: M.Request, parsed: Parsed | None = None) -> DataFrame:
        """``hits`` with their number, ``n_hits``."""
        parsed = parsed or parse(request.query, exact_phrase=request.exact_phrase)
        files = self._files(request)
        by_name = self.name_hits(request, parsed) if request.scope != M.Scope.CONTENT else F.lit(False)
        if request.scope == M.Scope.NAME:
            rows = files.filter(by_name).withColumn("by_name", F.lit(True)).withColumn("match_count", F.lit(None).cast("long"))
        else:
            content = self.content_hits(request, parsed)
            rows = files.withColumn("by_name", by_name)
            rows = rows.join(content, "file_id", "inner" if request.scope == M.Scope.CONTENT else "left").filter(F.col("by_name") | F.col("match_count").isNotNull())
            # the same columns in every branch that reads these rows, so that they share the exchange
            rows = rows.filter(F.coalesce("match_count", F.lit(1)) > 0)
        has_content = F.col("match_count").isNotNull()
        source = F.when(F.col("by_name") & has_content, "both").when(F.col("by_name"), "name").otherwise("content")
        name_part = F.when(F.col("by_name"), ranking.name_score(parsed.terms, F.col("file_name"), request.match_case)).otherwise(0.0)
        content_part = F.when(has_content, ranking.content_score(parsed.terms, F.col("match_count"))).otherwise(0.0)
        rows = rows.withColumn("match_source", source).withColumn("part", F.greatest(name_part, content_part)).withColumn("match_count", F.coalesce("match_count", F.lit(0)))
        rows = ranking.with_totals(rows.drop("by_name"))
        bonus = F.when(F.col("match_source") == "both", ranking.BOTH).otherwise(0.0)
        return rows.withColumn("score", F.col("part") + bonus + ranking.recency(F.col("modified_time"), F.col("newest"))).drop("part", "newest")

    def hits(self, request: M.Request, parsed: Parsed | None = None) -> DataFrame:
        """All matching files with match_source, match_count and score, in no order."""
        return self._hits(request, parsed).drop("n_hits")

    def _page(self, request: M.Request, parsed: Parsed | None = None) -> DataFrame:
        keys = ranking.order_by(request.sort, request.descending)
        limit, offset = _bounds(request)
        page = self._hits(request, parsed).orderBy(*keys).limit(offset + limit)  # a top-k of the executors, at most offset + limit rows
        numbered = page.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long"))
        return numbered.filter(F.col("rank") > offset)

    def ranked(self, request: M.Request) -> DataFrame:
        """The requested page of hits with its ``rank`` (from 1 over the whole order)."""
        return self._page(request).drop("n_hits")

    def search(self, request: M.Request) -> Page:
        """A page with totals; a malformed query is an empty page with a warning, never an exception."""
        try:
            parsed = parse(request.query, exact_phrase=request.exact_phrase)
        except QueryError as e:
            return Page(self.files.limit(0), 0, False, (e.code,))
        limit, offset = _bounds(request)
        page = self._page(request, parsed)
        found = page.collect()  # one page: at most MAX_LIMIT rows
        total = found[0]["n_hits"] if found else self.hits(request, parsed).count() if offset else 0
        rows = self.files.sparkSession.createDataFrame(found, page.schema).drop("n_hits")
        return Page(rows, total, total > offset + limit, parsed.warnings)

    def locations(self, request: M.Request, page: DataFrame, per_file: int | None = None) -> DataFrame:
        """The first verified units, by sequence, of each file of a page; ``per_file`` of them, or as many as the request says."""
        parsed = parse(request.query, exact_phrase=request.exact_phrase)
        shown = any_of([unit_matches(t, F.col("text"), request.match_case, request.whole_word) for t in parsed.terms])
        own = self._units(request).filter(shown).join(page.select("file_id"), "file_id", "left_semi")
        order = Window.partitionBy("file_id").orderBy("sequence")
        return own.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= (per_file or request.snippets_per_file))

    def snippets(self, request: M.Request, page: DataFrame, per_file: int | None = None) -> DataFrame:
        """``locations`` with snippet and highlights: cells show their row, other short units their neighbourhood."""
        parsed, units = parse(request.query, exact_phrase=request.exact_phrase), self._units(request)
        args = (request.match_case, request.whole_word)
        found = self.locations(request, page, per_file)
        short = found.filter(F.col("location_type").isin(*M.NEIGHBOUR_TYPES) & (F.length("text") < M.NEIGHBOUR_CHARS))
        around = context.with_neighbours(units, short).select("file_id", "sequence", "joined")
        shown = snippets.snippet_column(parsed, F.col("text"), *args, joined=F.col("joined"))
        found = found.join(around, ["file_id", "sequence"], "left").withColumn("shown", shown).drop("joined")
        if "location" in units.columns:
            place = [F.col("location.sheet").alias("sheet"), F.col("location.row").alias("row_no")]
            cells = units.filter("location_type = 'sheet_cell'").select("file_id", "sequence", *place, "text")
            rows = context.with_row_context(cells, found.filter("location_type = 'sheet_cell'").select("file_id", "sequence", *place, "text"))
            found = found.join(rows.select("file_id", "sequence", "context"), ["file_id", "sequence"], "left")
            marks = snippets.merged_spans(snippets.spans(parsed.terms, F.col("context"), *args))
            found = found.withColumn("shown", F.when(F.col("context").isNotNull(), F.struct(F.col("context").alias("snippet"), marks.alias("highlights"))).otherwise(F.col("shown"))).drop("context")
        return found.select(*(c for c in found.columns if c != "shown"), "shown.snippet", "shown.highlights")

    def term_units(self, request: M.Request) -> DataFrame:
        """(term, file_id, unit_id): the units that each term's full semantics match; terms by their number in the query."""
        parsed = parse(request.query, exact_phrase=request.exact_phrase)
        tests = [unit_matches(t, F.col("text"), request.match_case, request.whole_word) for t in parsed.terms]
        numbers = F.filter(F.array(*(F.when(t, i) for i, t in enumerate(tests))), lambda x: x.isNotNull())
        return self._units(request).filter(any_of(tests)).select(F.explode(numbers).alias("term"), "file_id", "unit_id")


def within_root(filters: M.Filters, root: str) -> M.Filters:
    """The filters for a search of ``root``: a subfolder that lies outside it is ignored."""
    if not filters.subfolder:
        return filters
    base, folder = normalized_path_str(root).rstrip("\\"), normalized_path_str(filters.subfolder)
    return filters if folder == base or folder.startswith(base + "\\") else replace(filters, subfolder=None)


#: Seconds before a search is tried again.
RETRY_AFTER = 0.12


def search_store(store: SnapshotStore, request: M.Request, attempts: int = 2, indexed: bool | None = None) -> Page:
    """A search of a snapshot store's files and units.

    A snapshot that is expired while it is read makes a search fail; it is then
    opened anew, once by default.
    """
    for left in range(attempts - 1, -1, -1):
        try:
            return SearchEngine.open(store, indexed).search(request)
        except (Py4JJavaError, PySparkException):
            if not left:
                raise
            time.sleep(RETRY_AFTER)
    raise ValueError("attempts must be positive")


@contextmanager
def cancellable(spark, tag: str):
    """Jobs started inside can be stopped from another thread with ``cancel``."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def existence(page: DataFrame, listing: DataFrame) -> DataFrame:
    """``exists``: is the file in the current listing?"""
    now = listing.select("normalized_path").distinct().withColumn("exists", F.lit(True))
    return page.join(now, "normalized_path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


__all__ = ["Page", "SearchEngine", "Term", "cancel", "cancellable", "existence", "may_hold", "metadata_filter", "search_store", "within_root"]
