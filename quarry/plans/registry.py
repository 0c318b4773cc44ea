"""Registered queries of the search engine; their SQL is in ``oracle``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import model as M
from quarry.functions import text as X
from quarry.operators import budgets, catalog, context, grams, maintenance, ranking, snippets
from quarry.operators.indexing import part_bounds as part_bounds_of
from quarry.operators.search import SearchEngine, existence
from quarry.plans.oracle import ORACLE_SQL
from quarry.plans.query import parse
from quarry.sources import adapters, listing
from quarry.sources.store import SnapshotStore, part_of
from quarry.streaming.refresh import newest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_HIT = ["file_id", "match_source", "match_count", "score"]


def _query(f):
    QUERIES[f.__name__] = f
    return f


def engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    return SearchEngine(adapters.files(spark, sf_dir), adapters.units(spark, sf_dir))


def _shown(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(*_HIT, *more).withColumn("score", F.round("score", 6))


def _search(name: str, query: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(engine(spark, sf_dir).hits(M.Request(query, **options)))

    run.__name__ = name
    _query(run)


def _ranked(name: str, query: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = engine(spark, sf_dir).ranked(M.Request(query, **options))
        return _shown(page, "rank", "file_name")

    run.__name__ = name
    _query(run)


@_query
def scan_units(spark, sf_dir):
    return adapters.units(spark, sf_dir).select("file_id", "root_id", "sequence", "line_no", "text")


@_query
def unit_stats_per_file(spark, sf_dir):
    return catalog.unit_stats(adapters.units(spark, sf_dir))


@_query
def total_units(spark, sf_dir):
    return catalog.total_units(adapters.units(spark, sf_dir))


CONTENT, NAME = M.Scope.CONTENT, M.Scope.NAME
_search("search_term", "tion", scope=CONTENT)
_search("search_short_term", "th", scope=CONTENT)
_search("search_non_ascii", "é", scope=CONTENT)
_search("search_absent", "zzqx")
_search("search_multi_term", "tion ort the", scope=CONTENT)
_search("search_phrase", '"of the"', scope=CONTENT)
_search("search_exact_phrase", "in the", scope=CONTENT, exact_phrase=True)
_search("search_match_case", "The", scope=CONTENT, match_case=True)
_search("search_whole_word", "the", scope=CONTENT, whole_word=True)
_search("search_multi_whole_word", "the of", scope=CONTENT, whole_word=True)
_search("search_multi_compat", "The ing", scope=CONTENT, match_case=True, compat=True)
_search("search_glob_star", "th*tion", scope=CONTENT)
_search("search_glob_qmark", "e?t", scope=CONTENT)
_search("search_glob_many", "a*e*i*o", scope=CONTENT)
_search("search_glob_whole_word", "the*", scope=CONTENT, whole_word=True)
_search("search_wildcard_only", "*", scope=CONTENT)
_search("search_name_only", "budget", scope=NAME)
_search("search_name_glob", "budget*", scope=NAME)
_search("search_name_qmark", "m?nutes.*", scope=NAME)
_search("search_scope_both", "ort")
_search("search_scope_both_minutes", "ute")
_search("search_root", "tion", scope=CONTENT, root_id=2)
_search("filter_ext", "tion", scope=CONTENT, filters=M.Filters(extensions=frozenset({".txt", ".pdf"})))
_search("filter_mtime", "tion", scope=CONTENT, filters=M.Filters(modified_after=1704427200.0, modified_before=1706500000.0))
_search("filter_size", "tion", scope=CONTENT, filters=M.Filters(min_size=500, max_size=5000))
_search("filter_subfolder", "tion", scope=CONTENT, filters=M.Filters(subfolder="D:\\corpus\\en\\src1"))
_search("filter_subfolder_compat", "tion", scope=CONTENT, filters=M.Filters(subfolder="D:\\corpus\\en\\src1"), compat=True)
_search("filter_combined", "tion", scope=CONTENT, filters=M.Filters(extensions=frozenset({".txt"}), min_size=300, modified_after=1704427200.0))
_search("rank_name_bands", "budget_2561", scope=NAME)
_ranked("rank_relevance", "ort", limit=50)
_ranked("rank_relevance_ascending", "ort", limit=50, descending=False)
for _sort in ("name", "type", "size", "modified", "path"):
    _ranked(f"sort_{_sort}", "tion", scope=CONTENT, sort=M.SortField(_sort), descending=_sort in ("size", "modified"), limit=100)
_ranked("page_offset", "tion", scope=CONTENT, limit=20, offset=40)


#: Parquet files of a part of ``units`` at most, so that their number grows with the parts alone.
FILES_OF_A_PART = 4


def _stored(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """The tables in a store of their own, with units in parts and a gram index, in the folder that the cluster shares."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    store = SnapshotStore(spark, f"{(found or 'file://' + tempfile.mkdtemp(prefix='quarry-')).rstrip('/')}/store-{uuid.uuid4().hex}")
    units = adapters.units(spark, sf_dir).withColumn("part", part_of(F.col("root_id"), F.col("file_id")))
    parts = [r["part"] for r in adapters.files(spark, sf_dir).select(part_of(F.col("root_id"), F.col("file_id")).alias("part")).distinct().collect()]  # a row for FILES_PER_PART files
    units = units.repartition("part", F.pmod("file_id", F.lit(FILES_OF_A_PART)))  # else each task writes a file to each part
    store.replace({"units": (units, "part", parts)}, {"files": adapters.files(spark, sf_dir)})
    grams.rebuilt(store)
    return store


@_query
def search_with_grams(spark, sf_dir):
    """Two terms, looked for only in files that a stored gram index names."""
    return _shown(SearchEngine.open(_stored(spark, sf_dir), indexed=True).hits(M.Request("ention ther*ing", scope=CONTENT)))


@_query
def gram_lists(spark, sf_dir):
    """How many files each gram's lists hold."""
    lists, _, _ = grams.postings(adapters.units(spark, sf_dir))
    return lists.groupBy(F.col("gram").cast("long").alias("gram")).agg(F.sum(F.col("n").cast("long")).alias("n_files"))


@_query
def folded_texts(spark, sf_dir):
    """The digest of each whole text, folded, and how many characters folding adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = X.folded(F.col("text"))
    return docs.select("doc_id", F.md5(own.cast("binary")).alias("folded_md5"), (F.length(own) - F.length("text")).cast("long").alias("added"))


@_query
def part_bounds(spark, sf_dir):
    """The bounds of the files' attributes in parts of 50 files, by which searches leave parts out."""
    files = adapters.files(spark, sf_dir).withColumn("part", F.floor(F.col("file_id") / 50).cast("long"))
    return part_bounds_of(files, ["root_id", "part"]).select(
        "root_id", "part", *(f"{end}_{c}" for c in ("size_bytes", "modified_time", "normalized_path") for end in ("least", "most")), F.array_join(F.array_sort("extensions"), ",").alias("extensions")
    )


@_query
def newest_events(spark, sf_dir):
    """Three events for each document, of which one is a deletion: the last one of each file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    events = docs.select(
        F.lit(1).alias("root_id"), F.concat(F.col("source"), F.lit("\\D"), (F.col("doc_id") % 700).cast("string")).alias("relative_path"),
        F.explode(F.array(*(F.struct(F.expr(f"CAST(doc_id * {k} % 101 AS DOUBLE)").alias("t"), text.alias("text")) for k, text in ((7, F.col("text")), (13, F.lit("short")), (29, F.lit(None).cast("string")))))).alias("e"),
    )
    found = newest(events.select("root_id", "relative_path", F.col("e.t").alias("modified_time"), F.col("e.text").alias("text")), "d:\\in")
    return found.select("normalized_path", "modified_time", "alive", F.length("text").cast("long").alias("n_chars"))


@_query
def name_scores(spark, sf_dir):
    """Bands of every name that holds the term."""
    files = adapters.files(spark, sf_dir).filter(F.lower("file_name").contains("budget"))
    return files.select("file_id", "file_name", ranking.name_score(parse("budget").terms, F.col("file_name")).alias("name_score"))


@_query
def top_locations(spark, sf_dir):
    e, r = engine(spark, sf_dir), M.Request("tion", scope=CONTENT)
    return e.locations(r, e.hits(r)).select("file_id", "unit_id", "sequence", "line_no", "place")


@_query
def term_units(spark, sf_dir):
    """The units of each of three terms."""
    return engine(spark, sf_dir).term_units(M.Request("tion th*ing ute"))


@_query
def neighbour_context(spark, sf_dir):
    units = adapters.units(spark, sf_dir)
    wanted = units.filter(F.lower("text").contains("ute") & (F.length("text") < M.NEIGHBOUR_CHARS))
    return context.with_neighbours(units, wanted)


@_query
def row_context(spark, sf_dir):
    cells = adapters.cells(spark, sf_dir)
    return context.with_row_context(cells, cells.filter("column_no = 3 AND text = '1-URGENT'")).select("file_id", "row_no", "sequence", "context")


@_query
def row_context_compat(spark, sf_dir):
    cells = adapters.cells(spark, sf_dir)
    return context.with_row_context(cells, cells.filter("column_no = 3 AND text = '1-URGENT'"), compat=True).select("file_id", "row_no", "sequence", "context")


@_query
def highlight_spans(spark, sf_dir):
    units = adapters.units(spark, sf_dir).filter(F.lower("text").contains("tion"))
    found = units.select("file_id", "sequence", F.explode(snippets.literal_spans(F.col("text"), "tion")).alias("s"))
    return found.select("file_id", "sequence", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@_query
def glob_spans(spark, sf_dir):
    """The extents of a wildcard pattern's matches."""
    units = adapters.units(spark, sf_dir).filter(F.lower("text").rlike("(?s)th.*?on.*?e"))
    found = units.select("file_id", "sequence", F.explode(snippets.glob_spans(F.col("text"), "*th*on*e*", limit=1 << 20)).alias("s"))
    return found.select("file_id", "sequence", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@_query
def budget_cut(spark, sf_dir):
    """Units under budgets of 12 units and 2,000 characters a file, with what stands before each."""
    units = adapters.units(spark, sf_dir)
    left = budgets.with_running(budgets.within(units, 12, 2000))
    return left.select("file_id", "sequence", "units_before", "chars_before", F.length("text").cast("long").alias("n_chars"))


@_query
def truncated_files(spark, sf_dir):
    """Every file under the same budgets: cut or not, and what is left of it."""
    files, _ = budgets.cut(adapters.files(spark, sf_dir).withColumns({"unit_count": F.lit(0), "char_count": F.lit(0).cast("long")}), adapters.units(spark, sf_dir), 12, 2000)
    return files.select("file_id", "truncated", F.col("unit_count").cast("long").alias("unit_count"), "char_count")


@_query
def merged_highlights(spark, sf_dir):
    units = adapters.units(spark, sf_dir).filter(F.lower("text").contains("th"))
    both = F.concat(snippets.literal_spans(F.col("text"), "th"), snippets.literal_spans(F.col("text"), "he"))
    found = units.select("file_id", "sequence", snippets.merged_spans(both).alias("m"))
    total = F.aggregate("m", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return found.select("file_id", "sequence", F.size("m").cast("long").alias("n_spans"), total.cast("long").alias("n_marked"))


@_query
def snippets_page(spark, sf_dir):
    """Snippets of a result page (a page is the feature)."""
    e, r = engine(spark, sf_dir), M.Request("tion", scope=CONTENT, limit=50)
    found = e.locations(r, e.ranked(r))
    around = context.with_neighbours(e.units, found)
    found = found.join(around.select("file_id", "sequence", "joined"), ["file_id", "sequence"], "left")
    s = snippets.snippet_column(parse(r.query), F.col("text"), joined=F.col("joined"))
    return found.withColumn("s", s).select("file_id", "sequence", "place", "s.snippet", F.size("s.highlights").cast("long").alias("n_highlights"))


@_query
def name_highlights(spark, sf_dir):
    """Marks of three overlapping terms in the files' names."""
    f = adapters.files(spark, sf_dir)
    found = f.select("file_id", snippets.name_highlights(parse("budget ud nu"), F.col("file_name")).alias("m")).filter(F.size("m") > 0)
    marked = F.aggregate("m", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return found.select("file_id", F.size("m").cast("long").alias("n_spans"), marked.cast("long").alias("n_marked"))


@_query
def grouped_results(spark, sf_dir):
    """One row per file with its locations, in order."""
    e, r = engine(spark, sf_dir), M.Request("ute", scope=CONTENT)
    hits = e.hits(r)
    listed = e.locations(r, hits).groupBy("file_id").agg(F.array_sort(F.collect_list("sequence")).alias("seqs"))  # at most SNIPPETS_PER_FILE each
    return hits.join(listed, "file_id").select("file_id", "match_count", F.concat_ws(",", F.transform("seqs", lambda x: x.cast("string"))).alias("sequences"))


@_query
def paragraph_search(spark, sf_dir):
    found = adapters.paragraphs(spark, sf_dir).filter(F.lower("text").contains("tion"))
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("match_count"), F.min("sequence").cast("long").alias("first_sequence"))


@_query
def status_counts(spark, sf_dir):
    return catalog.status_counts(adapters.files(spark, sf_dir))


@_query
def extension_counts(spark, sf_dir):
    return catalog.extension_counts(adapters.files(spark, sf_dir))


@_query
def root_counts(spark, sf_dir):
    return catalog.root_counts(adapters.files(spark, sf_dir))


@_query
def roots_by_name(spark, sf_dir):
    """Suppliers' nations as roots, in the order of their names."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return catalog.roots_by_name(n.select(F.col("n_nationkey").alias("root_id"), F.concat(F.lit("D:\\"), F.col("n_name")).alias("display_path")))


@_query
def units_of_file(spark, sf_dir):
    """The first units of one file, in order (a listing's limit is the feature)."""
    return catalog.units_of(adapters.units(spark, sf_dir), 7, 50).select("file_id", "sequence", "line_no", "text")


def _runs(spark, sf_dir):
    """Orders as index runs: a run per order, a root per order status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    root = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    status = F.when(F.col("o_orderkey") % 5 == 0, "running").when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("run_id"), root.alias("root_id"), status.alias("status"))


@_query
def latest_run(spark, sf_dir):
    return catalog.latest_run(_runs(spark, sf_dir)).select("root_id", "run_id", "status")


@_query
def abandoned_runs(spark, sf_dir):
    return catalog.abandon_running(_runs(spark, sf_dir)).groupBy("root_id", "status").agg(F.count(F.lit(1)).alias("n"))


def _old_index(spark, sf_dir):
    """A perturbed snapshot: some files missing, grown, re-parsed, touched; some that are gone by now."""
    f = adapters.files(spark, sf_dir)
    size = F.col("size_bytes") + F.when(F.col("file_id") % 7 == 0, 1).otherwise(0)
    mtime = F.col("modified_time") + F.when(F.col("file_id") % 3 == 0, 0.5).otherwise(0.0)
    parser = F.when(F.col("file_id") % 13 == 0, 0).otherwise(1)
    old = f.filter("file_id % 10 <> 0").select("file_id", "root_id", "normalized_path", size.alias("size_bytes"), mtime.alias("modified_time"), parser.alias("parser_version"))
    gone = spark.range(9_000_000, 9_000_020).select(F.col("id").alias("file_id"), F.lit(2).alias("root_id"), F.concat(F.lit("d:\\gone\\"), F.col("id").cast("string")).alias("normalized_path"), F.lit(1).cast("long").alias("size_bytes"), F.lit(1.0).alias("modified_time"), F.lit(1).alias("parser_version"))
    return old.unionByName(gone)


@_query
def fingerprint_unchanged(spark, sf_dir):
    found = maintenance.classify(_old_index(spark, sf_dir), adapters.files(spark, sf_dir), M.PARSER_VERSION)
    return found.select("root_id", "normalized_path", "change")


@_query
def merge_upsert(spark, sf_dir):
    old = _old_index(spark, sf_dir)
    changed = maintenance.classify(old, adapters.files(spark, sf_dir), M.PARSER_VERSION).filter("change IN ('new', 'changed')")
    merged = maintenance.upsert(old, changed.select("root_id", "normalized_path", "size_bytes", "modified_time", F.lit(1).alias("parser_version")))
    # fresh ids are numbered by hash order, which SQL elsewhere does not share: shown as null
    return merged.select("root_id", "normalized_path", F.when(F.col("file_id") < 9_000_020, F.col("file_id")).alias("kept_id"), "size_bytes", "parser_version")


@_query
def stale_files(spark, sf_dir):
    return maintenance.stale_files(adapters.files(spark, sf_dir), 2).select("file_id", "normalized_path")


@_query
def orphan_units(spark, sf_dir):
    kept = adapters.files(spark, sf_dir).filter("file_id % 11 <> 0")
    return maintenance.orphan_units(adapters.units(spark, sf_dir), kept).select("file_id", "sequence")


@_query
def replaced_units(spark, sf_dir):
    units = adapters.units(spark, sf_dir).select("file_id", "sequence", "text")
    changed = adapters.files(spark, sf_dir).filter("file_id % 7 = 0")
    new = units.join(changed.select("file_id"), "file_id", "left_semi").filter("sequence = 1")
    return maintenance.replace_units(units, new, changed).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@_query
def clean_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(X.clean_text(F.col("text"), None)).alias("digest"))


@_query
def path_normalise(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    raw = F.concat(F.lit("D:/Corpus//"), F.regexp_replace("relative_path", r"\\", "/"), F.lit("/"))
    return f.select("file_id", X.normalized_path(raw).alias("path"), X.extension_of(F.col("file_name")).alias("ext"), X.stem_of(F.col("file_name")).alias("stem"), X.is_within(F.col("normalized_path"), F.lit("d:\\corpus\\en")).alias("within"), X.relative_path(F.col("normalized_path"), F.lit("d:\\corpus\\en")).alias("rel"), X.drive_letter(F.col("normalized_path")).alias("drive"))


@_query
def mime_categories(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    return f.groupBy(X.mime_category(F.col("extension")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@_query
def fingerprints(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    made = X.fingerprint(F.col("size_bytes"), F.col("modified_time"), F.lit(1))
    p = X.parse_fingerprint(made)
    return f.select("file_id", made.alias("made"), (made == F.col("fingerprint")).alias("same"), p["size"].alias("size"), p["mtime_ms"].alias("mtime_ms"))


@_query
def excel_columns(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", X.column_name(F.col("p_partkey")).alias("column_name"))


@_query
def format_sizes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", X.format_size(F.col("o_orderkey") * 1024 * 512).alias("size"))


@_query
def scan_skip_reasons(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    prefix = F.when(F.col("file_id") % 31 == 0, "~$").otherwise("")
    name = F.concat(prefix, F.when(F.col("file_id") % 19 == 0, F.concat(F.col("file_name"), F.lit(".exe"))).otherwise(F.col("file_name")))
    made = f.select("file_id", name.alias("file_name"), F.when(F.col("file_id") % 37 == 0, 0).otherwise(F.col("size_bytes") * 100_000).alias("size_bytes"), (F.col("file_id") % 41 == 0).alias("hidden"), F.lit(False).alias("system"), F.lit(False).alias("is_link"))
    return made.withColumn("skip_reason", listing.skip_reason()).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


@_query
def skip_counts(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    reason = F.when(F.col("file_id") % 5 == 0, "not_supported").when(F.col("file_id") % 7 == 0, "hidden")
    return catalog.skip_counts(f.withColumn("skip_reason", reason))


@_query
def run_counters(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    outcome = F.when(F.col("file_id") % 3 == 0, "unchanged").otherwise(F.col("content_status"))
    return catalog.run_counters(f.select(F.col("last_seen_run_id").alias("run_id"), outcome.alias("outcome")))


@_query
def touch_seen(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    return maintenance.touch(f, f.filter("file_id % 5 = 0"), 3).groupBy("last_seen_run_id").agg(F.count(F.lit(1)).alias("n"))


@_query
def remove_deleted(spark, sf_dir):
    return maintenance.without_unseen(adapters.files(spark, sf_dir), 2, True).select("file_id")


@_query
def delete_files(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    return maintenance.delete_files(f, f.filter("file_id % 5 = 0")).groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))


@_query
def mark_status(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    return catalog.status_counts(maintenance.mark_status(f, f.filter("file_id % 5 = 0"), "stale"))


@_query
def cascade_delete(spark, sf_dir):
    files = maintenance.delete_root(adapters.files(spark, sf_dir), 2)
    return maintenance.cascade(adapters.units(spark, sf_dir), files).groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))


@_query
def existence_flag(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    return existence(f.select("file_id", "normalized_path"), f.filter("file_id % 4 <> 1")).select("file_id", "exists")


@_query
def set_operations(spark, sf_dir):
    """Files whose name holds one term and whose content holds the other, by sets."""
    e = engine(spark, sf_dir)
    by_name = e.hits(M.Request("budget", scope=NAME)).select("file_id")
    by_text = e.hits(M.Request("tion", scope=CONTENT)).select("file_id")
    both = by_name.intersect(by_text).withColumn("side", F.lit("both"))
    return both.union(by_name.subtract(by_text).withColumn("side", F.lit("name")))


@_query
def format_timestamps(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    return f.select("file_id", X.format_timestamp(F.col("modified_time")).alias("shown"), X.iso_timestamp(F.col("modified_time")).alias("iso"))


@_query
def location_labels(spark, sf_dir):
    units = adapters.units(spark, sf_dir)
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    where = F.struct(F.col("line_no").alias("line"), *(none(f.name, f.dataType) for f in M.LOCATION if f.name != "line"))
    return units.select("file_id", "sequence", X.location_label(F.col("location_type"), where).alias("label"))


@_query
def display_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(X.for_display(F.col("text"))).alias("digest"))


@_query
def content_hashes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", X.content_sha256(F.col("text")).alias("sha256"))


@_query
def end_of_days(spark, sf_dir):
    """The last second of each order's day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", X.end_of_day(F.col("o_orderdate").cast("date")).alias("last_second"))


@_query
def log_lines(spark, sf_dir):
    """Paths and controls out of what is logged."""
    f = adapters.files(spark, sf_dir)
    said = F.concat(F.lit("could not read "), F.lit("D:\\corpus\\"), F.col("relative_path"), F.lit(" and /tmp/x\tnow"))
    return f.select("file_id", X.sanitize_for_log(said).alias("line"))


@_query
def status_labels(spark, sf_dir):
    f = adapters.files(spark, sf_dir)
    return f.groupBy(X.label(F.col("content_status"), X.STATUS_LABELS).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided search, ranked: the first page."""
    return _shown(engine(spark, sf_dir).ranked(M.Request("ort")), "rank", "file_name")


__all__ = ["ORACLE_SQL", "QUERIES", "engine", "flagship"]
