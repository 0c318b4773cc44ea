"""DuckDB SQL of the registered queries, written from the semantics and not from the plans."""

from __future__ import annotations

from quarry.sources.adapters import CELLS_SQL, FILES_SQL, UNITS_SQL

ORACLE_SQL: dict[str, str] = {}

_FILES = f"files AS ({FILES_SQL})"
_UNITS = f"units AS ({UNITS_SQL})"
_SEPARATORS = " _-.([,+"


def _sql(name: str, body: str, *ctes: str) -> None:
    ORACLE_SQL[name] = (f"WITH {', '.join(ctes)}\n" if ctes else "") + body


def _score(part: str, both: str = "0") -> str:
    return f"round({part} + {both} + CASE WHEN coalesce(modified_time, 0) <> 0 AND newest > 0 THEN 15.0 / (1.0 + greatest(0.0, (newest - modified_time) / 86400.0) / 90.0) ELSE 0 END, 6)"


def _content(tests: list[str], units: str = "TRUE", flags: list[str] | None = None, base: int = 200) -> str:
    """(file_id, match_count, content part) of files in which every test holds for some unit; ``flags`` decide and count."""
    flags = flags or tests
    every = " AND ".join(f"bool_or({t})" for t in flags)
    shown = f"bool_or({' OR '.join(f'({t})' for t in tests)})"
    counted = " OR ".join(f"({t})" for t in flags)
    return f"""content AS (SELECT file_id, count(*) AS match_count, {base} + least(40.0, 4.0 * (count(*) - 1)) AS content_part
      FROM units WHERE ({units}) AND ({counted}) GROUP BY file_id HAVING {every} AND {shown})"""


_CONTENT_HITS = "hits AS (SELECT f.*, match_count, content_part AS part, 'content' AS match_source, 0 AS bonus, max(modified_time) OVER () AS newest FROM files f JOIN content USING (file_id) WHERE {where})"


def _content_query(name: str, tests: list[str], where: str = "TRUE", **options) -> None:
    _sql(name, f"SELECT file_id, match_source, match_count, {_score('part')} AS score FROM hits", _FILES, _UNITS, _content(tests, **options), _CONTENT_HITS.format(where=where))


def _has(text: str) -> str:
    return f"contains(lower(text), '{text}')"


def _band(term: str) -> str:
    low, stem = "lower(file_name)", r"regexp_replace(lower(file_name), '\.[^.]*$', '')"
    at_word = " OR ".join(f"contains({low}, '{s}{term}')" for s in _SEPARATORS)
    return f"CASE WHEN {low} = '{term}' THEN 1000.0 WHEN {stem} = '{term}' THEN 900.0 WHEN starts_with({low}, '{term}') THEN 800.0 WHEN {at_word} THEN 700.0 ELSE 600.0 END"


def _name_query(name: str, test: str, term: str) -> None:
    body = f"SELECT file_id, 'name' AS match_source, CAST(0 AS BIGINT) AS match_count, {_score('part')} AS score FROM hits"
    _sql(name, body, _FILES, f"hits AS (SELECT *, {_band(term)} AS part, max(modified_time) OVER () AS newest FROM files WHERE {test})")


def _both(term: str) -> tuple[str, ...]:
    hits = f"""hits AS (SELECT *, max(modified_time) OVER () AS newest FROM (
      SELECT f.*, coalesce(match_count, 0) AS match_count, CASE WHEN n AND match_count IS NOT NULL THEN 'both' WHEN n THEN 'name' ELSE 'content' END AS match_source,
        greatest(CASE WHEN n THEN {_band(term)} ELSE 0 END, coalesce(content_part, 0)) AS part, CASE WHEN n AND match_count IS NOT NULL THEN 60 ELSE 0 END AS bonus
      FROM (SELECT *, contains(lower(file_name), '{term}') OR contains(lower(relative_path), '{term}') AS n FROM files) f LEFT JOIN content USING (file_id)
      WHERE n OR match_count IS NOT NULL))"""
    return _FILES, _UNITS, _content([_has(term)]), hits


def _both_query(name: str, term: str) -> None:
    _sql(name, f"SELECT file_id, match_source, CAST(match_count AS BIGINT) AS match_count, {_score('part', 'bonus')} AS score FROM hits", *_both(term))


def _page(name: str, order: str, limit: int, offset: int = 0, term: str | None = None) -> None:
    ctes = _both(term) if term else (_FILES, _UNITS, _content([_has("tion")]), _CONTENT_HITS.format(where="TRUE"))
    raw = "part + bonus + CASE WHEN coalesce(modified_time, 0) <> 0 AND newest > 0 THEN 15.0 / (1.0 + greatest(0.0, (newest - modified_time) / 86400.0) / 90.0) ELSE 0 END"
    body = f"""SELECT * FROM (SELECT file_id, match_source, CAST(match_count AS BIGINT) AS match_count, round(raw, 6) AS score,
      row_number() OVER (ORDER BY {order}) AS rank, file_name FROM (SELECT *, {raw} AS raw FROM hits)) WHERE rank > {offset} AND rank <= {offset + limit}"""
    _sql(name, body, *ctes)


_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"

_sql("scan_units", "SELECT file_id, root_id, sequence, line_no, text FROM units", _FILES, _UNITS)
_sql("unit_stats_per_file", "SELECT file_id, count(*) AS unit_count, CAST(sum(length(text)) AS BIGINT) AS char_count FROM units GROUP BY file_id", _FILES, _UNITS)
_sql("total_units", "SELECT count(*) AS n_units FROM units", _FILES, _UNITS)
_content_query("search_term", [_has("tion")])
_content_query("search_short_term", [_has("th")])
_content_query("search_non_ascii", [_has("é")])
_both_query("search_absent", "zzqx")
_content_query("search_multi_term", [_has("tion"), _has("ort"), _has("the")])
_content_query("search_phrase", [_has("of the")], base=400)
_content_query("search_exact_phrase", [_has("in the")], base=400)
_content_query("search_match_case", ["contains(text, 'The')"])
_whole = lambda w: f"regexp_matches(lower(text), '(^|{_NW}){w}($|{_NW})')"
_content_query("search_whole_word", [_whole("the")])
_content_query("search_multi_whole_word", [_whole("the"), _whole("of")])
_content_query("search_multi_compat", ["contains(text, 'The') AND place <= 80", "contains(text, 'ing') AND place <= 80"], flags=["contains(lower(text), 'the')", "contains(lower(text), 'ing')"])
# candidates are numbered per file by unit id
ORACLE_SQL["search_multi_compat"] = ORACLE_SQL["search_multi_compat"].replace(
    "FROM units WHERE (TRUE) AND", "FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY unit_id) AS place FROM units WHERE contains(lower(text), 'the') OR contains(lower(text), 'ing')) units WHERE (TRUE) AND"
)
_content_query("search_glob_star", ["regexp_matches(lower(text), '(?s)th.*?tion')"])
_content_query("search_glob_qmark", ["regexp_matches(lower(text), '(?s)e.t')"])
_content_query("search_glob_many", ["regexp_matches(lower(text), '(?s)a.*?e.*?i.*?o')"])
_content_query("search_glob_whole_word", [f"regexp_matches(lower(text), '(^|{_NW})the')"])
_content_query("search_wildcard_only", ["FALSE"])
_content_query("search_with_grams", [_has("ention"), "regexp_matches(lower(text), '(?s)ther.*?ing')"])
_name_query("search_name_only", "contains(lower(file_name), 'budget') OR contains(lower(relative_path), 'budget')", "budget")
_glob = lambda rx: f"regexp_matches(lower(file_name), '{rx}') OR regexp_matches(lower(relative_path), '{rx}')"
_name_query("search_name_glob", _glob(r"(?s)^budget.*$"), "budget*")
_name_query("search_name_qmark", _glob(r"(?s)^m.nutes\..*$"), "m?nutes.*")
_both_query("search_scope_both", "ort")
_both_query("search_scope_both_minutes", "ute")
_content_query("search_root", [_has("tion")], "f.root_id = 2", units="root_id = 2")
_content_query("filter_ext", [_has("tion")], "extension IN ('.txt', '.pdf')")
_content_query("filter_mtime", [_has("tion")], "modified_time BETWEEN 1704427200 AND 1706500000")
_content_query("filter_size", [_has("tion")], "size_bytes BETWEEN 500 AND 5000")
_content_query("filter_subfolder", [_has("tion")], r"starts_with(normalized_path, 'd:\corpus\en\src1\')")
_content_query("filter_subfolder_compat", [_has("tion")], r"starts_with(normalized_path, 'd:\corpus\en\src1')")
_content_query("filter_combined", [_has("tion")], "extension = '.txt' AND size_bytes >= 300 AND modified_time >= 1704427200")
_name_query("rank_name_bands", "contains(lower(file_name), 'budget_2561') OR contains(lower(relative_path), 'budget_2561')", "budget_2561")
_page("rank_relevance", "raw DESC, lower(file_name), normalized_path, file_id", 50, term="ort")
_page("rank_relevance_ascending", "raw ASC, lower(file_name) DESC, normalized_path DESC, file_id DESC", 50, term="ort")
_page("sort_name", "lower(file_name), file_id", 100)
_page("sort_type", "extension, lower(file_name), file_id", 100)
_page("sort_size", "size_bytes DESC, file_id", 100)
_page("sort_modified", "coalesce(modified_time, 0) DESC, file_id", 100)
_page("sort_path", "normalized_path, file_id", 100)
_page("page_offset", "raw DESC, lower(file_name), normalized_path, file_id", 20, 40)
_sql("name_scores", f"SELECT file_id, file_name, CAST({_band('budget')} AS DOUBLE) AS name_score FROM files WHERE contains(lower(file_name), 'budget')", _FILES)
_PLACES = "places AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sequence) AS place FROM units WHERE contains(lower(text), '{t}'))"
_sql("top_locations", "SELECT file_id, unit_id, sequence, line_no, place FROM places WHERE place <= 10", _FILES, _UNITS, _PLACES.format(t="tion"))
_sql(
    "neighbour_context",
    """SELECT a.file_id, a.sequence, count(*) AS n_units, string_agg(trim(b.text), ' ' ORDER BY b.sequence) AS joined
FROM units a JOIN units b ON a.file_id = b.file_id AND b.sequence BETWEEN a.sequence - 2 AND a.sequence + 2
WHERE contains(lower(a.text), 'ute') AND length(a.text) < 150 GROUP BY ALL""",
    _FILES, _UNITS,
)
for _name, _seen in (("row_context", "TRUE"), ("row_context_compat", "b.sequence <= 400 + CASE WHEN a.sequence <= 400 THEN 1 ELSE 0 END")):
    _sql(
        _name,
        f"""SELECT file_id, row_no, sequence, array_to_string(list_concat([text], coalesce(others, [])), '  |  ') AS context FROM (
  SELECT a.file_id, a.row_no, a.sequence, a.text, (list(b.text ORDER BY b.sequence) FILTER (b.text IS NOT NULL AND {_seen}))[1:8] AS others
  FROM cells a LEFT JOIN cells b ON a.file_id = b.file_id AND a.sheet = b.sheet AND a.row_no = b.row_no AND a.sequence <> b.sequence
  WHERE a.column_no = 3 AND a.text = '1-URGENT' GROUP BY a.file_id, a.row_no, a.sequence, a.text)""",
        f"cells AS ({CELLS_SQL})",
    )
_SPANS = """spans AS (SELECT file_id, sequence, pos, len FROM (
  SELECT file_id, sequence, list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, {n}) = '{t}') AS s, {n} AS len FROM units WHERE contains(lower(text), '{t}')), unnest(s) AS u(pos))"""
_sql("highlight_spans", "SELECT file_id, sequence, pos - 1 AS start_at, pos + 3 AS end_at FROM spans", _FILES, _UNITS, _SPANS.format(n=4, t="tion"))
_sql(
    "glob_spans",
    """SELECT file_id, sequence, start_at, start_at + length(found[i]) AS end_at FROM (
  SELECT file_id, sequence, i, found, CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + list_sum(list_transform([''] || found[1:i - 1], lambda p: length(p))) AS BIGINT) AS start_at
  FROM (SELECT file_id, sequence, string_split_regex(lower(text), '(?s)th.*?on.*?e') AS pieces, regexp_extract_all(lower(text), '(?s)th.*?on.*?e') AS found
        FROM units WHERE regexp_matches(lower(text), '(?s)th.*?on.*?e')) x, unnest(range(1, len(found) + 1)) AS u(i)) y""",
    _FILES, _UNITS,
)
_sql(
    "gram_lists",
    """SELECT gram, count(*) AS n_files FROM (
  SELECT DISTINCT file_id, unnest(list_transform(range(1, len(b) - 1), lambda i: ('0x' || b[i] || b[i + 1] || b[i + 2])::BIGINT)) AS gram
  FROM (SELECT file_id, regexp_extract_all(hex(encode(replace(lower(text), 'ß', 'ss'))), '..') AS b FROM units) x WHERE len(b) > 2) y
GROUP BY gram""",
    _FILES, _UNITS,
)
_sql("folded_texts", "SELECT doc_id, md5(replace(lower(coalesce(text, '')), 'ß', 'ss')) AS folded_md5, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'ß', '')) AS BIGINT) AS added FROM documents")
_sql(
    "part_bounds",
    """SELECT root_id, file_id // 50 AS part, min(size_bytes) AS least_size_bytes, max(size_bytes) AS most_size_bytes, min(modified_time) AS least_modified_time, max(modified_time) AS most_modified_time,
  min(normalized_path) AS least_normalized_path, max(normalized_path) AS most_normalized_path, string_agg(DISTINCT extension, ',' ORDER BY extension) AS extensions FROM files GROUP BY root_id, file_id // 50""",
    _FILES,
)
_sql(
    "newest_events",
    """SELECT normalized_path, modified_time, alive, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY normalized_path ORDER BY modified_time DESC, alive DESC, text DESC NULLS LAST) AS r FROM (
    SELECT 'd:' || chr(92) || 'in' || chr(92) || lower(source || chr(92) || 'D' || CAST(doc_id % 700 AS VARCHAR)) AS normalized_path, CAST(doc_id * k % 101 AS DOUBLE) AS modified_time, t IS NOT NULL AS alive, t AS text
    FROM (SELECT *, unnest([7, 13, 29]) AS k, unnest([text, 'short', NULL]) AS t FROM documents) e) f) g WHERE r = 1""",
)
_BUDGETS = """budgets AS (SELECT *, row_number() OVER w - 1 AS units_before, CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before
  FROM units WINDOW w AS (PARTITION BY file_id ORDER BY sequence))"""
_sql("budget_cut", "SELECT file_id, sequence, units_before, chars_before, length(text) AS n_chars FROM budgets WHERE units_before < 12 AND chars_before <= 2000", _FILES, _UNITS, _BUDGETS)
_sql(
    "truncated_files",
    """SELECT f.file_id, coalesce(bool_or(NOT ok), false) AS truncated, count(*) FILTER (ok) AS unit_count, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS char_count
FROM files f LEFT JOIN (SELECT file_id, length(text) AS n, units_before < 12 AND chars_before <= 2000 AS ok FROM budgets) b ON b.file_id = f.file_id GROUP BY f.file_id""",
    _FILES, _UNITS, _BUDGETS,
)
_sql(
    "merged_highlights",
    """SELECT file_id, sequence, CAST(sum(fresh) AS BIGINT) AS n_spans, count(*) AS n_marked FROM (
  SELECT file_id, sequence, CASE WHEN lag(p) OVER (PARTITION BY file_id, sequence ORDER BY p) = p - 1 THEN 0 ELSE 1 END AS fresh
  FROM (SELECT DISTINCT file_id, sequence, p FROM (
    SELECT file_id, sequence, list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, 2) IN ('th', 'he') OR substr(lower(text), i - 1, 2) IN ('th', 'he') AND i > 1) AS s
    FROM units WHERE contains(lower(text), 'th')), unnest(s) AS u(p)))
GROUP BY file_id, sequence""",
    _FILES, _UNITS,
)
_sql(
    "grouped_results",
    "SELECT file_id, match_count, string_agg(CAST(sequence AS VARCHAR), ',' ORDER BY sequence) AS sequences FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS match_count FROM places) WHERE place <= 10 GROUP BY file_id, match_count",
    _FILES, _UNITS, _PLACES.format(t="ute"),
)
_SOFT = r"[ \t\n,.;:!?)\]}ๆ]"


def _behind(at: str) -> str:
    """The place behind the last soft break in the 14 characters up to ``at``, else ``at``."""
    low = f"greatest(1, {at} - 13)"
    found = f"length(regexp_extract(substr(t, {low} + 1, {at} + 1 - {low}), '(?s)^.*{_SOFT}'))"
    return f"CASE WHEN {at} > 0 AND {found} > 0 THEN {low} + {found} ELSE {at} END"


def _ahead(at: str) -> str:
    return f"least({at} + length(regexp_extract(substr(t, {at} + 1, 14), '(?s)^.*?{_SOFT}')), length(t))"


_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_sql(
    "snippets_page",
    f"""SELECT a.file_id, a.sequence, place, CASE WHEN wider THEN b.snippet ELSE a.snippet END AS snippet, CASE WHEN wider THEN b.n ELSE a.n END AS n_highlights
FROM (SELECT * FROM made WHERE side = 'own') a JOIN found USING (file_id, sequence) LEFT JOIN (SELECT * FROM made WHERE side = 'wide') b USING (file_id, sequence),
  LATERAL (SELECT coalesce(length(a.snippet) < 150 AND length(b.snippet) > length(a.snippet), FALSE) AS wider) w""",
    _FILES, _UNITS, _content([_has("tion")]), _CONTENT_HITS.format(where="TRUE"), _PLACES.format(t="tion"),
    """page AS (SELECT file_id FROM (SELECT file_id, row_number() OVER (ORDER BY part + bonus + CASE WHEN coalesce(modified_time, 0) <> 0 AND newest > 0
      THEN 15.0 / (1.0 + greatest(0.0, (newest - modified_time) / 86400.0) / 90.0) ELSE 0 END DESC, lower(file_name), normalized_path, file_id) AS rank FROM hits) WHERE rank <= 50)""",
    "found AS (SELECT file_id, sequence, place, text FROM places JOIN page USING (file_id) WHERE place <= 10)",
    "near AS (SELECT a.file_id, a.sequence, string_agg(trim(b.text), ' ' ORDER BY b.sequence) AS joined FROM found a JOIN units b ON a.file_id = b.file_id AND b.sequence BETWEEN a.sequence - 2 AND a.sequence + 2 GROUP BY ALL)",
    "both_sides AS (SELECT file_id, sequence, 'own' AS side, text AS t, 130 AS context FROM found UNION ALL SELECT file_id, sequence, 'wide', joined, 260 FROM near)",
    "marks AS (SELECT *, list_filter(range(1, length(t) + 1), lambda i: substr(lower(t), i, 4) = 'tion')[1:32] AS places_at FROM both_sides)",
    "begins AS (SELECT *, greatest(0, places_at[1] - 1 - context) AS b FROM marks WHERE len(places_at) > 0)",
    "ends AS (SELECT *, least(length(t), greatest(places_at[1] + 3, coalesce(list_max(list_filter(places_at, lambda i: i + 3 - b <= 500)) + 3, 0)) + context) AS e FROM begins)",
    f"once AS (SELECT * EXCLUDE (b, e), {_behind('b')} AS b, {_ahead('e')} AS e FROM ends)",
    f"twice AS (SELECT * EXCLUDE (b, e), CASE WHEN e - b <= 500 THEN b ELSE {_behind('b')} END AS b, CASE WHEN e - b <= 500 THEN e ELSE {_ahead('(b + 500)')} END AS e FROM once)",
    f"shown AS (SELECT *, trim(regexp_replace(substr(t, b + 1, e - b), '{_BLANK}', ' ', 'g')) AS body FROM twice)",
    "inside AS (SELECT *, list_filter(range(1, length(body) + 1), lambda i: substr(lower(body), i, 4) = 'tion')[1:32] AS again FROM shown)",
    "made AS (SELECT file_id, sequence, side, CASE WHEN b > 0 THEN '… ' ELSE '' END || body || CASE WHEN e < length(t) THEN ' …' ELSE '' END AS snippet, len(list_filter(again, lambda i: NOT list_contains(again, i - 4))) AS n FROM inside)",
)
_sql(
    "name_highlights",
    """SELECT file_id, CAST(sum(fresh) AS BIGINT) AS n_spans, count(*) AS n_marked FROM (
  SELECT file_id, CASE WHEN lag(p) OVER (PARTITION BY file_id ORDER BY p) = p - 1 THEN 0 ELSE 1 END AS fresh
  FROM (SELECT DISTINCT file_id, p FROM (SELECT file_id, i, substr(n, i, 6) = 'budget' AS a, substr(n, i, 2) = 'ud' OR substr(n, i, 2) = 'nu' AS c
      FROM (SELECT file_id, lower(file_name) AS n, unnest(range(1, length(file_name) + 1)) AS i FROM files)), unnest(CASE WHEN a THEN range(i, i + 6) WHEN c THEN range(i, i + 2) ELSE [] END) AS u(p)))
GROUP BY file_id""",
    _FILES,
)
_sql("paragraph_search", "SELECT conv_id AS file_id, count(*) AS match_count, CAST(min(turn) + 1 AS BIGINT) AS first_sequence FROM conversations WHERE contains(lower(text), 'tion') GROUP BY conv_id")
_sql("status_counts", "SELECT root_id, content_status, count(*) AS n FROM files GROUP BY ALL", _FILES)
_sql("extension_counts", "SELECT root_id, extension, count(*) AS n FROM files GROUP BY ALL", _FILES)
_sql("root_counts", "SELECT root_id, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM files GROUP BY ALL", _FILES)
_sql("roots_by_name", r"SELECT n_nationkey AS root_id, 'D:\' || n_name AS display_path FROM nation ORDER BY lower(display_path)")
_sql("units_of_file", "SELECT file_id, sequence, line_no, text FROM units WHERE file_id = 7 ORDER BY sequence LIMIT 50", _FILES, _UNITS)
_RUNS = "runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS root_id, CASE WHEN o_orderkey % 5 = 0 THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM orders)"
_sql("latest_run", "SELECT root_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY run_id DESC) AS r FROM runs) WHERE r = 1", _RUNS)
_sql("abandoned_runs", "SELECT root_id, CASE status WHEN 'running' THEN 'abandoned' ELSE status END AS status, count(*) AS n FROM runs GROUP BY ALL", _RUNS)
_OLD = r"""old AS (SELECT file_id, root_id, normalized_path, size_bytes + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes,
  modified_time + CASE WHEN file_id % 3 = 0 THEN 0.5 ELSE 0 END AS modified_time, CASE WHEN file_id % 13 = 0 THEN 0 ELSE 1 END AS parser_version FROM files WHERE file_id % 10 <> 0
  UNION ALL SELECT i, 2, 'd:\gone\' || CAST(i AS VARCHAR), 1, 1.0, 1 FROM range(9000000, 9000020) t(i))"""
_CHANGES = """changes AS (SELECT coalesce(f.root_id, o.root_id) AS root_id, coalesce(f.normalized_path, o.normalized_path) AS normalized_path, f.size_bytes, o.file_id AS old_id,
  CASE WHEN f.file_id IS NULL THEN 'deleted' WHEN o.file_id IS NULL THEN 'new'
       WHEN o.parser_version = 1 AND o.size_bytes = f.size_bytes AND abs(o.modified_time - f.modified_time) <= 1 THEN 'unchanged' ELSE 'changed' END AS change
  FROM files f FULL JOIN old o ON f.root_id = o.root_id AND f.normalized_path = o.normalized_path)"""
_sql("fingerprint_unchanged", "SELECT root_id, normalized_path, change FROM changes", _FILES, _OLD, _CHANGES)
_sql(
    "merge_upsert",
    "SELECT root_id, normalized_path, old_id AS kept_id, CASE WHEN change IN ('new', 'changed') THEN c.size_bytes ELSE o.size_bytes END AS size_bytes, CAST(CASE WHEN change IN ('new', 'changed') THEN 1 ELSE o.parser_version END AS INTEGER) AS parser_version FROM changes c LEFT JOIN old o ON c.old_id = o.file_id",
    _FILES, _OLD, _CHANGES.replace("o.file_id AS old_id", "o.file_id AS old_id"),
)
ORACLE_SQL["merge_upsert"] = ORACLE_SQL["merge_upsert"].replace("FROM changes c LEFT JOIN old o ON c.old_id = o.file_id", "FROM changes c LEFT JOIN (SELECT file_id, size_bytes, parser_version FROM old) o ON c.old_id = o.file_id")
_sql("stale_files", "SELECT file_id, normalized_path FROM files WHERE last_seen_run_id <> 2", _FILES)
_sql("orphan_units", "SELECT file_id, sequence FROM units WHERE file_id % 11 = 0", _FILES, _UNITS)
_sql("replaced_units", "SELECT file_id, count(*) AS n FROM units WHERE file_id % 7 <> 0 OR sequence = 1 GROUP BY file_id", _FILES, _UNITS)
_STRIP = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_sql(
    "clean_text",
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
  '[\x{{2028}}\x{{2029}}\x0b\x0c\r]', chr(10), 'g'), '[\x00-\x08\x0e-\x1f\x7f]', ' ', 'g'), '[\x{{feff}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{ad}}]', '', 'g'), '[ \t\x{{a0}}]{{2,}}', ' ', 'g'), '^{_STRIP}|{_STRIP}$', '', 'g')) AS digest FROM documents""",
)
_sql(
    "path_normalise",
    r"""SELECT file_id, lower('d:\corpus\' || relative_path) AS path, extension AS ext, left(file_name, length(file_name) - length(extension)) AS stem,
  starts_with(normalized_path, 'd:\corpus\en\') AS within, CASE WHEN starts_with(normalized_path, 'd:\corpus\en\') THEN substr(normalized_path, 14) ELSE normalized_path END AS rel, 'D' AS drive FROM files""",
    _FILES,
)
_sql("mime_categories", "SELECT CASE extension WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'word' WHEN '.xlsx' THEN 'excel' WHEN '.txt' THEN 'text' ELSE 'other' END AS category, count(*) AS n FROM files GROUP BY ALL", _FILES)
_sql("fingerprints", "SELECT file_id, fingerprint AS made, TRUE AS same, size_bytes AS size, CAST(round(modified_time * 1000) AS BIGINT) AS mtime_ms FROM files", _FILES)
# the letter at place j from the right stands in names of numbers from 26^0 + ... + 26^j on
_LETTER = "CASE WHEN p_partkey >= {least} THEN chr(CAST(65 + ((p_partkey - {least}) // {power}) % 26 AS INTEGER)) ELSE '' END"
_sql("excel_columns", f"SELECT p_partkey, {' || '.join(_LETTER.format(least=sum(26**i for i in range(j + 1)), power=26**j) for j in range(13, -1, -1))} AS column_name FROM part")
_UNIT = "CASE WHEN s < 1024 THEN printf('%d B', s) WHEN s < 1048576 THEN format('{:,.1f} KB', s / 1024.0) WHEN s < 1073741824 THEN format('{:,.1f} MB', s / 1048576.0) WHEN s < 1099511627776 THEN format('{:,.1f} GB', s / 1073741824.0) ELSE format('{:,.1f} TB', s / 1099511627776.0) END"
_sql("format_sizes", f"SELECT o_orderkey, {_UNIT} AS size FROM (SELECT o_orderkey, o_orderkey * 524288 AS s FROM orders)")
_sql(
    "scan_skip_reasons",
    """SELECT CASE WHEN file_id % 31 = 0 THEN 'temporary' WHEN file_id % 19 = 0 THEN 'executable' WHEN file_id % 41 = 0 THEN 'hidden'
  WHEN file_id % 37 = 0 OR size_bytes = 0 THEN 'empty_file' WHEN size_bytes * 100000 > 524288000 THEN 'too_large' END AS skip_reason, count(*) AS n FROM files GROUP BY 1""",
    _FILES,
)
_sql("skip_counts", "SELECT CASE WHEN file_id % 5 = 0 THEN 'not_supported' ELSE 'hidden' END AS skip_reason, count(*) AS n, file_id % 5 <> 0 AS headline FROM files WHERE file_id % 5 = 0 OR file_id % 7 = 0 GROUP BY ALL", _FILES)
_count = lambda o: f"count(*) FILTER (outcome = '{o}') AS files_{o}"
_sql(
    "run_counters",
    f"SELECT run_id, count(*) AS files_discovered, {', '.join(map(_count, ('indexed', 'unchanged', 'no_text', 'failed', 'skipped', 'deleted')))} FROM (SELECT last_seen_run_id AS run_id, CASE WHEN file_id % 3 = 0 THEN 'unchanged' ELSE content_status END AS outcome FROM files) GROUP BY run_id",
    _FILES,
)
_sql("touch_seen", "SELECT CAST(CASE WHEN file_id % 5 = 0 THEN 3 ELSE last_seen_run_id END AS BIGINT) AS last_seen_run_id, count(*) AS n FROM files GROUP BY 1", _FILES)
_sql("remove_deleted", "SELECT file_id FROM files WHERE last_seen_run_id = 2", _FILES)
_sql("delete_files", "SELECT root_id, count(*) AS n FROM files WHERE file_id % 5 <> 0 GROUP BY ALL", _FILES)
_sql("mark_status", "SELECT root_id, CASE WHEN file_id % 5 = 0 THEN 'stale' ELSE content_status END AS content_status, count(*) AS n FROM files GROUP BY ALL", _FILES)
_sql("cascade_delete", "SELECT root_id, count(*) AS n FROM units WHERE root_id <> 2 GROUP BY ALL", _FILES, _UNITS)
_sql("existence_flag", "SELECT file_id, file_id % 4 <> 1 AS exists FROM files", _FILES)
_sql(
    "set_operations",
    "SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM units WHERE contains(lower(text), 'tion')) THEN 'both' ELSE 'name' END AS side FROM files WHERE contains(lower(file_name), 'budget') OR contains(lower(relative_path), 'budget')",
    _FILES, _UNITS,
)
_sql("format_timestamps", "SELECT file_id, strftime(to_timestamp(modified_time) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS shown, strftime(to_timestamp(modified_time) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM files", _FILES)
_sql("location_labels", "SELECT file_id, sequence, 'Line ' || CAST(line_no AS VARCHAR) AS label FROM units", _FILES, _UNITS)
_sql("display_text", rf"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{_STRIP}', ' ', 'g'))) AS digest FROM documents")
_sql("content_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
_sql("end_of_days", "SELECT o_orderkey, epoch(CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP)) - 1 AS last_second FROM orders")
_sql(
    "log_lines",
    r"""SELECT file_id, left(regexp_replace(regexp_replace('could not read D:\corpus\' || relative_path || ' and /tmp/x' || chr(9) || 'now',
  '[\x00-\x1f\x7f]+', ' ', 'g'), '([A-Za-z]:|\\\\|/)[^\s''"]*', '<path>', 'g'), 200) AS line FROM files""",
    _FILES,
)
_sql("term_units", "SELECT term, file_id, unit_id FROM (SELECT file_id, unit_id, unnest([CASE WHEN contains(lower(text), 'tion') THEN 0 END, CASE WHEN regexp_matches(lower(text), '(?s)th.*?ing') THEN 1 END, CASE WHEN contains(lower(text), 'ute') THEN 2 END]) AS term FROM units) WHERE term IS NOT NULL", _FILES, _UNITS)
_sql("status_labels", "SELECT CASE content_status WHEN 'indexed' THEN 'Indexed' WHEN 'no_text' THEN 'No text' ELSE 'Failed' END AS label, count(*) AS n FROM files GROUP BY ALL", _FILES)
