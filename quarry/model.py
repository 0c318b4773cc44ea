"""Data model: table schemas, enumerations, limits, and the search request."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import types as T

# Limits that are part of the semantics.
MAX_QUERY_LENGTH = 500
MAX_TERMS = 24
MAX_WILDCARDS_PER_TERM = 6
MAX_WILDCARDS = 12
DEFAULT_LIMIT, MAX_LIMIT = 200, 5000
SNIPPETS_PER_FILE = 10
SNIPPET_LENGTH = 500
SNIPPET_CONTEXT = 130
CANDIDATE_UNITS_PER_FILE = 80
INDEXED_FRAGMENT = 3
MAX_FRAGMENT = 120
NEIGHBOUR_CHARS = 150
NEIGHBOUR_UNITS = 2
ROW_CELLS, ROW_SCAN = 8, 400
MTIME_EPSILON = 1.0
MAX_UNIT_CHARS = 200_000
MAX_CELL_CHARS = 100_000
MAX_LINE_CHARS = 100_000
MAX_LABEL_CHARS = 200
MAX_FILE_MB, CEILING_FILE_MB = 500, 4096
MAX_PAGES = 20_000
MAX_DOCX_UNITS = 200_000
MAX_CELLS = 500_000
MAX_LINES = 2_000_000
MAX_DOCUMENT_CHARS = 40_000_000
#: A unit's id is its file's id times this, plus its sequence: a sequence is a position in an array, so ids never meet.
UNIT_STRIDE = 1 << 31
SCHEMA_VERSION = 1
PARSER_VERSION = 1

CORE_EXTENSIONS = (".pdf", ".docx", ".xlsx", ".txt")
OPTIONAL_EXTENSIONS = (".md", ".csv", ".log")
LOCATION_TYPES = ("page", "paragraph", "table_cell", "header", "footer", "sheet_cell", "line")
NEIGHBOUR_TYPES = ("line", "paragraph", "table_cell", "header", "footer")


# The enumerations' names.
class Scope(StrEnum):
    BOTH = "both"
    NAME = "name"
    CONTENT = "content"


class SortField(StrEnum):
    RELEVANCE = "relevance"
    NAME = "name"
    TYPE = "type"
    SIZE = "size"
    MODIFIED = "modified"
    PATH = "path"


class ContentStatus(StrEnum):
    INDEXED = "indexed"
    NO_TEXT = "no_text"
    SKIPPED = "skipped"
    FAILED = "failed"
    STALE = "stale"


class Outcome(StrEnum):
    OK = "ok"
    NO_TEXT = "no_text"
    CORRUPT = "corrupt"
    PASSWORD_PROTECTED = "password_protected"
    TOO_LARGE = "too_large"
    EMPTY = "empty"
    MISSING = "missing"
    DENIED = "denied"
    UNSUPPORTED = "unsupported"
    ERROR = "error"


@dataclass(frozen=True)
class Filters:
    extensions: frozenset[str] = frozenset()
    modified_after: float | None = None
    modified_before: float | None = None
    min_size: int | None = None
    max_size: int | None = None
    subfolder: str | None = None

    @property
    def active(self) -> bool:
        return bool(self.extensions or self.subfolder) or any(x is not None for x in (self.modified_after, self.modified_before, self.min_size, self.max_size))


@dataclass(frozen=True)
class Request:
    """``compat`` reproduces candidate-level AND and counts; the default verifies every term."""

    query: str
    root_id: int | None = None
    scope: Scope = Scope.BOTH
    match_case: bool = False
    exact_phrase: bool = False
    whole_word: bool = False
    filters: Filters = field(default_factory=Filters)
    sort: SortField = SortField.RELEVANCE
    descending: bool = True
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    compat: bool = False
    snippets_per_file: int = SNIPPETS_PER_FILE


LOCATION = T.StructType([
    T.StructField(n, t) for n, t in (
        ("page", T.IntegerType()), ("page_label", T.StringType()), ("paragraph", T.IntegerType()), ("table", T.IntegerType()),
        ("row", T.IntegerType()), ("column", T.IntegerType()), ("section", T.IntegerType()), ("sheet", T.StringType()),
        ("cell", T.StringType()), ("type", T.StringType()), ("line", T.IntegerType()), ("lines", T.IntegerType()),
    )
])
UNIT = T.StructType([
    T.StructField("sequence", T.IntegerType()), T.StructField("location_type", T.StringType()), T.StructField("location_label", T.StringType()),
    T.StructField("location", LOCATION), T.StructField("text", T.StringType()),
])
PARSED = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("error_code", T.StringType()),
    T.StructField("error_message", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("encoding", T.StringType()),
    T.StructField("page_count", T.IntegerType()), T.StructField("sheet_count", T.IntegerType()), T.StructField("line_count", T.IntegerType()),
    T.StructField("truncated", T.BooleanType()), T.StructField("units", T.ArrayType(UNIT)),
])
FILES = T.StructType([
    T.StructField(n, t) for n, t in (
        ("file_id", T.LongType()), ("root_id", T.IntegerType()), ("display_path", T.StringType()), ("normalized_path", T.StringType()),
        ("relative_path", T.StringType()), ("file_name", T.StringType()), ("file_name_folded", T.StringType()), ("extension", T.StringType()),
        ("mime_category", T.StringType()), ("size_bytes", T.LongType()), ("created_time", T.DoubleType()), ("modified_time", T.DoubleType()),
        ("fingerprint", T.StringType()), ("content_status", T.StringType()), ("parser_version", T.IntegerType()), ("unit_count", T.IntegerType()),
        ("char_count", T.LongType()), ("indexed_at", T.TimestampType()), ("last_seen_run_id", T.LongType()), ("error_code", T.StringType()),
        ("error_message", T.StringType()), ("truncated", T.BooleanType()), ("warnings", T.StringType()),
    )
])
SKIPS = T.StructType([T.StructField("root_id", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("skip_reason", T.StringType())])
ROOTS = T.StructType([T.StructField("root_id", T.IntegerType()), T.StructField("display_path", T.StringType()), T.StructField("normalized_path", T.StringType())])
UNITS = T.StructType([T.StructField("unit_id", T.LongType()), T.StructField("file_id", T.LongType()), T.StructField("root_id", T.IntegerType()), *UNIT.fields])
RUNS = T.StructType([
    T.StructField(n, t) for n, t in (
        ("run_id", T.LongType()), ("root_id", T.IntegerType()), ("started_at", T.TimestampType()), ("finished_at", T.TimestampType()), ("status", T.StringType()),
        ("mode", T.StringType()), ("files_discovered", T.LongType()), ("files_indexed", T.LongType()), ("files_unchanged", T.LongType()),
        ("files_no_text", T.LongType()), ("files_failed", T.LongType()), ("files_skipped", T.LongType()), ("files_deleted", T.LongType()),
        ("files_new", T.LongType()), ("elapsed_seconds", T.DoubleType()), ("application_version", T.StringType()),
    )
])
