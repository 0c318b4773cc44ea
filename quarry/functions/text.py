"""Scalar normalisation functions as Columns (JVM-side), with Python twins where a planner needs them."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import model as M

#: Python's whitespace for str.strip and \s.
_SPACES = r"\x09-\x0d\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: The same set as a string of characters.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


#: Lower-case characters that full case folding changes, by Python's rule: to one other character, or to several.
_CHANGED = {c: c.casefold() for c in map(chr, range(0x110000)) if c == c.lower() != c.casefold()}
_ONE, _MANY = ({c: to for c, to in _CHANGED.items() if (len(to) == 1) == one} for one in (True, False))


def _class(characters: Iterable[str], gap: int) -> str:
    """A regex class of the characters, and of what lies in gaps of up to ``gap`` between them."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if ranges and c - ranges[-1][1] <= gap:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


#: Where a folded character may be: coarse, as few ranges are tested faster.  Where one is that becomes several.
_MAYBE, _EXPANDS = _class(_CHANGED, 64), _class(_MANY, 1)
#: Characters that folding gives and lower-casing does not.
FOLD_GIVES = frozenset("".join(_CHANGED.values()))


def may_fold(c: Column) -> Column:
    """False where ``folded`` is but ``lower``."""
    return (F.octet_length(c) != F.length(c)) & F.lower(c).rlike(_MAYBE)


def _each(c: Column) -> Column:
    """The characters of a lower-cased text, each as folding gives it."""
    several = F.create_map(*(F.lit(x) for pair in _MANY.items() for x in pair))
    one = F.translate(c, "".join(_ONE), "".join(_ONE.values()))
    return F.transform(F.split(one, ""), lambda x: F.coalesce(F.try_element_at(several, x), x))


def folded(c: Column) -> Column:
    """Full case folding: lower case, and every character by itself, wherever it stands, as Python's casefold gives it (``ß`` is ``ss``, a final sigma a sigma)."""
    low = F.lower(c)
    one = F.translate(low, "".join(_ONE), "".join(_ONE.values()))
    return F.when(~may_fold(c), low).when(~low.rlike(_EXPANDS), one).otherwise(F.array_join(_each(low), ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Numbers that ``running`` sums up together: appending to an array copies it.
_CHUNK = 256


def running(values: Column) -> Column:
    """The running sums of an array of ints."""

    def sums(own: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(own, start, lambda acc, k: F.struct((acc["at"] + k).alias("at"), F.concat(acc["all"], F.array(acc["at"] + k)).alias("all")), lambda acc: acc["all"])

    def chunked(own: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _CHUNK).cast("int"))
        chunk = lambda j: F.slice(own, j * _CHUNK + 1, F.lit(_CHUNK))
        ends = sums(F.transform(numbers, lambda j: F.aggregate(chunk(j), F.lit(0), lambda acc, k: acc + k)), F.lit(0))
        return let(ends, lambda known: F.flatten(F.transform(numbers, lambda j: sums(chunk(j), F.when(j == 0, 0).otherwise(F.get(known, j - 1))))))

    return let(values, lambda own: F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(chunked(own)))


#: A noncharacter, which no text holds.
_FILLER = "\ufdd0"
#: Characters that folding makes two or three of.
_LONGER = {n: _class((c for c in map(chr, range(0x110000)) if len(c.casefold()) == n), 1) for n in (2, 3)}


def fold_padded(c: Column) -> Column:
    """The text with fillers behind characters that folding makes several of, so that its offsets are those of the folded text."""
    for n, kind in _LONGER.items():
        c = F.regexp_replace(c, f"({kind})", "$1" + _FILLER * (n - 1))
    return c


def unpadded(padded: Column, at: Column) -> Column:
    """How many characters of the text begin before an offset of its folded text."""
    return F.length(F.translate(F.substring(padded, F.lit(1), at), _FILLER, ""))


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def clean_text(c: Column, limit: int | None = M.MAX_UNIT_CHARS) -> Column:
    """Line separators to LF, controls to spaces, invisible characters out, runs of blanks to one space, strip, cut (whole where limit is None)."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(c, r"[\u2028\u2029\x0b\x0c\r]", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0e-\x1f\x7f]", " ")
    c = F.translate(c, "\ufeff\u200b\u200c\u200d\u2060\u00ad", "")
    c = F.regexp_replace(c, r"[ \t\u00a0]{2,}", " ")
    c = stripped(c)
    if limit is None:
        return c
    return F.when(F.length(c) > limit, F.regexp_replace(F.substring(c, 1, limit), f"[{_SPACES}]+$", "")).otherwise(c)


_PY_CLEAN = [(re.compile("[\u2028\u2029\x0b\x0c\r]"), "\n"), (re.compile(r"[\x00-\x08\x0e-\x1f\x7f]"), " "), (re.compile("[\ufeff\u200b\u200c\u200d\u2060\u00ad]"), ""), (re.compile("[ \t\u00a0]{2,}"), " ")]


def clean_str(text: str, limit: int = M.MAX_UNIT_CHARS) -> str:
    """``clean_text`` for parsers."""
    for pattern, to in _PY_CLEAN:
        text = pattern.sub(to, text)
    text = text.strip()
    return text[:limit].rstrip() if len(text) > limit else text


def for_display(c: Column) -> Column:
    """Whitespace runs to one space, stripped."""
    return stripped(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{_SPACES}]+", " "))


def normalized_path(c: Column) -> Column:
    """Separators unified and collapsed, case folded, no trailing separator (see ``display_path_str`` for what else a path may need)."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "/", r"\\"), r"(?<!^)\\{2,}", r"\\")
    c = folded(c)
    return F.when(F.length(c) > 3, F.regexp_replace(c, r"\\+$", "")).otherwise(c)


def display_path_str(raw: str) -> str:
    """Quotes and long-path prefix off, NFC, one kind of separator, lexical . and .. resolved inside the anchor."""
    text = unicodedata.normalize("NFC", raw.strip().strip('"').strip("'").strip())
    for prefix, instead in (("\\\\?\\UNC\\", "\\\\"), ("\\\\?\\", "")):
        if text.startswith(prefix):
            text = instead + text[len(prefix) :]
            break
    text = text.replace("/", "\\")
    anchor = ""
    if m := re.match(r"[A-Za-z]:", text):
        anchor, text = m[0] + "\\", text[2:]
    elif text.startswith("\\\\"):
        anchor, text = "\\\\", text[2:]
    elif text.startswith("\\"):
        anchor = "\\"
    parts: list[str] = []
    for part in text.split("\\"):
        if part == "..":
            if parts and parts[-1] != "..":
                parts.pop()
            elif not anchor:
                parts.append(part)
        elif part not in ("", "."):
            parts.append(part)
    return anchor + "\\".join(parts)


def normalized_path_str(raw: str) -> str:
    path = display_path_str(raw).casefold()
    return path.rstrip("\\") if len(path) > 3 else path


def is_within(path: Column, root: Column) -> Column:
    """Component-safe: ``d:\\ab`` is not within ``d:\\a``."""
    base = F.regexp_replace(root, r"\\$", "")
    return (path == base) | path.startswith(F.concat(base, F.lit("\\")))


def relative_path(path: Column, root: Column) -> Column:
    base = F.regexp_replace(root, r"\\$", "")
    return F.when(is_within(path, root), path.substr(F.length(base) + 2, F.length(path))).otherwise(path)


def extension_of(name: Column) -> Column:
    """From the last dot, lower case; a leading dot does not count."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))


def stem_of(name: Column) -> Column:
    """The name without its last dot and what follows (a name without a dot as it is)."""
    return F.when(name.contains("."), F.regexp_replace(name, r"(?s)\.[^.]*$", "")).otherwise(name)


def drive_letter(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"^([A-Za-z]):", 1))


def is_drive_root(path: Column) -> Column:
    return path.rlike(r"^[A-Za-z]:\\?$")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, r"\\"), lambda x: x != "")


def format_size(size: Column) -> Column:
    """Binary units with one decimal; bytes as they are."""
    out = F.concat(F.format_number(size / 1024.0**4, 1), F.lit(" TB"))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(size < 1024 ** (k + 1), F.concat(F.format_number(size / float(1024**k), 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(F.format_number(size, 0), F.lit(" B"))).otherwise(out)


def excel_column_name(index: int) -> str:
    """1 -> A, 27 -> AA."""
    if index < 1:
        return ""
    return excel_column_name((index - 1) // 26) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[(index - 1) % 26]


def column_name(index: Column) -> Column:
    """``excel_column_name`` for any long: at most 14 letters."""
    rest, name = F.greatest(index.cast("long"), F.lit(0)), F.lit("")
    for _ in range(14):
        before = rest - 1
        name = F.concat(F.when(rest >= 1, F.chr(before % 26 + 65)).otherwise(""), name)
        rest = F.call_function("div", before, F.lit(26))  # 0 stays 0
    return F.when(index.isNotNull(), name)


_CATEGORIES = {".pdf": "pdf", ".docx": "word", ".xlsx": "excel", ".txt": "text", ".md": "text", ".csv": "text", ".log": "text"}


def mime_category(extension: Column) -> Column:
    pairs = [F.lit(x) for kv in _CATEGORIES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[extension], F.lit("other"))


def fingerprint(size: Column, mtime: Column, parser_version: Column) -> Column:
    """``size:milliseconds:parser``; half-even rounding."""
    return F.concat_ws(":", size.cast("string"), F.rint(mtime * 1000).cast("long").cast("string"), parser_version.cast("string"))


def parse_fingerprint(c: Column) -> Column:
    """struct<size, mtime_ms, parser>; null when malformed."""
    parts = F.split(c, ":")
    numbers = [parts[i].try_cast("long") for i in range(3)]
    good = (F.size(parts) == 3) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    return F.when(good, F.struct(*(n.alias(a) for n, a in zip(numbers, ("size", "mtime_ms", "parser")))))


def is_unchanged(old_parser: Column, old_size: Column, old_mtime: Column, parser: Column, size: Column, mtime: Column) -> Column:
    return F.coalesce((old_parser == parser) & (old_size == size) & (F.abs(old_mtime - mtime) <= M.MTIME_EPSILON), F.lit(False))


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def fast_content_hash(data: bytes, edge: int = 256 << 10) -> str:
    """blake2b-16 of the size and both ends."""
    ends = data if len(data) <= edge else data[:edge] + data[-edge:]
    return hashlib.blake2b(b"%d" % len(data) + ends, digest_size=16).hexdigest()


def sanitize_for_log(c: Column, limit: int = 200) -> Column:
    """No controls, no paths, bounded."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]+", " ")
    c = F.regexp_replace(c, r"(?:[A-Za-z]:|\\\\|/)[^\s'\"]*", "<path>")
    return F.substring(c, 1, limit)


_LABELS = {
    "page": ("Page %d", ["page"]), "paragraph": ("Paragraph %d", ["paragraph"]), "table_cell": ("Table %d, row %d, column %d", ["table", "row", "column"]),
    "sheet_cell": ("Sheet: %s, Cell: %s", ["sheet", "cell"]), "line": ("Line %d", ["line"]), "header": ("Header", []), "footer": ("Footer", []),
}


def location_label(kind: Column, location: Column) -> Column:
    """English labels; sheet names beyond 60 characters are elided."""
    out = F.lit("")
    for name, (form, keys) in _LABELS.items():
        args = [F.when(F.length(location[k]) > 60, F.concat(F.substring(location[k], 1, 59), F.lit("…"))).otherwise(location[k]) if k == "sheet" else location[k] for k in keys]
        out = F.when(kind == name, F.format_string(form, *args) if args else F.lit(form)).otherwise(out)
    return out


def location_label_str(kind: str, location: dict) -> str:
    form, keys = _LABELS[kind]
    args = [location.get(k) for k in keys]
    return (form % tuple(a[:59] + "…" if isinstance(a, str) and len(a) > 60 else a for a in args))[: M.MAX_LABEL_CHARS]


def row_context(cell: Column, others: Column, limit: int = M.SNIPPET_LENGTH) -> Column:
    """Non-blank pieces for display, joined by two spaces, a bar and two spaces, cut at ``limit``."""
    pieces = F.filter(F.concat(F.array(cell), others), lambda x: x.isNotNull() & (stripped(x) != ""))
    joined = F.concat_ws("  |  ", F.transform(pieces, for_display))
    return F.when(F.length(joined) > limit, F.concat(F.regexp_replace(F.substring(joined, 1, limit), f"[{_SPACES}]+$", ""), F.lit("…"))).otherwise(joined)


def end_of_day(date: Column) -> Column:
    """Epoch seconds of the last second of a date."""
    return F.unix_timestamp(F.date_add(date, 1).cast("timestamp")).cast("double") - 1


def format_timestamp(epoch: Column) -> Column:
    """Session time zone, to the minute; empty for none."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"), F.lit(""))


def iso_timestamp(epoch: Column) -> Column:
    """UTC to the second, as stored in text columns."""
    return F.concat(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


STATUS_LABELS = {
    "en": {"indexed": "Indexed", "no_text": "No text", "skipped": "Skipped", "failed": "Failed", "stale": "Out of date"},
    "th": {"indexed": "จัดทำดัชนีแล้ว", "no_text": "ไม่มีข้อความ", "skipped": "ข้าม", "failed": "ล้มเหลว", "stale": "ล้าสมัย"},
}
SKIP_LABELS = {
    "en": {"temporary": "Temporary file", "executable": "Executable", "not_supported": "Type not supported", "system": "System file", "hidden": "Hidden file", "link": "Link", "empty_file": "Empty file", "too_large": "Too large"},
    "th": {"temporary": "ไฟล์ชั่วคราว", "executable": "ไฟล์โปรแกรม", "not_supported": "ชนิดไฟล์ไม่รองรับ", "system": "ไฟล์ระบบ", "hidden": "ไฟล์ซ่อน", "link": "ลิงก์", "empty_file": "ไฟล์ว่าง", "too_large": "ไฟล์ใหญ่เกินไป"},
}


def label(code: Column, table: dict[str, dict[str, str]], language: str = "en") -> Column:
    """A code's text in a language; unknown codes as they are."""
    pairs = [F.lit(x) for kv in table.get(language, table["en"]).items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code], code)
