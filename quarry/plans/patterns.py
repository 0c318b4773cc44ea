"""Terms -> Spark Columns and, for snippets, Python spans.

Wildcards become atomic-group regexes, which match in linear time; user text is
always quoted.  LIKE is never used: its matcher backtracks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import FOLD_GIVES, folded, may_fold
from quarry.plans.query import Term

#: A word character: letters and numbers of any script, and the underscore.
WORD = r"[\p{L}\p{N}_]"
_LEFT, _RIGHT = rf"(?<!{WORD})", rf"(?!{WORD})"
_META = re.compile(r"[\\^$.|?*+()\[\]{}\-&~#]")


def quoted(text: str) -> str:
    """``text`` as a literal for Java's and Python's regex dialects."""
    return _META.sub(lambda m: "\\" + m[0], text)


def segment_regex(text: str) -> str:
    """A stretch between two ``*``."""
    return "".join("." if c == "?" else quoted(c) for c in text)


def content_regex(text: str, whole_word: bool = False) -> str:
    """The pattern found somewhere in a value."""
    if "*" not in text and "?" not in text:
        return f"(?s){_LEFT}{quoted(text)}{_RIGHT}" if whole_word else f"(?s){quoted(text)}"
    parts = [segment_regex(s) for s in text.split("*")]
    chain = [p for p in parts if p]
    if not whole_word or text.startswith("*"):
        body = "^" + "".join(f"(?>.*?{p})" for p in chain)
    else:
        body = _LEFT + chain[0] + "".join(f"(?>.*?{p})" for p in chain[1:])
    return "(?s)" + body + (_RIGHT if whole_word and not text.endswith("*") else "")


def name_regex(text: str) -> str:
    """A wildcard pattern that spans a whole name."""
    parts = [segment_regex(s) for s in text.split("*")]
    if len(parts) == 1:
        return rf"(?s)^{parts[0]}\z"
    middle = "".join(f"(?>.*?{p})" for p in parts[1:-1] if p)
    return rf"(?s)^{parts[0]}{middle}.*{parts[-1]}\z"


def _tested(value: Column, text: str, match_case: bool, test: Callable[[Column, str], Column]) -> Column:
    """``test(value, text)``; without regard to case, of both in lower case or of both folded.

    Lower case keeps the number of characters, as ``?`` counts them; folding finds
    what differs in form alone.  It is tried only where it can tell more: where the
    value has a character that folding changes, and the text one that folding gives.
    """
    if match_case:
        return test(value, text)
    low = test(F.lower(value), text.lower())
    if text.lower() != text.casefold():
        return low | test(folded(value), text.casefold())
    return low | (may_fold(value) & test(folded(value), text)) if FOLD_GIVES & set(text.lower()) else low


def _has(value: Column, text: str, match_case: bool) -> Column:
    return _tested(value, text, match_case, lambda own, needle: own.contains(F.lit(needle)))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def candidate(term: Term, value: Column) -> Column:
    """The cheap case-blind superset: every indexed fragment occurs; short terms are tested directly."""
    if term.fragments:
        return all_of([_has(value, f, False) for f in term.fragments])
    return matches(term, value, False, False)


def matches(term: Term, value: Column, match_case: bool, whole_word: bool) -> Column:
    """Full semantics on a content value; substring prefilters stand before the regex."""
    if not term.glob and not whole_word:
        return _has(value, term.text, match_case)
    whole = _tested(value, term.text, match_case, lambda own, text: own.rlike(content_regex(text, whole_word)))
    return all_of([*(_has(value, r, match_case) for r in term.runs if r), whole])


def unit_matches(term: Term, value: Column, match_case: bool, whole_word: bool) -> Column:
    """``matches``, but a term of wildcards alone never matches content."""
    return matches(term, value, match_case, whole_word) if term.runs else F.lit(False)


def name_matches(term: Term, value: Column, match_case: bool, whole_word: bool) -> Column:
    """File names and paths: wildcard terms span the whole value, literals are substrings."""
    if not term.glob:
        return matches(term, value, match_case, whole_word)
    return _tested(value, term.text, match_case, lambda own, text: own.rlike(name_regex(text)))
