"""Full case folding, offsets of folded texts, whole-pattern spans, against plain versions."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry import model as M
from quarry.functions import text as X
from quarry.operators import snippets
from quarry.operators.search import SearchEngine
from quarry.plans.query import parse


def test_every_code_point_folds_as_in_python(spark):
    """But for those that Python's Unicode tables do not know."""
    known = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    rows = spark.createDataFrame([(i, "".join(known[i : i + 64]), known[i : i + 64]) for i in range(0, len(known), 64)], "i long, t string, cs array<string>")
    wrong = rows.select("i", "t", "cs", X.folded(F.col("t")).alias("whole"), F.transform("cs", X.folded).alias("each"), X.may_fold(F.col("t")).alias("may"))
    for r in wrong.toLocalIterator():
        assert r["whole"] == "".join(c.casefold() for c in r["cs"]), r["t"]
        assert r["each"] == [c.casefold() for c in r["cs"]]
        assert r["may"] or r["whole"] == "".join(c.lower() for c in r["cs"])


TEXTS = ["Straße STRASSE straSSe", "ΟΔΟΣΑ οδος ΟΔΟΣ", "İstanbul istanbul", "ﬁne ﬂow oﬃce", "µm μm", "ſet Set", "ŉ x", "ΐ and ΐ", "ᾳ αι", "plain ascii", "", "ßßß", "a😀ß😀b"]


def _starts(t):
    out = [0]
    for c in t:
        out.append(out[-1] + len(c.casefold()))
    return out


def _plain_spans(t, needle):
    """Occurrences in the folded text, as the characters of ``t`` that they touch."""
    own, want, starts, found, at = t.casefold(), needle.casefold(), _starts(t), [], 0
    while (p := own.find(want, at)) >= 0:
        at = p + len(want)
        found.append((max(i for i, x in enumerate(starts) if x <= p), min(i for i, x in enumerate(starts) if x >= at)))
    return found


@pytest.mark.parametrize("needle", ["strasse", "STRAẞE", "ss", "s", "οδος", "ΟΔΟΣ", "i̇st", "fi", "office", "μ", "Set", "ß", "ʼn", "ι", "b", "😀"])
def test_spans_are_of_the_text_itself(spark, needle):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = df.select("i", "t", snippets.literal_spans(F.col("t"), needle).alias("s"), X.fold_padded(F.col("t")).alias("f"), X.folded(F.col("t")).alias("own")).collect()
    for r in got:
        assert r["own"] == r["t"].casefold()
        assert len(r["f"]) == len(r["own"]) and r["f"].replace("\ufdd0", "") == r["t"]
        assert [(s["start"], s["end"]) for s in r["s"]] == _plain_spans(r["t"], needle), r["t"]


def _engine(spark):
    units = spark.createDataFrame([(i * M.UNIT_STRIDE, i, 1, 1, "line", t) for i, t in enumerate(TEXTS)], "unit_id long, file_id long, root_id int, sequence int, location_type string, text string")
    files = spark.createDataFrame([(i, 1, t or "none", t or "none", f"f{i}", 1.0) for i, t in enumerate(TEXTS)], "file_id long, root_id int, file_name string, relative_path string, normalized_path string, modified_time double")
    return SearchEngine(files, units)


@pytest.mark.parametrize("query,want", [
    ("strasse", {0}), ("STRAẞE", {0}), ("straß", {0}), ("οδος", {1}), ("ΟΔΟΣΑ", {1}), ("office", {3}), ("fine", {3}), ("μm", {4}), ("µm", {4}), ("set", {5}), ("s?t", {5}), ("fi*ow", {3}), ("stra?e", {0}),
    ("a*b", {2, 12}), ("ss", {0, 11, 12}), ("i̇st", {2}),
])
def test_searches_find_what_differs_in_form(spark, query, want):
    engine = _engine(spark)
    got = {r["file_id"] for r in engine.hits(M.Request(query, scope=M.Scope.CONTENT)).collect()}
    assert got == want
    names = {r["file_id"] for r in engine.hits(M.Request(query if "*" not in query and "?" not in query else f"*{query}*", scope=M.Scope.NAME)).collect()}
    assert names == want
    if query not in ("strasse", "οδος", "office", "a*b"):
        return
    page = engine.ranked(M.Request(query, scope=M.Scope.CONTENT))
    shown = engine.snippets(M.Request(query, scope=M.Scope.CONTENT), page).collect()
    assert {r["file_id"] for r in shown} == want
    assert all(0 <= h["start"] < h["end"] <= len(r["snippet"]) for r in shown for h in r["highlights"] or [])


def test_exact_case_is_not_folded(spark):
    engine = _engine(spark)
    found = lambda q: {r["file_id"] for r in engine.hits(M.Request(q, scope=M.Scope.CONTENT, match_case=True)).collect()}
    assert found("strasse") == set() and found("STRASSE") == {0} and found("ΟΔΟΣ") == {1} and found("Set") == {5}


def _greedy(t, pattern, limit):
    """Each segment at its next place, from left to right; over again behind each match."""
    segments, found, at = [s for s in pattern.split("*") if s], [], 0

    def next_(s, at):
        return next((p for p in range(at, len(t) - len(s) + 1) if all(c in ("?", x) for c, x in zip(s, t[p : p + len(s)]))), -1)

    while len(found) < limit:
        begin = None
        cursor = at
        for s in segments:
            p = next_(s, cursor)
            if p < 0:
                return found
            begin = p if begin is None else begin
            cursor = p + len(s)
        found.append((begin, cursor))
        at = cursor
    return found


def test_spans_of_whole_patterns(spark):
    rng = random.Random(4)
    patterns = ["a*b", "*a*b*", "ab*", "*ab", "a?b", "a?*b", "aa*a", "ab*ba*b", "?a", "a", "b*?"]
    rows = [("".join(rng.choice("ab c") for _ in range(rng.randint(0, 40))),) for _ in range(150)] + [("",), ("aaaaaa",), ("ababab",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", *(snippets.glob_spans(F.col("t"), p, True, 5).alias(f"p{i}") for i, p in enumerate(patterns))).collect()
    for r in got:
        for i, p in enumerate(patterns):
            assert [(s["start"], s["end"]) for s in r[f"p{i}"]] == _greedy(r["t"], p, 5), (r["t"], p)
    folded = spark.createDataFrame([("xSTRAßE endE",)], "t string").select(snippets.glob_spans(F.col("t"), "stra*E").alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in folded] == [(1, 7)]
    alone = spark.createDataFrame([("xy",), ("",)], "t string").select(snippets.glob_spans(F.col("t"), "**").alias("s")).collect()
    assert [[tuple(s) for s in r["s"]] for r in alone] == [[(0, 1)], []]


def test_spans_of_long_texts_take_time_in_proportion(spark):
    import time

    df = spark.createDataFrame([("a" * 200_000,), ("ab" * 100_000,)], "t string").persist()
    df.count()
    began = time.perf_counter()
    rows = df.select(F.size(snippets.literal_spans(F.col("t"), "a")).alias("n"), F.size(snippets.glob_spans(F.col("t"), "a*b*a")).alias("g")).collect()
    assert [r["n"] for r in rows] == [200_000, 100_000] and [r["g"] for r in rows] == [0, 64]
    assert time.perf_counter() - began < 60
    sums = spark.createDataFrame([([1] * 1000,), ([],), ([3],), (list(range(257)),)], "v array<int>").select("v", X.running(F.col("v")).alias("s")).collect()
    for r in sums:
        assert r["s"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))]


def test_parsed_terms_keep_their_text():
    assert [t.text for t in parse("STRAẞE οδος").terms] == ["STRAẞE", "οδος"]
