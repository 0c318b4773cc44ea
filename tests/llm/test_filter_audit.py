"""The audit against its SQL, and against a replay document by document on odd rows."""

import itertools
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quarry.llm import filter_audit, registry

DDL = "doc_id long, text string, lang string, first string, part string, digest string, good string, words string"


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL["op13_filter_audit"])
    got = registry.QUERIES["op13_filter_audit"](spark, sf_dir).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def replay(rows, labels):
    """Every filter asked anew for every document, order and step."""
    def words(t):
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    rows = [(i, t or "", part or "") for i, t, part in rows]
    fails = {
        "A": lambda i, t: len(words(t)) < 200, "B": lambda i, t: 100 * len(set(words(t))) < 50 * len(words(t)), "C": lambda i, t: 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
        "D": lambda i, t: any(c in "#$%&*|" for c in t), "E": lambda i, t: i is not None and any(j is not None and j < i and t == u for j, u, _ in rows),
    }
    flags = [{x for x in "ABCDE" if fails[x](i, t)} for i, t, _ in rows]
    good, toxic = ({i for i, *y in labels if y[k] == 1} for k in (0, 1))
    found = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, _, p in rows}:
            for step, x in enumerate(order, 1):
                n = Counter()
                for (i, _, p), own in zip(rows, flags):
                    if p == part:
                        earlier = own & set(order[: step - 1])
                        n["kept"] += not earlier and x not in own
                        n["removed"] += not earlier and x in own
                        n["redundant"] += bool(earlier) and x in own
                        n["unique_fails"] += own == {x}
                        n["good_lost"] += not earlier and x in own and i in good
                        n["toxic_lost"] += not earlier and x in own and i in toxic
                found[part, order, step] = n
    shapley = Counter()
    for (part, order, step), n in found.items():
        shapley[part, order[step - 1]] += n["removed"]
    return {k: (*(n[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, n in found.items()}


def test_odd_rows(spark):
    rich = " ".join(f"w{i}" for i in range(220))
    poor = "same\x0bword\t" * 150
    texts = [(1, None, "en"), (2, "", "en"), (3, rich, "en"), (4, rich, "de"), (4, rich, "de"), (None, rich, None), (5, poor, None), (6, rich.upper(), "en"), (7, rich + " 5%", "en"), (8, poor + "#", ""), (9, "É ß \x1f x", "de"), (10, "  \n ", "en"), (2, rich + "x", "en"), (11, rich + "x", "en"), (12, "long word " * 300_000, "en")]
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (7, 1, 1), (8, None, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, "f", "p", "d", "g", "w") for r in texts], DDL).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.replayed(filter_audit.flagged(docs, known)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got}
    assert len(got) == len(found) == 3 * 120 * 5
    assert found == replay(texts, labels)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)
    assert filter_audit.replayed(filter_audit.flagged(docs.limit(0), known)).collect() == []
    assert filter_audit.replayed(filter_audit.flagged(docs, known.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_shares_add_up(spark, sf_dir):
    """The filters' shapley sums are what all orders remove, each order the same documents."""
    got = registry.QUERIES["op13_filter_audit"](spark, sf_dir).collect()
    for part in {r["part"] for r in got}:
        own = [r for r in got if r["part"] == part]
        per_order = Counter()
        for r in own:
            per_order[r["filter_order"]] += r["removed"]
        assert len(set(per_order.values())) == 1
        assert sum({r["filter"]: r["shapley"] for r in own}.values()) == sum(per_order.values())
