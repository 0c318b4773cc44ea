"""The training sample: every language has its share, whatever the others hold."""

from collections import Counter

from quarry.llm import langid


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)


def test_shares():
    assert langid.shares({"en": 9000, "xx": 1, "yy": 2}, 60) == {"en": 57, "xx": 1, "yy": 2}
    assert langid.shares({"a": 5, "b": 5, "c": 5}, 2) == {"a": 1, "b": 1, "c": 1}  # one at least
    assert sum(langid.shares({f"l{i}": 100 for i in range(7)}, 60).values()) == 60


def test_rare_languages_beside_many_long_texts(spark):
    """Long texts of one language may not use up the characters of the others."""
    rows = [(f"common words number {i} " + "and so on " * 200, "en") for i in range(900)] + [(f"un solo texto {i}", f"l{i % 34}") for i in range(340)]
    sample = langid.labelled_sample(frame(spark, rows), limit=200, total=100_000)
    found = Counter(lang for _, lang in sample)
    assert len(found) == 35 and min(found.values()) >= 1 and found["en"] >= 1
    assert sum(len(t) for t, _ in sample) <= 100_000 + 34 * 30
    again = langid.labelled_sample(frame(spark, rows[::-1]), limit=200, total=10**9)
    assert Counter(lang for _, lang in again)["en"] <= langid.shares({"en": 600, **{f"l{i}": 6 for i in range(34)}}, 200)["en"] + 60


def test_more_languages_than_the_sample_has_texts(spark):
    rows = [(f"words of language {i} and {k}", f"l{i}") for i in range(1100) for k in range(4)]
    sample = langid.labelled_sample(frame(spark, rows), limit=50, total=1000)
    known = {lang for i, (_, lang) in enumerate(rows) if __import__("zlib").crc32(str(i).encode()) % 3 != 1}
    assert {lang for _, lang in sample} == known and len(sample) == len(known) > 1000


def test_one_language_alone_and_labels_that_differ(spark):
    model = langid.train(langid.labelled_sample(frame(spark, [(f"nur ein paar worte {i}", "de") for i in range(30)])))
    assert model.langs == ["de"] and model.predict("worte")[0] == "de" and model.predict("worte")[1] == 1.0
    sample = langid.labelled_sample(frame(spark, [("the same text", lang) for lang in ("en", "de", "fr") for _ in range(9)]))
    assert sample == [("the same text", "de")]
    assert langid.labelled_sample(frame(spark, [("no label", None)])) == []
