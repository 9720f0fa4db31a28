"""Scalar functions on literal cases."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import dates, scores, text, venues
from scriptorium.operators.authors import name_matches


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_identifiers(spark):
    rows = [("https://doi.org/10.1000/ABC.12).",), ("arXiv:2401.01234v2",), ("10.48550/arXiv.2301.00001",), ("cs.CV/0701001",), ("PMID 12345678",), (None,), ("",)]
    got = values(spark, rows, "x string", text.normalize_doi(F.col("x")), text.normalize_arxiv_id(F.col("x")), text.normalize_pmid(F.col("x")))
    assert got[0][0] == "10.1000/abc.12"
    assert got[1][1] == "2401.01234"
    assert got[2][:2] == ("10.48550/arxiv.2301.00001", "2301.00001")
    assert got[3][1] == "cs.cv/0701001"
    assert got[4][2] == "12345678"
    assert got[5] == got[6] == (None, None, None)


def test_titles(spark):
    rows = [("<i>Méthode</i> &amp; Results: a Preprint (v2)",), ("Part II of  the  Story",), (None,)]
    keys = [r[0] for r in values(spark, rows, "x string", text.normalize_title(F.col("x")))]
    assert keys == ["methode results a", "part ii of the story", ""]
    tokens = values(spark, [("segmentation part ii in 3d",), ("no numbers",)], "x string", text.distinguishing_tokens(F.col("x")))
    assert tokens == [(["3d", "ii"],), ([],)]
    assert values(spark, [("towards the great thing",)], "x string", text.title_bucket(F.col("x"))) == [("greatt",)]


@pytest.mark.parametrize(("a", "b", "distance"), [("abc", "acb", 1), ("", "ab", 2), ("calibration", "calbiration", 1), ("ca", "abc", 3)])
def test_edit_distance(a, b, distance):
    assert text.osa_distance(a, b) == distance


def test_title_ratio():
    assert text.title_ratio("a title", "a title") == 1.0
    assert text.title_ratio("", "x") == 0.0
    assert text.title_ratio("short", "a much longer title") == 0.0
    assert text.title_ratio("deep learning for radiology reports", "deep learning for radiology report") > 0.96


@pytest.mark.parametrize(
    ("venue", "hint", "expected"),
    [
        ("Medical Image Computing and Computer Assisted Intervention - MICCAI 2023", "", ("miccai", "conference")),
        ("Radiology: Artificial Intelligence", "journal", ("radiology_ai", "journal")),
        ("Radiology", "journal", ("radiology", "journal")),
        ("European Radiology Experimental", "journal", ("other_journal", "journal")),
        ("CVPR Workshops", "", ("cvpr", "workshop")),
        ("International Conference on Machine Learning and Applications", "", ("other_conference", "conference")),
        ("Proceedings of the 40th International Conference on Machine Learning", "", ("icml", "conference")),
        ("arXiv.org", "repository", ("arxiv", "preprint")),
        ("Lecture Notes in Computer Science", "book series", ("other_conference", "conference")),
        ("", "", ("unknown", "preprint")),
        (None, "posted-content", ("preprint", "preprint")),
        ("Annals of Things", "", ("other_journal", "journal")),
    ],
)
def test_venues(spark, venue, hint, expected):
    got = values(spark, [(venue, hint)], "v string, h string", venues.canonical_venue(F.col("v"), F.col("h")).alias("c"))
    assert tuple(got[0][0]) == expected


@pytest.mark.parametrize(
    ("a", "b", "strict", "expected"),
    [("J. Smith", "John Smith", False, True), ("J. Smith", "John Smith", True, False), ("Yu-Yin Zhou", "Yuyin Zhou", True, True), ("Smith", "John Smith", False, True), ("Smith", "John Smith", True, False), ("Jane Smith", "John Smith", False, False), ("", "John Smith", False, False)],
)
def test_author_names(spark, a, b, strict, expected):
    assert values(spark, [(a, b)], "a string, b string", name_matches(F.col("a"), F.col("b"), strict)) == [(expected,)]


def test_dates(spark):
    today = date(2025, 1, 1)
    got = values(spark, [("2024-02-31", None), ("2020", 2020), (None, 2023), (None, None)], "d string, y int", F.round(dates.age_years(dates.parse_date(F.col("d")), F.col("y"), today), 2))
    assert [g[0] for g in got] == [0.84, 5.0, 1.51, 3.0]
    assert dates.interval_days("every 2 weeks") == 14
    with pytest.raises(ValueError):
        dates.interval_days("400")
    why = dates.outside_window(F.col("d"), F.col("y"), "2022-01-01", "2023-12-31")
    got = values(spark, [("2021-05-05", 2021), ("2024-01-02", 2024), (None, 2020), (None, None), ("2022-06", 2022)], "d string, y int", why)
    assert got[0][0].startswith("published 2021-05-05, before") and got[1][0].startswith("published 2024-01-02, after")
    assert got[2][0].startswith("published 2020, before") and got[3][0] is None and got[4][0] is None


def test_scores(spark):
    rows = [(0.5, 0, 0), (3.0, 100, 3), (9.0, None, 5)]
    got = values(spark, rows, "age double, c int, s int", scores.recency(F.col("age")), scores.citation_signal(F.col("c"), F.col("age")), scores.metadata_confidence([F.lit(True)] * 5, F.col("s")))
    assert got[0] == (1.0, 0.375, 0.775)
    assert got[1][0] == 0.5 and 0.89 < got[1][1] < 0.92 and got[1][2] == 1.0
    assert got[2][:2] == (0.0, 0.0)


def test_text_helpers(spark):
    got = values(spark, [("a/b / c/d",)], "x string", text.split_path(F.col("x")))
    assert got == [(["a", "b / c", "d"],)]
    inverted = values(spark, [({"big": [1], "a": [0, 2], "world": [3]},)], "x map<string,array<int>>", text.rebuild_abstract(F.col("x")))
    assert inverted == [("a big a world",)]
    assert values(spark, [("http://x/?api_key=s3cret&q=1",)], "x string", text.redact(F.col("x"))) == [("http://x/?api_key=***&q=1",)]
    assert values(spark, [("one two three four",)], "x string", text.clip(F.col("x"), 10)) == [("one two…",)]
    assert values(spark, [("Jane van Smith", 2023, "the robust radiology thing")], "a string, y int, t string", text.seed_tag(F.col("a"), F.col("y"), F.col("t"))) == [("smith2023-robust",)]


def test_inverted_texts(spark):
    """Words and their positions, without leaving the row; and the words back."""
    df = spark.createDataFrame([(["b", "a", "b", "é"],), (["x"],), ([],), (None,)], "words array<string>").select(text.inverted_text(F.col("words")).alias("i"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.i for r in df.collect()] == [{"b": [0, 2], "a": [1], "é": [3]}, {"x": [0]}, {}, None]
    assert [r[0] for r in df.select(text.rebuild_abstract(F.col("i"))).collect()] == ["b a b é", "x", "", ""]


def test_rebuilt_texts_move_nothing(spark, tmp_path):
    """The query's plan has no exchange, so nothing is shuffled or spilled at any size."""
    from scriptorium import catalogue

    spark.createDataFrame([(1, "a b  a"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.queries()["rebuild_inverted_text"](spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.digest and r.digest[:8] for r in df.collect()} == {1: hashlib.sha256(b"a b a").hexdigest()[:8], 2: None, 3: hashlib.sha256(b"").hexdigest()[:8]}
