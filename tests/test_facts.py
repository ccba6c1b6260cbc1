"""Facets, paths, beliefs on literal cases."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import belief, facets, relations

FACETS = "doc_id string, type string, date string, refs array<string>"


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([("A/2026/Photo_1.jpg", "photo", "2026-01-02", []), ("a/2026/devis.pdf", "pdf", "2026-03-01", ["MFN710"]), ("A/2025/x.pdf", "pdf", "2025-05-05", ["MFN710", "MFN710"]), ("B/y%z.md", "note", "0000-00-00", []), ("B/2026/é.md", "note", "2026-01-31", ["X99999"])], FACETS)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_counts(five):
    n = lambda **f: facets.count(five, **f).first().n
    assert [n(), n(contains="a/"), n(kind="photo"), n(date="2026"), n(kind="absent")] == [5, 3, 1, 3, 0]
    assert n(contains="%") == 1 and n(contains="_1") == 1 and n(contains="É") == 0
    assert facets.count(five).first().undated == 1
    assert rows(facets.by_month(five)) == [("2025-05", 1), ("2026-01", 2), ("2026-03", 1)]
    assert [tuple(r) for r in facets.types(five).collect()] == [("note", 2), ("pdf", 2), ("photo", 1)]
    assert [r.doc_id for r in facets.latest(five, 9).collect()] == ["a/2026/devis.pdf", "B/2026/é.md", "A/2026/Photo_1.jpg", "A/2025/x.pdf"]


def test_holders(spark, five):
    got = facets.holders(five, spark.createDataFrame([("MFN710",), ("MFN710",), ("none",)], "ref string"))
    assert [(r.doc_id, r.place) for r in got.orderBy("place").collect()] == [("a/2026/devis.pdf", 1), ("A/2025/x.pdf", 2)]


def test_facets_in_ranking(spark, five):
    hits = spark.createDataFrame([(1, d, i, 1.0 / i) for i, d in enumerate(["A/2026/Photo_1.jpg", "B/y%z.md", "A/2025/x.pdf", "unknown", "a/2026/devis.pdf"], 1)], "qid int, doc_id string, rank int, score double")
    order = lambda **o: [r.doc_id for r in facets.apply(hits, five, 5, **o).orderBy("rank").collect()]
    assert order(codes=["MFN710"])[:2] == ["A/2025/x.pdf", "a/2026/devis.pdf"]
    assert order(kind="pdf") == ["A/2025/x.pdf", "a/2026/devis.pdf"]
    assert order(recency=1.0) == ["a/2026/devis.pdf", "A/2026/Photo_1.jpg", "A/2025/x.pdf", "B/y%z.md", "unknown"]
    assert order() == [r.doc_id for r in hits.orderBy("rank").collect()]
    for bad in (1.5, -0.1):
        with pytest.raises(ValueError):
            facets.apply(hits, five, recency=bad)
    assert facets.pool_size(10, True, False, False) == 400 and facets.pool_size(20, False, True, False) == 100 and facets.pool_size(7, False, False, False) == 7
    report = facets.empty_filter_report(hits, five, "plan").first()
    assert report.n == 5 and report.first_doc == "A/2026/Photo_1.jpg" and facets.empty_filter_report(hits, five, "pdf").collect() == []


def edges(spark, *paths):
    return {p: [(r.role, r.entity) for r in relations.path_edges(spark.createDataFrame([(p,)], "doc_id string")).orderBy("pos").collect()] for p in paths}


def test_path_entities(spark):
    got = edges(spark, "2026/08-Août/ATLAS_NORD/03_Devis/f.pdf", "08.2026/ATLAS/f.pdf", "08-Août/ATLAS/f.pdf", "f.pdf", "2026/a/2026/a/f")
    assert got["2026/08-Août/ATLAS_NORD/03_Devis/f.pdf"] == [("year", "2026"), ("folder", "août"), ("month", "2026-08"), ("folder", "atlas_nord"), ("folder", "devis")]
    assert got["08.2026/ATLAS/f.pdf"] == [("month", "2026-08"), ("folder", "atlas")]
    assert got["08-Août/ATLAS/f.pdf"] == [("folder", "août"), ("folder", "atlas")]
    assert got["f.pdf"] == [] and got["2026/a/2026/a/f"] == [("year", "2026"), ("folder", "a")]


def test_path_rules(spark):
    df = spark.createDataFrame([("p_77/03_Devis/f",)], "doc_id string")
    got = relations.path_edges_by_rules(df, [(r"p_([0-9]+)", "project", "P-{1}!"), (".*", "folder", None)])
    assert rows(got.select("role", "entity")) == [("folder", "devis"), ("project", "P-77!")]
    with pytest.raises(ValueError):
        relations.path_edges_by_rules(df, [])
    assert rows(relations.suggested_roles(spark.createDataFrame([("2026/a/f",), ("2025/b/f",)], "doc_id string"))) == [(0, "year", 2, 2), (1, "folder", 2, 2)]


def test_hops(spark):
    e = relations.path_edges(spark.createDataFrame([("north/2026/a",), ("north/2025/b",), ("south/2026/c",)], "doc_id string"))
    near = relations.siblings(e, spark.createDataFrame([("north/2026/a",)], "doc_id string"))
    assert rows(near.select("role", "entity", "doc_id")) == [("folder", "north", "north/2025/b"), ("year", "2026", "south/2026/c")]
    got = relations.related(e, spark.createDataFrame([("NORTH",), ("nowhere",)], "entity string"))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == ["north/2025/b", "north/2026/a"]


FACTS = "entity string, attribute string, value string, t double"


def current(spark, *facts):
    return {r.entity: r for r in belief.current(spark.createDataFrame(facts, FACTS)).collect()}


def test_beliefs(spark):
    got = current(spark, ("e", "a", "v1", 0.0), ("e", "a", "v2", 1.0), ("f", "a", "v1", 5.0), ("f", "a", "v2", 5.0))
    assert (got["e"].value, got["e"].contested, got["e"].candidates) == ("v2", False, [])
    assert (got["f"].value, got["f"].contested, got["f"].candidates) == (None, True, ["v1", "v2"])
    assert 0.2 < got["e"].confidence < 0.6
    order = belief.history(spark.createDataFrame([("e", "a", "x", 3.0), ("e", "a", "y", 1.0), ("e", "a", "z", 2.0)], FACTS))
    assert [r.value for r in order.orderBy("place").collect()] == ["y", "z", "x"]
    w = {r.value: r.w for r in belief.weights(spark.createDataFrame([("e", "a", "x", 0.0), ("e", "a", "x", 1.0), ("e", "a", "y", 2.0)], FACTS)).collect()}
    assert abs(w["x"] - 0.96) < 1e-12 and w["y"] == 1.0


def test_calibration(spark):
    facts = [(f"e{i}", "a", f"v{i % 4}", float(t)) for i in range(40) for t in range(2)]
    got = belief.calibrate(spark.createDataFrame(facts, FACTS)).first()
    assert got.slots == 40 and got.error == 0.0 and got.answered == 1.0 and got.threshold > 0
    few = belief.calibrate(spark.createDataFrame(facts[:10], FACTS)).first()
    assert few.slots == 5 and few.threshold is None
    with pytest.raises(ValueError):
        belief.calibrate(spark.createDataFrame(facts, FACTS), alpha=1.5)


def test_resolution(spark):
    facts = [("f", "a", "v1", 5.0), ("f", "a", "v2", 5.0), ("e", "a", "v1", 0.0), ("g", "a", "v1", 1.0), ("g", "a", "v2", 1.0)]
    proofs = [("f", "a", "v2", s) for s in (0.3, 0.3, 0.3, 0.3)] + [("f", "a", "v1", 0.4), ("g", "a", "v1", 0.2), ("g", "a", "v2", 0.19)]
    got = belief.resolve(belief.current(spark.createDataFrame(facts, FACTS)), spark.createDataFrame(proofs, "entity string, attribute string, value string, score double"))
    by = {r.entity: r for r in got.collect()}
    assert (by["f"].status, by["f"].value, by["f"].margin) == ("resolved", "v2", 0.5)
    assert by["g"].status == "undecided" and by["e"].status == "clear" and by["e"].value == "v1"


def test_beliefs_are_resolved_and_stored(spark, tmp_path):
    kind = "entity string, attribute string, value string, t double"
    facts = spark.createDataFrame([("e", "a", "x", 1.0), ("e", "a", "y", 1.0), ("f", "a", "x", 1.0), ("g", "a", "x", 2.0), ("g", "a", "z", 2.0)], kind)
    proof = spark.createDataFrame([("e", "a", "x", 0.4), ("e", "a", "x", 0.3), ("e", "a", "y", 0.5), ("g", "a", "x", 0.5), ("g", "a", "z", 0.49)], "entity string, attribute string, value string, score double")
    asked = spark.createDataFrame([("e", "a"), ("f", "a"), ("g", "a"), ("nobody", "a")], "entity string, attribute string")
    held = belief.current(facts).withColumn("to_clarify", F.col("entity") != "f")
    got = belief.resolve(held, proof, asked=asked)
    assert {r.entity: (r.status, r.value) for r in got.collect()} == {"e": ("resolved", "x"), "f": ("clear", "x"), "g": ("undecided", None), "nobody": ("unknown", None)}
    after = belief.reasserted(facts, got)
    assert {tuple(r) for r in after.subtract(facts).collect()} == {("e", "a", "x", 2.0)}
    assert {r.entity: r.value for r in belief.latest(after).collect()}["e"] == "x"
    belief.store(facts, f"{tmp_path}/b")
    belief.store(after.subtract(facts), f"{tmp_path}/b")
    (tmp_path / "b" / "part-bad.json").write_text('no json\n{"entity": "x"}\n')
    assert sorted(map(tuple, belief.stored(spark, f"{tmp_path}/b").collect())) == sorted(map(tuple, after.collect()))
