"""Files, indexes, streams, the entry module and its checks against a second engine."""

import glob
import gzip
import json
import os
import shutil
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.plans import catalogue
from corvane.plans.index import Index, across
from corvane.sources import files
from corvane.streaming import increments

ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    with duckdb.connect() as c:
        c.execute("set timezone = 'UTC'")
        for f in glob.glob(f"{sf}/*.parquet"):
            c.execute(f"create view {Path(f).stem} as select * from '{f}'")
        rel = c.sql(catalogue.oracle_sql()[name])
        at = [rel.columns.index(c) for c in names]
        assert sorted(rel.columns) == names
        assert sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr) == got


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    rows = df.collect()
    assert rows and len(set(map(str, rows))) == len(rows) and all(any(v is not None for v in r) for r in rows)


def test_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"], cwd=copy, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalogue.queries())), str(len(catalogue.oracle_sql())), "False"]


def _jpeg(original: bytes | None, main: bytes | None, order: str = "<") -> bytes:
    """A JPEG's head with the two dates."""
    entries, tail = [], b""
    n = bool(original) + bool(main)
    base = 8 + 2 + 12 * n + 4
    if main:
        entries.append(struct.pack(order + "HHII", 0x0132, 2, 20, base))
        tail += main + b"\0"
    if original:
        sub = base + len(tail)
        entries.append(struct.pack(order + "HHII", 0x8769, 4, 1, sub))
        tail += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x9003, 2, 20, sub + 18) + b"\0\0\0\0" + original + b"\0"
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", n) + b"".join(entries) + b"\0\0\0\0" + tail
    part = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(part) + 2) + part + b"\xff\xda"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    d = files.exif_date
    assert d(_jpeg(b"2024:05:06 10:00:00", b"2020:01:01 00:00:00", order)) == "2024-05-06"
    assert d(_jpeg(None, b"2020:01:01 00:00:00", order)) == "2020-01-01"
    assert d(_jpeg(b"1980:05:06 10:00:00", None, order)) is None and d(_jpeg(None, b"2020:13:01 00:00:00", order)) is None
    whole = _jpeg(b"2024:05:06 10:00:00", None, order)
    assert [d(whole[:n]) for n in range(0, len(whole) - 2, 7)] and d(b"") is None and d(b"GIF89a") is None


def test_folder(spark, tmp_path):
    for name, content in {"a.md": b"caf\xc3\xa9", "b/c.TXT": b"bad \xff byte", "b/_trash/x.md": b"no", "p.html": b"<p>Hi<script>x</script> you</p>", "d.pdf": b"%PDF", "e.bin": b"no", "i.jpg": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    got = files.read_folder(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in got.collect()} == {"a.md": "café", "b/c.TXT": "bad � byte", "p.html": "Hi you", "d.pdf": None}
    assert [tuple(r) for r in files.ignored(got).collect()] == [("scanned pdf", 1)]
    seen = got.where("doc_id <> 'a.md'").select("key")
    assert [r.doc_id for r in files.unseen(got, seen).collect()] == ["a.md"]

    def convert(path, content):
        if path.endswith("pdf"):
            raise OSError
        return content.decode().upper()

    assert {r.doc_id: r.text for r in files.read_folder(spark, str(tmp_path), converter=convert).collect()}["d.pdf"] is None
    flags = files.read_folder(spark, str(tmp_path), files.TEXT + files.CONVERTIBLE + files.IMAGES).select("doc_id", files.needs_ocr(F.col("doc_id"), F.col("text"), F.col("size")).alias("x"))
    assert {r.doc_id for r in flags.where("x").collect()} == {"d.pdf", "i.jpg"}
    scans = spark.createDataFrame([("a.pdf", "", 1, 3), ("b.pdf", "", 1, 11), ("c.pdf", "", 1, None)], "p string, t string, s bigint, n int")
    assert {r.p for r in scans.where(files.needs_ocr(F.col("p"), F.col("t"), F.col("s"), F.col("n"))).collect()} == {"a.pdf", "c.pdf"}


def test_profiles():
    good = {"roles": [{"pattern": "p_[0-9]+", "role": "project"}], "types": {".dwg": "plan"}, "refs": {"min_mixed": 4}}
    assert files.read_profile(good) == good and "project" in files.explain_profile(good)
    for bad in ({"x": 1}, {"roles": {}}, {"roles": [{"pattern": "(", "role": "r"}]}, {"roles": [{"pattern": "a"}]}, {"grids": {"g": {"pattern": "["}}}, []):
        with pytest.raises(ValueError):
            files.read_profile(bad)


def test_journal(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    files.Journal(None).note("q", [])
    files.Journal("/nowhere/at/all").note("q", [])
    j = files.Journal(path, limit=300)
    for i in range(6):
        j.note(f"q{i}", [{"id": "d"}], k=3)
    packed = sum(len(gzip.open(p).read().splitlines()) for p in glob.glob(f"{path}.*.gz"))
    with open(path, "a") as f:
        f.write("no json\n")
    assert packed + files.Journal.read(spark, path).count() == 6


def test_packed_lines(spark, tmp_path):
    from corvane.operators import embeddings

    with gzip.open(tmp_path / "v.vec.gz", "wt") as f:
        f.write("2 2\nEau 1 0\nfeu 0 1\neau 5 5\n")
    got = embeddings.from_text(embeddings.read_lines(spark, f"{tmp_path}/v.vec.gz"))
    assert sorted(tuple(r) for r in got.collect()) == [("eau", [1.0, 0.0]), ("feu", [0.0, 1.0])]


def test_sinks(spark):
    assert json.loads(files.as_json(spark.range(1)).first().value) == {"id": 0}
    assert json.loads(files.error_json(ValueError("no é"))) == {"error": "no é"} and json.loads(files.error_json(KeyError())) == {"error": "KeyError"}
    png = files.grid_png([-128] * 192, 8)
    assert png[:4] == b"\x89PNG" and zlib.decompress(png[png.index(b"IDAT") + 4 : -16]) == (b"\0" + b"\0" * 24) * 8
    with pytest.raises(ValueError):
        files.grid_png([0], 8)
    assert "&lt;a&gt;" in files.card_html([{"id": "<a>", "concepts": [("w", 2.0)]}], "t")


DOCS = [("A/2026/01.2026/20260105_x.md", "filtre à eau du chalet MFN710"), ("A/2025/y.md", "pompe du chalet, sans filtre"), ("B/2026/z.md", "la pompe alimente le réservoir"), ("B/w.md", "")]


@pytest.fixture
def docs(spark):
    return lambda rows=DOCS: spark.createDataFrame(rows, "doc_id string, text string")


def test_index(spark, docs, tmp_path):
    whole = Index.build(spark, f"{tmp_path}/w", docs(), grammar=True, pairs=True)
    grown = Index.build(spark, f"{tmp_path}/g", docs(DOCS[:2]), grammar=True, pairs=True).append(docs(DOCS[2:3])).append(docs(DOCS[3:]))
    for name in ("arrays", "counts", "lengths", "signed", "facets", "edges", "roles", "pairs"):
        assert sorted(map(str, whole.table(name).collect())) == sorted(map(str, grown.table(name).collect())), name
    q = spark.createDataFrame([(1, "pompe du chalet"), (2, "filtre")], "qid int, text string")
    again = Index.open(spark, f"{tmp_path}/g")
    for method in ("bm25", "grid", "fusion", "connectors", "grammar", "typed"):
        a, b = (sorted(map(str, i.search(q, 3, method).collect())) for i in (whole, again))
        assert a == b and a
    assert whole.search(q, 1).where("qid = 1").first().doc_id == "A/2025/y.md"
    first = whole.search(q, 1, codes=["MFN710"]).where("qid = 2").first()
    assert first.doc_id == DOCS[0][0] and first.exact
    own = whole.search(spark.createDataFrame([(1, "pompe MFN710"), (2, "pompe")], "qid int, text string"), 1, boost=True).orderBy("qid").collect()
    assert own[0].doc_id == DOCS[0][0] and own[0].exact and not own[1].exact
    better = spark.createDataFrame([(1, DOCS[2][0], 99.0)], "qid int, doc_id string, score double")
    assert whole.search(q.where("qid = 1"), 1, rerank=better).first().doc_id == DOCS[2][0]
    assert sorted(map(str, whole.grids().collect())) == sorted(map(str, again.grids().collect())) and glob.glob(f"{tmp_path}/w/grids-*")
    assert {r.source for r in across({"w": whole, "g": grown}, q.where("qid = 1")).collect()} == {"w", "g"}
    assert whole.ask(spark.createDataFrame([(1, "combien de devis")], "qid int, text string")).first().route.circuit == "count"
    for call in (lambda: whole.search(q, 0), lambda: whole.search(q, method="x"), lambda: whole.search(q, method="connectors", kind="note"), lambda: grown.append(docs(DOCS[:1])), lambda: grown.append(docs([("n", "x")] * 2)), lambda: Index.build(spark, f"{tmp_path}/e", docs([])), lambda: Index.build(spark, f"{tmp_path}/o", docs(), colour=1), lambda: Index.open(spark, f"{tmp_path}/none"), lambda: across({}, q), lambda: Index.build(spark, f"{tmp_path}/d", docs(), dim=700)):
        with pytest.raises(ValueError):
            call()
    shutil.rmtree(f"{tmp_path}/g/{grown.meta['generations'][1]}/lengths")
    os.makedirs(f"{tmp_path}/g/{grown.meta['generations'][1]}/lengths")
    with pytest.raises(Exception):  # noqa: B017
        Index.open(spark, f"{tmp_path}/g")


def test_index_with_fragments(spark, docs, tmp_path):
    i = Index.build(spark, f"{tmp_path}/f", docs(), fragments=3, grids=False, facets=False, relations=False)
    q = spark.createDataFrame([(1, "chalets")], "qid int, text string")
    assert {r.doc_id for r in i.search(q, 2).collect()} == {DOCS[0][0], DOCS[1][0]}
    assert i.table("facets") is None and i.table("edges") is None
    with pytest.raises(ValueError):
        i.search(q, kind="note")


def test_streams(spark, docs, tmp_path):
    inbox = f"{tmp_path}/in"
    index = Index.build(spark, f"{tmp_path}/s", docs(DOCS[:1]))
    for row in DOCS:
        docs([row]).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 2).parquet(inbox)
    increments.append_to(index, stream, f"{tmp_path}/c1").awaitTermination()
    whole = Index.build(spark, f"{tmp_path}/w", docs())
    now = Index.open(spark, f"{tmp_path}/s")
    assert sorted(map(str, now.vocabulary().collect())) == sorted(map(str, whole.vocabulary().collect()))
    increments.count_words(stream).writeStream.outputMode("complete").format("memory").queryName("words").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    plain_counts = {(r.token, r.df, r.cf) for r in spark.table("words").collect()}
    assert ("pompe", 2, 2) in plain_counts and ("du", 2, 2) in plain_counts
    facts = f"{tmp_path}/facts"
    for rows in ([("e", "a", "new", 5.0)], [("e", "a", "late", 1.0)], [("f", "a", "x", 1.0), ("f", "a", "y", 1.0)]):
        spark.createDataFrame(rows, "entity string, attribute string, value string, t double").coalesce(1).write.mode("append").parquet(facts)
    held = spark.readStream.schema("entity string, attribute string, value string, t double").option("maxFilesPerTrigger", 1).parquet(facts)
    seen = {}

    def keep(batch, _):
        seen.update({r.entity: r for r in batch.collect()})

    increments.beliefs(held).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start().awaitTermination()
    assert (seen["e"].value, seen["e"].n_facts) == ("new", 2) and seen["f"].contested and seen["f"].value is None


def test_decay_in_a_stream(spark, tmp_path):
    """Weights kept by one multiplication a fact equal those of the whole table, late facts too."""
    from corvane.operators import belief

    kind = "entity string, attribute string, value string, t double"
    batches = [[("e", "a", "x", 1.0), ("e", "a", "y", 2.0)], [("e", "a", "x", 3.0), ("e", "a", "x", 3.0), ("f", "a", "z", 5.0)], [("e", "a", "y", 2.5), ("e", "a", "y", 1.0)], [("e", "a", "w", 9.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    increments.bundles(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r.entity: r.weights for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = {}
    for r in belief.weights(spark.createDataFrame(sum(batches, []), kind)).collect():
        want.setdefault(r.entity, {})[r.value] = round(r.w, 9)
    assert {e: {v: round(w, 9) for v, w in ws.items()} for e, ws in seen.items()} == want


def test_questions_in_a_stream(spark, docs, tmp_path):
    index = Index.build(spark, f"{tmp_path}/i", docs())
    kind = "qid int, text string"
    for row in [(1, "pompe du chalet"), (2, "filtre")]:
        spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
    increments.answer(index, stream, f"{tmp_path}/out", f"{tmp_path}/c", k=1).awaitTermination()
    both = spark.createDataFrame([(1, "pompe du chalet"), (2, "filtre")], kind)
    assert sorted(tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(tuple(r) for r in index.search(both, 1).collect())
