"""Operators that compare or combine documents, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import chunks, decontaminate, langid, packing, simhash

WORDS = [a + b for a in "ka lo mi nu pe ra so ti vu".split() for b in "bar den fil gos hut jom".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- near duplicates


def signs(rows):
    """Fingerprints as a matrix of signs."""
    blocks = np.array([r.blocks for r in rows], np.int64)
    return np.stack([(blocks >> (simhash.SIGN_BITS * k)) & ((1 << simhash.SIGN_BITS) - 1) for k in range(simhash.ROWS)], 2).reshape(len(rows), -1)


def close_by_hand(rows, limit=simhash.MAX_DISTANCE):
    """(doc, doc, distance) of all pairs of fingerprints within the limit."""
    every, out = signs(rows), []
    for i in range(len(rows)):
        d = (every[i + 1 :] != every[i]).sum(1)
        out += [(rows[i].doc_id, rows[i + 1 + j].doc_id, int(d[j])) for j in np.flatnonzero(d <= limit)]
    return out


def groups(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_near_duplicates_are_those_of_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    close = close_by_hand(simhash.fingerprint_table(docs).collect())
    want = {a: b for a, b in groups([x[:2] for x in close]).items() if a != b}
    assert {r.doc_id: r.kept_id for r in simhash.near_duplicates(docs).collect()} == want
    assert sum(d > 0 for *_, d in close) >= 50


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=simhash.BLOCKS * simhash.ROWS, max_size=simhash.BLOCKS * simhash.ROWS), st.randoms())
def test_close_fingerprints_share_a_block(_, rng):
    at = rng.sample(range(simhash.BLOCKS * simhash.ROWS), simhash.MAX_DISTANCE)
    assert len({i // simhash.ROWS for i in at}) < simhash.BLOCKS


def test_distance_counts_signs(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        a = [[rng.randrange(1 << simhash.SIGN_BITS) for _ in range(simhash.ROWS)] for _ in range(simhash.BLOCKS)]
        b = [[x if rng.random() < 0.6 else x ^ 1 << rng.randrange(simhash.SIGN_BITS) for x in r] for r in a]
        packed = [[sum(x << simhash.SIGN_BITS * k for k, x in enumerate(r)) for r in m] for m in (a, b)]
        rows.append((*packed, sum(x != y for r, t in zip(a, b) for x, y in zip(r, t))))
    out = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, want int").select("want", simhash.distance(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in out)


def test_a_bucket_of_unlike_texts_loses_no_pair(make):
    rng, rows = random.Random(12), []
    common = prose(rng, 60)
    for i in range(60):  # half of each text is the same, so buckets hold texts that aren't close; some of these have close copies
        own = prose(rng, 60) + f" n{i}"
        rows.append((i, f"{common} {own}"))
        if i % 3 == 0:
            words = f"{common} {own}".split()
            words[rng.randrange(60, 120)] = "changed"
            rows.append((1000 + i, " ".join(words)))
    docs = make(rows)
    want = {a: b for a, b in groups([x[:2] for x in close_by_hand(simhash.fingerprint_table(docs).collect())]).items() if a != b}
    got = {r.doc_id: r.kept_id for r in simhash.near_duplicates(docs).collect()}
    assert got == want and len(got) >= 20


def test_copies_with_edits_go_and_others_stay(make):
    rng, rows = random.Random(1), []
    for i in range(60):
        words = prose(rng, 120).split()
        rows.append((i, " ".join(words)))
        words[rng.randrange(120)] = "changed"
        if i < 20:
            rows.append((100 + i, " ".join(words)))
        if i < 5:
            rows += [(200 + 10 * i + k, dict(rows)[i].upper()) for k in range(3)]
    got = {r.doc_id: r.kept_id for r in simhash.near_duplicates(make(rows)).collect()}
    assert set(got) == {100 + i for i in range(20)} | {200 + 10 * i + k for i in range(5) for k in range(3)}
    assert all(v < 60 and (k % 100 == v if k < 200 else (k - 200) // 10 == v) for k, v in got.items())


@pytest.mark.parametrize(("words", "changed"), [(1, 0), (3, 1), (8, 1), (12, 1), (20, 1), (40, 3), (120, 9), (400, 30)])
def test_pairs_of_every_length_as_by_brute_force(make, words, changed):
    rng, rows = random.Random(words), []
    for i in range(60):
        text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        other = list(text)
        for k in rng.sample(range(words), changed):
            other[k] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    docs = make(rows)
    want = {a: b for a, b in groups([x[:2] for x in close_by_hand(simhash.fingerprint_table(docs).collect())]).items() if a != b}
    got = {r.doc_id: r.kept_id for r in simhash.near_duplicates(docs).collect()}
    assert got == want and all(a - b == 1 for a, b in got.items())
    assert words < 12 or len(got) >= 54


def test_near_duplicates_of_odd_rows(odd, make):
    assert {r.doc_id for r in simhash.near_duplicates(odd).collect()} == set()
    assert sorted(map(str, simhash.drop_near_duplicates(odd).collect())) == sorted(map(str, odd.collect()))
    assert simhash.near_duplicates(make([])).collect() == []
    many = make([(i, "one text that is there very many times over") for i in range(300)])
    assert simhash.drop_near_duplicates(many).select("doc_id").collect() == [(0,)]
    two = make([(5, "alpha beta gamma"), (5, "delta epsilon zeta"), (7, "Alpha, beta: gamma!"), (9, "delta epsilon zeta"), (11, "alone")])
    assert sorted(tuple(r) for r in simhash.near_duplicates(two).collect()) == [(7, 5), (9, 5)]


def test_near_duplicates_keep_the_type_of_ids(spark):
    docs = spark.createDataFrame([("b1", "one text here"), ("a1", "one text here"), ("c", "another one")], "doc_id string, text string")
    assert [tuple(r) for r in simhash.near_duplicates(docs).collect()] == [("b1", "a1")]
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {"a1", "c"}


# --- substrings


def removed_by_hand(rows):
    """{doc: spans} from all chunks of all documents, by dictionaries."""
    seen, flags, bounds = {}, {}, {}
    for i, text in sorted(rows):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, _ = chunks.cuts(data, np.array([0, len(data)]))
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        bounds[i] = (starts, ends)
        flags[i] = np.array([not (seen.setdefault(data[s:e].tobytes(), (i, k)) == (i, k)) for k, (s, e) in enumerate(zip(starts, ends))], bool)
    out = {}
    for i, text in rows:
        raw = text.encode()
        spans = [(len(raw[:s].decode()), len(raw[:e].decode())) for s, e in chunks.runs(*bounds[i], flags[i])]
        if spans:
            out[i] = spans
    return out


def test_repeated_passages_agree_with_dictionaries(make):
    rng = random.Random(5)
    shared = [prose(rng, 70) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(5, 60))]
        if i % 3 == 0:
            parts += ["é " + shared[i % 4] + ".", prose(rng, 10)]
        rows.append((i, "\n".join(parts)))
    docs = make(rows, 5)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in chunks.removed_passages(docs).collect()}
    assert got == removed_by_hand(rows) and len(got) >= 20
    texts = {r.doc_id: r for r in chunks.drop_repeated_passages(docs).collect()}
    for i, text in rows:
        left = "".join(text[a:b] for a, b in zip([0] + [e for _, e in got.get(i, [])], [s for s, _ in got.get(i, [])] + [len(text)]))
        assert texts[i].text == left and texts[i].n_chars == len(left)
    for i in range(24, 80, 3):  # the first copies stand in documents 0 to 9
        inner = shared[i % 4][60:-60]
        assert inner not in texts[i].text


@settings(max_examples=40, deadline=None)
@given(st.text("ab cé\n", max_size=400), st.text("ab c", max_size=30), st.integers(0, 400))
def test_cuts_resist_insertions(text, inserted, at):
    def pieces(t):
        data = np.frombuffer(t.encode(), np.uint8)
        starts, _ = chunks.cuts(data, np.array([0, len(data)]))
        assert b"".join(data[s:e].tobytes() for s, e in zip(starts, np.r_[starts[1:], len(data)])) == t.encode()
        return [data[s:e].tobytes() for s, e in zip(starts, np.r_[starts[1:], len(data)])]

    far = " ".join(WORDS[i % 54] + WORDS[i * 7 % 54] for i in range(60)) + " "
    before, after = Counter(pieces(text[:at] + " " + far)), Counter(pieces(text[:at] + inserted + " " + far))
    assert sum((before & after).values()) >= len(pieces(far)) - 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é\n", max_size=150), min_size=1, max_size=6))
def test_cuts_do_not_depend_on_the_texts_around(texts):
    raw = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(t) for t in raw])]
    starts, doc = chunks.cuts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(raw):
        alone, _ = chunks.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (starts[doc == i] - offsets[i]).tolist() == alone.tolist()


def test_text_without_white_space_is_cut_alike(make):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefghij") for _ in range(800))
    rows = [(i, "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(60, 200))) + shared) for i in range(4)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in chunks.removed_passages(make(rows)).collect()}
    assert got == removed_by_hand(rows) and set(got) == {1, 2, 3} and all(sum(e - s for s, e in v) > 650 for v in got.values())


def test_a_chunk_that_is_everywhere_is_no_window(make):
    plan = chunks.repeated_chunks(make([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    line = "the same line of boilerplate stands at the head of every one of these documents, whatever follows it. "
    rows = [(i, line * 2 + f"own words {i * 7919} " * 3) for i in range(200)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in chunks.removed_passages(make(rows, 7)).collect()}
    assert got == removed_by_hand(rows) and len(got) == 199


def test_passages_of_odd_rows(spark, odd, make):
    out = chunks.drop_repeated_passages(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rest = [c for c in odd.columns if c not in ("text", "n_chars")]
    assert sorted(map(str, out.select(rest).collect())) == sorted(map(str, odd.select(rest).collect()))
    left = {r.doc_id: r.text for r in out.collect() if r.doc_id != 4}
    assert left == {r.doc_id: r.text for r in odd.collect() if r.doc_id != 4}
    by_hand = removed_by_hand([(r.doc_id, r.text) for r in odd.collect() if r.doc_id == 4][1:])  # one of the two equal rows
    for r in out.where("doc_id = 4").collect():  # a text that repeats itself keeps the first copy
        old = next(x.text for x in odd.collect() if x.doc_id == r.doc_id)
        spans = by_hand.get(r.doc_id, [])
        assert r.text == "".join(old[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(old)])) and len(r.text) < len(old) / 4
        assert r.n_chars == len(r.text)
    assert chunks.removed_passages(make([])).collect() == []
    named = spark.createDataFrame([("b", "one and the same text " * 1 + "with many different words in it so that it is long enough to count as a passage of its own"), ("a", "one and the same text with many different words in it so that it is long enough to count as a passage of its own")], "doc_id string, text string")
    assert [(r.doc_id, r.text) for r in chunks.removed_passages(named).collect()] == [("b", "")]


# --- contamination


def test_passages_come_back_in_slices_without_the_old_text():
    rng = random.Random(12)
    texts = [prose(rng, 20_000) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(20)), pa.array(texts), pa.array([{"n": i} for i in range(20)]), pa.array([[]] * 20, pa.list_(pa.struct([("at", pa.int32()), ("digest", pa.int64())])))],
        ["doc_id", "text", "_row", "_repeats"],
    )
    out = list(chunks._cut_batches(iter([batch])))
    assert all(b.schema.names == ["doc_id", "_row", "_new", "_spans"] for b in out)
    assert batch.nbytes > 2 << 20 and max(b.nbytes for b in out) < 3 << 19
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(i, {"n": i}, t, []) for i, t in enumerate(texts)]


def edit_distance_within(pattern, text):
    """(least distance of the pattern to any stretch, leftmost end) by the plain table; ends are behind a character."""
    row = list(range(len(pattern) + 1))
    best = (len(pattern) + 1, -1)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != p)))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j)
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=100), st.integers(0, 70))
def test_bit_parallel_distance(pattern, text, limit):
    want, end = edit_distance_within(pattern, text)
    got = decontaminate.myers(decontaminate.masks(pattern), len(pattern), text, limit)
    assert got == ((want, end) if end > 0 and want <= limit else (limit + 1, -1))


def contamination_by_hand(rows, items):
    want = {}
    for i, text in rows:
        for k, item in items:
            pattern, text_ = decontaminate.normalize(item or ""), decontaminate.normalize(text or "")
            if pattern and text_ and k is not None:
                d, _ = edit_distance_within(pattern, text_)
                if d <= decontaminate.budget(len(pattern)):
                    want[i, k] = d
    return want


def test_contamination_agrees_with_plain_distances(spark, make):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(1, 30)).capitalize() + ".") for i in range(14)] + [(50, "Short item"), (51, None), (52, "?!"), (None, "x" * 60), (53, "Kafka")]
    rows = []
    for i in range(90):
        text = prose(rng, rng.randrange(5, 60))
        if i % 2:
            item = list(items[i % 14][1])
            for _ in range(rng.randrange(0, 12)):
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice(["", "z", item[k] + "y"])
            text += " " + "".join(item).upper() + "  " + prose(rng, 10)
        rows.append((i, text))
    rows += [(90, "short  ITEM"), (91, "a short item."), (92, None), (93, ""), (94, "cohort itemised"), (95, "(Short-item)"), (96, "shortitem kafkaesque")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contamination(make(rows), benchmark).collect()}
    want = contamination_by_hand(rows, items)
    assert got == want and len(want) >= 20 and {i for i, k in got if k == 50} == {90, 91, 95} and not any(k == 53 for _, k in got)
    left = {r.doc_id for r in decontaminate.drop_contaminated(make(rows), benchmark).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}


def test_short_items_inside_documents(spark, make):
    items = [(1, "What is the capital of France?"), (2, "Name three primes"), (3, "Why?")]
    rows = [(1, "Quiz. What is the capital of France? Paris."), (2, "what was the capital of France"), (3, "They name three primes: 2, 3, 5"), (4, "whys and wherefores"), (5, "He asked why, twice."), (6, "what is the capitol of france")]
    got = {(r.doc_id, r.item_id): (r.distance, r.start, r.end) for r in decontaminate.contamination(make(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): 0, (6, 1): 1, (3, 2): 0, (5, 3): 0}
    for (doc, item), (d, a, b) in got.items():
        if not d:
            assert decontaminate.normalize(dict(rows)[doc])[a:b] == decontaminate.normalize(dict(items)[item]).strip()


def test_contamination_keeps_the_types_of_ids(spark):
    docs = spark.createDataFrame([("a1", "here one long enough item stands"), ("b", "nothing")], "doc_id string, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([("x9", "one long enough item")], "item_id string, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [("a1", "x9", 0)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, spark.createDataFrame([("x9", "one long enough item")], "item_id string, text string")).collect()] == ["b"]


def test_contamination_in_several_passes(spark, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", 100)
    rng = random.Random(2)
    items = [(i, prose(rng, 12)) for i in range(6)]
    docs = make([(i, f"before {t} after") for i, t in items])
    out = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(i, i) for i in range(6)}


def test_contamination_of_odd_rows(spark, odd, make):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a very long text of many words indeed " * 3), (1, "a very long text of many words indeed " * 3), (2, "")], "item_id bigint, text string")
    assert decontaminate.contamination(odd, none).collect() == []
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.contamination(odd, some).collect()] == [(4, 1, 0)]
    assert decontaminate.contamination(make([]), some).collect() == []
    assert decontaminate.drop_contaminated(odd, some).count() == odd.count() - 2


# --- language


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"), 60)
    rest = docs.where("doc_id % 2 = 1")
    out = langid.predict(rest, model, [F.col("lang"), F.col("text")]).select("_row.lang", "_row.text", "_family", "_language", "_accepted").where("length(text) > 80").collect()
    assert sum(r.lang == r._language for r in out) > 0.97 * len(out)
    assert sum(langid.FAMILIES[r.lang] == r._family for r in out) > 0.97 * len(out)
    assert sum(r._accepted for r in out) > 0.99 * len(out)


def test_language_of_odd_rows(spark, odd, make):
    out = langid.identify(odd).collect()
    assert len(out) == odd.count()
    assert all(r.language is None and not r.accepted for r in out if r.doc_id in (1, 2, 3, 5))
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {4, 6}
    assert langid.identify(make([])).collect() == []
    unlabelled = make([(1, "some text", None)])
    assert [(r.language, r.accepted) for r in langid.identify(unlabelled).collect()] == [(None, False)]
    assert langid.keep_identified(unlabelled).collect() == []


TEXTS = {"en": "the cat and the dog were there with that thing", "de": "der hund und die katze waren nicht auch dort", "fr": "le chat et les chiens sont dans la maison", "es": "el perro y los gatos estan en la casa"}


def language_rows(n, extra=""):
    rng, rows = random.Random(6), []
    for k, (lang, words) in enumerate(TEXTS.items()):
        words = (words + extra).split()
        rows += [(1000 * k + i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))), lang) for i in range(n)]
    return rows


def by_plain_votes(model, text):
    """Family and language from sums over single trigrams, a pair of languages at a time."""
    code, _ = langid.trigrams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    if not len(code):
        return None, None
    score = [sum(float(w[c]) for c in code) / len(code) + b for w, b in zip(model.weights, model.bias)]
    family = max(model.families, key=lambda f: score[model.families.index(f)])
    votes, strength = Counter(), Counter()
    for (a, b), margin in zip(model.pairs, score[len(model.families) :]):
        votes[a if margin >= 0 else b] += 1
        strength[a] += margin
        strength[b] -= margin
    return family, max((x for x in model.languages if model.family_of[x] == family), key=lambda x: (votes[x], strength[x]))


def test_language_agrees_with_plain_votes(make):
    rows = language_rows(40)
    docs = make(rows)
    model = langid.train(docs, 20)
    got = {r.doc_id: (r.family, r.language) for r in langid.identify(docs, 20).collect()}
    assert got == {i: by_plain_votes(model, text) for i, text, _ in rows}
    assert sum(got[i][1] == lang for i, _, lang in rows) >= 0.95 * len(rows)


def test_a_text_goes_to_python_once(make):
    rows = language_rows(3) + [(100, None, "en"), (101, "", "de")]
    docs = make(rows).withColumn("_text", F.lit("x")).withColumn("_row", F.lit(1))
    out = langid.keep_identified(docs)
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert len(re.findall(r"\btext#", lines[at + 1])) == 1, lines[at + 1]
    known = {r.doc_id for r in langid.identify(docs).where("accepted").collect()}
    assert known and sorted(out.collect()) == sorted(docs.where(F.col("doc_id").isin(list(known))).collect())


def test_svm_reaches_the_least_cost():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) + np.repeat([[0.8], [-0.8]], 20, 0)
    y = np.repeat([1.0, -1.0], 20)
    rows, index = np.repeat(np.arange(40), 5), np.tile(np.arange(5), 40)
    w, b = langid._svm(rows, index, x.ravel() / 3, 40, y, steps=3000)

    def cost(w, b):
        return 0.5e-3 * (w @ w) + (10.0 * 0.5 / 20 * np.maximum(0, 1 - y * (x / 3 @ w + b)) ** 2).sum()

    best, bias = np.zeros(5), 0.0
    for _ in range(100_000):  # plain gradient descent
        slack = np.maximum(0, 1 - y * (x / 3 @ best + bias)) * y * 0.25
        best, bias = best - 0.02 * (1e-3 * best - 2 * x.T / 3 @ slack), bias + 0.02 * 2 * slack.sum()
    assert abs(cost(w[:5], b) - cost(best, bias)) < 1e-3 * cost(best, bias) and not w[5:].any()


def test_rows_without_a_text_take_no_place(make):
    rows = language_rows(20)
    empty = [(10_000 + i, None if i % 2 else " 12 ", "en") for i in range(3000)]
    got = {r.doc_id: r.language for r in langid.identify(make(rows + empty), 5).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.9 * len(rows) and {got[i] for i, *_ in empty} == {None}


def test_language_ties_go_by_name(make):
    same = [(i, "one and the same text for both", lang) for i, lang in enumerate(["en", "de"] * 3)]
    assert {r.language for r in langid.identify(make(same * 2)).collect()} == {"de"}


# --- packing


def fits(rows, capacity):
    """Checks one result: nothing overlaps or leaves a bin; returns the number of bins and large items by bin."""
    bins, large = defaultdict(list), Counter()
    for r in rows:
        if r.n_tokens:
            bins[r.bin].append((r.offset, r.offset + r.n_tokens))
            large[r.bin] += 3 * r.n_tokens > capacity
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] >= 0 and spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert max(large.values(), default=0) <= 2 and set(bins) == set(range(len(bins)))
    return len(bins)


def by_hand(sizes, capacity):
    """Item by item: the number of bins that greedy pairs and best fit need."""
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    gaps = []
    while large:
        s = large.pop(0)
        mate = next((i for i, x in enumerate(large) if x <= capacity - s), None)
        gaps.append(capacity - s - (large.pop(mate) if mate is not None else 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps[gaps.index(min(fit))] -= s
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_fills_bins_as_item_by_item(sizes):
    steps, bins = packing.plan(Counter(sizes), 30)
    fill = Counter()
    for size, _, n, first, each, _ in steps:
        for i in range(n):
            fill[first + i // each] += size
    assert sorted(30 - fill[b] for b in range(bins)) == by_hand(sizes, 30)


def test_every_token_has_a_place(make):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 3, 10, 20, 33, 34, 50, 99, 100, 101, 250]))) for i in range(300)]
    out = packing.pack(make(rows, 6), 100).collect()
    fits(out, 100)
    for i, text in rows:
        mine = sorted((r.first_token, r.n_tokens) for r in out if r.doc_id == i)
        assert sum(n for _, n in mine) == len(text.split()) and [a for a, _ in mine] == [100 * k for k in range(len(mine))]
    assert len({r.bin for r in out if r.n_tokens}) == len(by_hand([r.n_tokens for r in out if r.n_tokens], 100))


@pytest.mark.parametrize("share_rows", [3, 1 << 20])
def test_bins_hold_their_pieces_in_order(spark, make, monkeypatch, share_rows):
    monkeypatch.setattr(packing, "SHARE_ROWS", share_rows)
    rng = random.Random(7)
    sizes = [rng.choice([0, 1, 2, 5, 20, 33, 34, 35, 60, 66, 67, 70, 100, 130, 333]) for _ in range(400)]
    docs = spark.createDataFrame([(i, "not read", n) for i, n in enumerate(sizes)], "doc_id int, text string, tokens int")
    places = packing.pack(docs, 100, "tokens")
    rows = places.collect()
    assert fits(rows, 100) == len(by_hand([min(100, n - at) for n in sizes for at in range(0, n, 100)], 100))
    seen = []
    for b in packing.bins(places).collect():
        at = 0
        for p in b.pieces:
            assert p.offset == at
            at += p.n_tokens
            seen.append((p.doc_id, p.piece, p.first_token, p.n_tokens, b.bin, p.offset))
        assert at == b.n_tokens <= 100
    assert sorted(seen) == sorted(tuple(r) for r in rows if r.n_tokens)
    assert sorted((r.doc_id, r.first_token) for r in rows) == sorted((i, at) for i, n in enumerate(sizes) for at in range(0, max(n, 1), 100))


def test_packing_plan_has_no_join_or_window_on_one_size(make):
    plan = packing.pack(make([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(n_tokens" not in plan


def test_packing_needs_no_python_workers(make):
    out = packing.pack(make([(i, "word " * (1 + i % 7)) for i in range(40)] + [(99, None)]), 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Scan ExistingRDD\[(\w+)", plan)) == {"doc_id"}, plan  # checkpoints alone; tables of the driver's rows are local
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(1 + i % 7 for i in range(40))


def test_packing_of_odd_rows(odd, make):
    out = packing.pack(odd).collect()
    fits(out, packing.CAPACITY)
    assert {(r.n_tokens, r.bin) for r in out if r.doc_id in (1, 2, 3)} == {(0, None)}
    assert sum(r.n_tokens for r in out if r.doc_id == 4) == 2 * 32000
    assert packing.pack(make([])).collect() == packing.bins(packing.pack(make([]))).collect() == []
    ties = packing.pack(make([(1, "a b c"), (1, "a b c"), (2, "d e f"), (None, "g h i")]), 3).collect()
    assert fits(ties, 3) == 4 and sorted(r.bin for r in ties) == [0, 1, 2, 3]


# --- the pipeline


def test_pipeline_stages_follow_on_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == first, name
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids)
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    fits(packed, packing.CAPACITY)
    assert {r.doc_id for r in packed} == ids
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, packed))


def test_pipeline_on_odd_and_empty_tables(spark, sf, odd, make, tmp_path):
    for i, docs in enumerate((odd, make([]))):
        folder = tmp_path / str(i)
        docs.write.parquet(f"{folder}/documents.parquet")
        (folder / "benchmark.parquet").symlink_to(f"{sf}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, str(folder)).collect()
        fits(rows, packing.CAPACITY)
        kept = {r.doc_id for r in langid.keep_identified(docs).collect()}  # nothing goes in the stages after the first
        assert {r.doc_id for r in rows} == kept and (kept == {4, 6, 7} if i == 0 else not kept)


@pytest.mark.parametrize("n", [1, 7])
def test_partitions_make_no_difference(make, n):
    rng = random.Random(8)
    base = [prose(rng, 60) for _ in range(20)]
    rows = [(i, base[i % 20] + (" tail" if i > 30 else "")) for i in range(45)]
    docs = make(rows, n)
    assert sorted(simhash.near_duplicates(docs).collect()) == sorted(simhash.near_duplicates(make(rows, 3)).collect())
    assert sorted(map(str, chunks.removed_passages(docs).collect())) == sorted(map(str, chunks.removed_passages(make(rows, 3)).collect()))
