"""Operators on single texts: word-piece counts, licences, pages, transport streams, chat windows."""

import random
import re
from html import unescape

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import chat, html, licenses, media, wordpieces
from corvane.llm.license_texts import TEMPLATES


def pieces(word, opening, inner):
    word, n, i, known = b" " + word, 0, 0, opening
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in known), None)
        if j is None:
            return 1
        i, n, known = j, n + 1, inner
    return n


def test_wordpiece_counts_follow_greedy_cuts(spark, sf):
    opening, inner = map(set, wordpieces.load())
    for r in spark.read.parquet(f"{sf}/documents.parquet").join(wordpieces.token_counts(spark.read.parquet(f"{sf}/documents.parquet")), "doc_id").collect():
        words = [w for w in re.split(rb"[\x00-\x20]+", (r.text or "").encode()) if w]
        assert (r.n_words, r.n_tokens) == (len(words), sum(pieces(w, opening, inner) for w in words))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.text("abcd", min_size=1, max_size=12))
def test_automaton_for_any_vocabulary(opening, inner, word):
    first = {b" " + w.encode() for w in opening}
    rest = {w.encode() for w in inner}
    a = wordpieces.Automaton(sorted(first), sorted(rest))
    data = np.frombuffer(word.encode(), np.uint8)
    want = pieces(word.encode(), first, rest)
    assert a.count(b" " + word.encode()) == want == a.counts(data, np.array([0]), np.array([len(data)]))[0]


def test_wordpieces_of_odd_rows(spark, odd, make):
    out = sorted(wordpieces.token_counts(odd).collect(), key=str)
    assert len(out) == odd.count()
    assert {(r.n_words, r.n_tokens) for r in out if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert wordpieces.token_counts(make([])).collect() == []
    named = spark.createDataFrame([("a1", "one two"), (None, "x")], "doc_id string, text string")
    assert {(r.doc_id, r.n_words) for r in wordpieces.token_counts(named).collect()} == {("a1", 2), (None, 1)}


def whole_alignment(template, words):
    """The best local alignment without a band: (score, matches)."""
    best, above = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words):
            s, m = above[j]
            cell = (s + 2, m + 1) if t == w else (s - 1, m)
            cell = max(cell, (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]), key=lambda c: c[0])
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        above = row
    return best


def test_licences_agree_with_whole_alignments(spark, make):
    rng, filler = random.Random(3), "lorem ipsum dolor sit amet consectetur adipiscing elit".split()
    rows = []
    for i in range(60):
        words = [rng.choice(filler) for _ in range(rng.randrange(40))]
        name, _, text = TEMPLATES[i % len(TEMPLATES)]
        inner = text.split()
        for _ in range(rng.randrange(3) if len(inner) > 20 else 0):
            inner[rng.randrange(len(inner))] = "changed"
        if i % 5:
            words[len(words) // 2 : len(words) // 2] = inner
        rows.append((i, " ".join(words)))
    docs = make(rows)
    found, index = {}, licenses.Index(TEMPLATES)
    for r in licenses.license_spans(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
        text = dict(rows)[r.doc_id][r.start : r.end]
        assert re.match(r"\w", text) and r.coverage >= 0.8
    for i, text in rows:
        words = licenses._words(text).tolist()
        every = [(-whole_alignment(w, words)[1], len(w), k) for k, w in enumerate(index.lists)]
        every = sorted(x for x in every if -x[0] >= index.need[x[2]])  # they overlap, as there is one insertion
        want = {TEMPLATES[every[0][2]][0]} if every else set()
        assert found.get(i, set()) == want, text


def test_notices_in_a_row_are_all_found(make):
    mit, cc = "Licensed under the MIT License.", "Licensed under CC BY-SA 4.0."
    texts = [f"{mit}\n{mit}", f"a.py {mit} b.py {mit} c.py {cc} d.py {mit}", "\n".join([mit] * 300), f"{mit} Licensed under the {mit} {mit}"]
    got = {}
    for r in licenses.license_spans(make(list(enumerate(texts)))).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start, r.end))
    for i, text in enumerate(texts):
        want = [(name, m.start(), m.end() - 1) for name, notice in (("MIT", mit), ("CC-BY-SA-4.0", cc)) for m in re.finditer(re.escape(notice), text)]
        assert sorted(got[i]) == sorted(want), text


def test_several_insertions_are_each_found_once(make):
    rng, filler, rows, want = random.Random(11), "lorem ipsum dolor sit amet consectetur adipiscing elit".split(), [], {}
    for i in range(40):
        words, inside = [], []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice(filler) for _ in range(rng.randrange(0, 20))]
            name, kind, text = TEMPLATES[rng.randrange(len(TEMPLATES))]
            inner = re.findall("[0-9a-z]+", text.lower())
            for _ in range(rng.randrange(3) if kind == "text" else 0):
                inner[rng.randrange(2, len(inner) - 2)] = "changed"
            inside.append((name, len(words), len(words) + len(inner)))
            words += inner
        rows.append((i, " ".join(words)))
        starts = [m.start() for m in re.finditer(r"\S+", rows[-1][1])] + [len(rows[-1][1])]
        want[i] = [(name, starts[a], starts[b]) for name, a, b in inside]
    got = {}
    for r in licenses.license_spans(make(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start, r.end))
    for i, text in rows:
        mine = sorted(got[i], key=lambda x: x[1])
        assert len(mine) == len(want[i]), text
        for (name, a, b), (found, s, e) in zip(want[i], mine):
            assert min(b, e) - max(a, s) >= 0.75 * (b - a), (name, found, text)
            assert found == name or found.split("-")[0] == name.split("-")[0], (name, found)  # notices that begin alike


def test_short_templates_and_types_of_ids(spark, tmp_path):
    docs = spark.createDataFrame([("a", "under WTFPL, they say; public domain too"), ("b", "nothing"), (None, "wtfpl")], "doc_id string, text string")
    got = licenses.license_spans(docs, [("W", "notice", "WTFPL"), ("P", "notice", "public domain"), ("none", "notice", "?!")]).collect()
    assert sorted(((r.doc_id or ""), r.license, r.start, r.end) for r in got) == [("", "W", 0, 5), ("a", "P", 23, 36), ("a", "W", 6, 11)]
    (tmp_path / "Mine-1.0.txt").write_text("You may do what you like with all of these things here")
    mine = licenses.folder_templates(str(tmp_path))
    assert [(r.doc_id, r.license) for r in licenses.license_spans(spark.createDataFrame([("x", "x " + mine[0][2])], "doc_id string, text string"), mine).collect()] == [("x", "Mine-1.0")]
    tag = spark.createDataFrame([(1, "// SPDX-License-Identifier: GPL-2.0-or-later\n// SPDX-License-Identifier: MIT")], "doc_id int, text string")
    assert [r.license for r in licenses.license_spans(tag).orderBy("start").collect()] == ["GPL-2.0-or-later", "MIT"]


def test_licences_of_odd_rows(odd, make):
    assert licenses.license_spans(odd).collect() == []
    assert licenses.license_spans(make([])).collect() == []
    twice = licenses.license_spans(make([(1, "é Released under the MIT License. x"), (1, "é Released under the MIT License. x")])).collect()
    assert [(r.license, r.start, r.end, r.coverage) for r in twice] == [("MIT", 2, 32, 1.0)] * 2
    assert licenses.license_spans(make([(1, "Released under the MIT License.")]), []).collect() == []


def test_page_text_agrees_with_sql_and_with_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted(tuple(r) for r in html.main_text(pages).collect())
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from '{sf}/pages.parquet'")
        assert sorted(c.sql(html.main_text_sql()).fetchall()) == got
    texts, kept, there, extra = {g[0]: g[1].split() for g in got}, 0, 0, 0
    for r in pages.collect():
        article = unescape(re.sub(r"<[^>]+>", " ", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])).split()
        common = len(set(article) & set(texts[r.page_id]))
        kept, there, extra = kept + common, there + len(set(article)), extra + len(set(texts[r.page_id]) - set(article))
    assert kept > 0.97 * there and extra < 0.03 * there


def test_page_cases(spark):
    rows = [(1, None), (2, ""), (3, "<p></p>"), (4, "plain &amp; short"), (5, "<script>a<p>b</p>" + "x" * 500), (None, "<div>" + "word " * 40 + "</div>"), (6, "<p>" + "long " * 60 + "</p>" + "<br>" * 9 + "<p>no</p>" + "<br>" * 9 + "<p>" + "more " * 60 + "</p>")] * 2
    out = html.main_text(spark.createDataFrame(rows, "page_id int, html string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.page_id, set()).add(r.text)
    assert len(out) == 14 and by[1] == {None} and by[2] == by[3] == by[5] == {""} and by[4] == {"plain & short"} and by[None] == {("word " * 40).strip()}
    six = next(r for r in out if r.page_id == 6)
    assert six.n_regions == 2 and "no" not in six.text.split() and six.n_kept == 2
    assert html.main_text(spark.createDataFrame([], "page_id int, html string")).collect() == []


def test_references_are_decoded_as_by_the_standard_library(spark):
    from html.entities import html5

    cases = [f"a&{n}b" for n in html5 if n.endswith(";")] + ["caf&eacute; &#233; &#x27;q&#X27;", "&#150;&#8212;&#x1F600;", "&amp;lt; &amp;amp;", "&&lt;&", "AT&T; &nosuch; & ;", "no reference", ""]
    odd = ["&#0;", "&#xD800;", "&#1114112;", "&#;", "&#x;", "&lt", "&#99999999;"]  # these stay
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases + odd], "html string").select(html.decoded(F.split("html", "&"))).collect()]
    assert got == [unescape(c).replace("\xa0", " ") for c in cases] + odd


def test_a_region_ends_at_the_dive(spark):
    dense, thin, none = "<p>" + "word " * 40 + "</p>", "<p>" + "thin " * 12 + "</p>", "<br>" * 5
    rows = [(1, thin + none + dense + thin + thin + none + thin), (2, dense + none + dense), (3, thin + thin)]
    out = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id int, html string"), surge=150, dive=40).collect()}
    assert out[1].text.split() == ["word"] * 40 + ["thin"] * 24 and out[1].n_regions == 1
    assert out[2].text.split() == ["word"] * 80 and out[2].n_regions == 2
    assert out[3].text.split() == ["thin"] * 24


def test_long_pages_and_clashing_columns(spark):
    page = "<p>" + "text " * 200_000 + "</p>" + "<p>a</p><p></p>" * 20_000
    rows = spark.createDataFrame([("x", page, "l", "m", 1)], "page_id string, html string, lines string, marks string, lens int")
    r = html.main_text(rows).first()
    assert r.page_id == "x" and len(r.text) >= 999_999 and r.n_regions == 1 and r.n_lines > 40_000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.integers(1, 4000))
def test_streams_round_trip(content, unit):
    blob = media.mux(content, unit)
    out = media.demux(blob)
    assert len(blob) % 188 == 0 and b"".join(x[-1] for x in sorted(out, key=lambda x: x[4])) == content
    assert all(x[8] and not x[7] for x in out)
    noisy = b"\x00\x01" * 7 + blob + b"G"
    assert [x[-1] for x in media.demux(noisy)] == [x[-1] for x in out]


def test_lost_repeated_and_damaged_packets():
    content = bytes(range(256)) * 40
    blob = media.mux(content)
    packets = [blob[i : i + 188] for i in range(0, len(blob), 188)]
    for i in range(2, len(packets)):
        out = media.demux(b"".join(packets[:i] + packets[i + 1 :]))
        same = [k for k, p in enumerate(packets) if (p[1] & 31, p[2]) == (packets[i][1] & 31, packets[i][2])]
        assert sum(x[7] for x in out) == (0 if i in (same[0], same[-1]) else 1)
        assert [x[-1] for x in media.demux(b"".join(packets[: i + 1] + packets[i:]))] == [x[-1] for x in media.demux(blob)]
    bad = bytearray(packets[1])
    bad[-8] ^= 1
    assert media.demux(packets[0] + bytes(bad) + b"".join(packets[2:])) == []
    assert media.demux(b"") == media.demux(b"G") == []


def plain_demux(blob):
    """(pid, pts, dts, random access, discontinuities, complete, payload), read bit by bit as the standard lays it out; aligned streams."""
    packets = []
    for at in range(0, len(blob) - 187, 188):
        p = blob[at : at + 188]
        bits = int.from_bytes(p[:4], "big")
        assert bits >> 24 == 0x47
        body, flags = p[4:], 0
        if bits >> 5 & 1:
            flags = body[1] if body[0] else 0
            body = body[1 + body[0] :]
        if bits >> 4 & 1 and not bits >> 23 & 1:
            packets.append((bits >> 8 & 0x1FFF, bits >> 22 & 1, bits & 15, flags, body, p[4:]))

    def section(pid):
        for n, start, _, _, body, _ in packets:
            if n == pid and start:
                s = body[1 + body[0] :]
                s = s[: 3 + (int.from_bytes(s[1:3], "big") & 0xFFF)]
                crc = 0xFFFFFFFF
                for byte in s:
                    for k in range(7, -1, -1):
                        crc = (crc << 1 ^ (0x04C11DB7 if (crc >> 31 ^ byte >> k) & 1 else 0)) & 0xFFFFFFFF
                if not crc and s[5] & 1:
                    yield s

    pids = set()
    for pat in section(0):
        for i in range(8, len(pat) - 4, 4):
            for pmt in section(int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF):
                i2 = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
                while i2 < len(pmt) - 4:
                    pids.add(int.from_bytes(pmt[i2 + 1 : i2 + 3], "big") & 0x1FFF)
                    i2 += 5 + (int.from_bytes(pmt[i2 + 3 : i2 + 5], "big") & 0xFFF)
    out = []
    for pid in sorted(pids):
        last, unit, units = None, None, []
        for n, start, counter, flags, body, raw in packets:
            if n != pid:
                continue
            gap = 0
            if last is not None:
                if counter == last[0] and raw == last[1]:
                    continue
                gap = int(counter != (last[0] + 1) % 16 and not flags >> 7)
            last = counter, raw
            if start:
                unit = [b"", gap, 0, flags >> 6 & 1]
                units.append(unit)
            elif unit:
                unit[2] += gap
            if unit:
                unit[0] += body
        for pes, before, inner, access in units:
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                continue

            def stamp(b):
                bits = f"{int.from_bytes(b, 'big'):040b}"
                return int(bits[4:7] + bits[8:23] + bits[24:39], 2)

            pts = stamp(pes[9:14]) if pes[7] & 0x80 else None
            dts = stamp(pes[14:19]) if pes[7] & 0x40 else pts
            size = int.from_bytes(pes[4:6], "big")
            data = pes[9 + pes[8] : 6 + size if size else None]
            out.append((pid, pts, dts, bool(access), before + inner, not inner and (not size or len(pes) >= 6 + size), data))
    return out


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=12000), st.integers(100, 4000), st.lists(st.tuples(st.sampled_from("lrs"), st.integers(2, 90)), max_size=5))
def test_streams_as_by_another_parser(content, unit, damage):
    blob = media.mux(content, unit)
    packets = [blob[i : i + 188] for i in range(0, len(blob), 188)]
    for kind, i in damage:  # lost, repeated, marked as damaged
        if i < len(packets):
            packets[i : i + 1] = {"l": [], "r": [packets[i]] * 2, "s": [packets[i][:1] + bytes([packets[i][1] | 0x80]) + packets[i][2:]]}[kind]
    blob = b"".join(packets)
    assert [(x[1], *x[4:]) for x in media.demux(blob)] == plain_demux(blob)


def test_tables_that_are_not_in_force(spark):
    blob = media.mux(b"abc" * 2000)
    later = bytearray(blob[:188])
    at = 188 - 184 + later[4] + 1 if later[3] & 0x20 else 4
    section = bytearray(later[at + 1 :])
    size = 3 + ((section[1] & 15) << 8 | section[2])
    section = section[:size]
    section[5] &= 0xFE
    body = bytes(section[:-4])
    later[at + 1 : at + 1 + size] = body + media.crc32(body).to_bytes(4, "big")
    assert len(media.demux(blob)) == 3 and media.demux(bytes(later) + blob[188:]) == []
    named = media.elementary_packets(spark.createDataFrame([("x", blob), (None, blob)], "doc_id string, media binary")).collect()
    assert sorted(str(r.doc_id) for r in named) == ["None"] * 3 + ["x"] * 3


def test_media_table(spark, odd, make):
    docs = make([(1, "abc" * 3000), (2, "é" * 10), (3, None), (4, "")])
    rows = media.elementary_packets(media.media_table(docs)).orderBy("doc_id", "pts").collect()
    for i, text in ((1, "abc" * 3000), (2, "é" * 10)):
        mine = [r for r in rows if r.doc_id == i]
        assert b"".join(r.data for r in mine) == text.encode() and mine[0].random_access and mine[0].pts == 90000
    assert {r.doc_id for r in rows} == {1, 2}
    texts = {}
    for r in media.elementary_packets(media.media_table(odd)).collect():
        texts.setdefault((r.doc_id, r.pts), []).append(r.data)
    for doc, text in {(r.doc_id, r.text) for r in odd.collect() if r.text}:
        mine = sorted((pts, parts[0]) for (d, pts), parts in texts.items() if d == doc)
        assert b"".join(x for _, x in mine) == text.encode()
    assert {len(v) for (d, _), v in texts.items() if d == 4} == {2} and {d for d, _ in texts} == {r.doc_id for r in odd.collect() if r.text}
    assert media.elementary_packets(media.media_table(make([]))).collect() == []
    raw = spark.createDataFrame([(1, None), (2, b""), (3, b"not a stream" * 99)], "doc_id int, media binary")
    assert media.elementary_packets(raw).collect() == []


def test_chat_agrees_with_sql(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    for budget, history in ((384, 128), (150, 0), (700, 600)):
        rows = chat.flat(chat.windows(turns, budget, history))
        got = sorted(tuple(r) for r in rows.collect())
        with duckdb.connect() as c:
            c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
            assert sorted(c.sql(chat.windows_sql(budget, history)).fetchall()) == got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=20), st.integers(1, 80), st.integers(0, 60))
def test_spans_are_whole_and_within_budget(tokens, room, history):
    out = chat.spans(tokens, room, history)
    assert [i for _, a, b in out for i in range(a, b)] == list(range(len(tokens)))
    for first, new, end in out:
        assert sum(tokens[first:end]) <= room or (first, end) == (new, new + 1)
        assert sum(tokens[first:new]) <= history
        if end < len(tokens):
            assert sum(tokens[first : end + 1]) > room


def test_chat_cases(spark):
    kind = "conv_id int, turn int, role string, text string, window string"
    rows = [(1, 0, "system", "be brief", "x"), (1, 1, "user", "q " * 50, "x"), (1, 2, "assistant", "a " * 86, "x"), (1, 3, "user", "r", "x"), (1, 4, "assistant", "b", "x"), (1, 4, "assistant", "b", "y"), (2, 0, "system", None, "x"), (3, 0, None, "w " * 500, "x"), (None, 0, "user", "lost", "x"), (4, None, "user", "lost", "x")]
    out = {(r.conv_id, r.window): r for r in chat.windows(spark.createDataFrame(rows, kind), 100, 30).collect()}
    assert set(out) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    assert all(out[1, i].text.startswith("<|system|>\nbe brief") for i in range(3))
    assert out[1, 2].targets and [out[1, 2].text[t.start : t.end] for t in out[1, 2].targets] == ["b<|end|>"]
    assert out[3, 0].oversize and out[3, 0].n_tokens == 504 and not out[2, 0].targets
    assert chat.windows(spark.createDataFrame([], kind)).collect() == []


def test_long_turns_and_ids_of_any_type(spark):
    long = "word " * 300_000
    rows = [("c", 0, "system", "brief", 1), ("c", 1, "user", long, 2), ("c", 2, "assistant", long, 3)]
    out = sorted(chat.windows(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, turns int")).collect(), key=lambda r: r.window)
    assert [(r.conv_id, r.oversize, r.n_tokens, r.n_target_tokens) for r in out] == [("c", True, 300_009, 0), ("c", True, 300_009, 300_000)]
    assert out[1].text[out[1].targets[0].start : out[1].targets[0].end] == long + "<|end|>"


def test_windows_by_another_tokenizer(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "one two", None if i == 4 else 30) for i in range(6)]
    out = sorted(chat.windows(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, pieces int"), 70, 0, "pieces").collect(), key=lambda r: r.window)
    assert [(r.first_turn, r.last_turn, r.n_tokens, r.n_target_tokens) for r in out] == [(0, 1, 68, 30), (2, 3, 68, 30), (4, 5, 38, 30)]


@pytest.mark.parametrize("history", [0, 500])
def test_repeated_targets_are_masked(spark, history):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} " * 20) for i in range(12)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 120, history).collect()
    trained = [r.text[t.start : t.end].split()[0] for r in out for t in r.targets]
    assert sorted(trained) == sorted(f"t{i}" for i in range(1, 12, 2))
    assert (sum(r.n_turns for r in out) > 12) == (history > 0)
