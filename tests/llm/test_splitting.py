import random
import re

import pytest

from tallyforge.llm import splitting

SCHEMA = "doc_id bigint, text string, key string, piece int"


def make(r, size):
    out = []
    while sum(map(len, out)) < size:
        out.append(r.choice(["diff --git a/x b/x\n", "@@ -1,2 +3,4 @@\n", "\n", "  \n", "a line of text\n", "é東京" * r.randrange(1, 30), "x" * r.randrange(1, 90), "word word\n\n"]))
    return "".join(out)


def check(pieces, text, limit, overlap):
    raw = text.encode()
    last = 0
    for i, (n, a, b, t) in enumerate(sorted(pieces)):
        assert n == i and 0 < b - a <= limit and raw[a:b].decode() == t
        assert a == 0 if i == 0 else last - overlap <= a <= last - max(0, overlap - 3)
        assert b > last
        if b < len(raw) and not raw[a : b + 1][-1:] == b"" and b - a < limit - 3:
            assert raw[b - 1 : b] == b"\n"  # cut early only at a boundary
        last = b
    assert last == len(raw)


@pytest.mark.parametrize("range_bytes", [1 << 20, 333, 70])
@pytest.mark.parametrize(("limit", "overlap"), [(200, 20), (64, 0), (100, 60)])
def test_pieces(spark, range_bytes, limit, overlap):
    r = random.Random(limit)
    docs = [(i, make(r, r.randrange(10, 3000)), "c", 1) for i in range(25)] + [(90, None, "", 0), (91, "", "", 0), (92, "x" * limit, "", 0), (93, "x" * (limit + 1), "", 0), (94, "東" * 5000, "", 0), (95, "\n" * 1000, "", 0), (None, "y" * 999, "", 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = splitting.split_texts(df, item_id="doc_id", text="text", limit=limit, overlap=overlap, range_bytes=range_bytes).collect()
    text = {i: t for i, t, _, _ in docs}
    by = {}
    for x in rows:
        by.setdefault(x.doc_id and int(x.doc_id), []).append((x.piece, x.begin, x.end, x.text))
    assert set(by) == {i for i, t in text.items() if t is not None and len(t.encode()) > limit}
    for i, pieces in by.items():
        check(pieces, text[i], limit, overlap)


def test_ranges_do_not_change_the_cuts(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i, make(r, 4000), "", 0) for i in range(10)], SCHEMA)
    plans = [sorted(map(tuple, splitting.split_plan(df, item_id="doc_id", text="text", limit=300, overlap=30, range_bytes=k).collect())) for k in (1 << 20, 1000, 97)]
    assert plans[0] == plans[1] == plans[2]


def test_strongest_boundary_in_reach(spark):
    text = "a\n" * 30 + "diff --git a b\n" + "b\n" * 8 + "@@ -1 +1 @@\n" + "c\n" * 60
    df = spark.createDataFrame([(1, text, "", 0), (1, text, "", 0)], SCHEMA)
    rows = sorted(splitting.split_plan(df, item_id="doc_id", text="text", limit=110, overlap=10).collect())
    assert rows[::2] == rows[1::2]  # repeated rows come out repeated
    rows = rows[::2]
    assert rows[0].end == 60 and rows[1].begin == 50
    assert text[rows[1].end :].startswith("@@ ") or text[rows[1].end - 1] == "\n"


def test_long_blank_lines_across_edges(spark):
    """A blank line longer than any halo makes a paragraph, wherever the ranges lie."""
    text = "word\n" * 30 + " " * 300 + "\n" + "\t" * 90 + "\n" + "more\n" * 60 + "\n" + " " * 5000 + "\n" + "end\n" * 50
    df = spark.createDataFrame([(1, text, "", 0), (2, "\n" + text, "", 0), (3, " " * 400 + text, "", 0)], SCHEMA)
    plans = [sorted(map(tuple, splitting.split_plan(df, item_id="doc_id", text="text", limit=200, overlap=10, range_bytes=k).collect())) for k in (1 << 20, 1000, 141, 130, 7)]
    assert all(p == plans[0] for p in plans)
    assert 542 in [end for key, _, _, end in plans[0] if key == "1"]  # behind the tabs


def test_ids_may_be_shared(spark):
    a, b = "first line\n" * 50, "x" * 30 + "\n" + "other\n" * 90
    df = spark.createDataFrame([(1, a, "", 0), (1, b, "", 0), (None, b, "", 0), (None, a, "", 0)], SCHEMA)
    rows = splitting.split_texts(df, item_id="doc_id", text="text", limit=100, overlap=0).orderBy("doc_id", "piece", "begin").collect()
    for key in (None, "1"):
        own = sorted((r.piece, r.begin, r.end, r.text) for r in rows if r.doc_id == key)
        assert "".join(sorted(t for *_, t in own)) == "".join(sorted(t for text in (a, b) for *_, t in plain(text, 100, 0)))


def plain(text, limit, overlap):
    """Cuts byte by byte."""
    raw = text.encode()
    kinds = {}
    for m in re.finditer(rb"\n", raw):
        p = m.end()
        before = raw.rfind(b"\n", 0, p - 1)
        kinds[p] = 4 if re.match(rb"diff --git |diff --cc |Index: |From [0-9a-f]{40} ", raw[p:]) else 3 if re.match(rb"@@ -[0-9]", raw[p:]) else 2 if before >= 0 and not raw[before : p - 1].strip() else 1
    out, begin = [], 0
    while True:
        if len(raw) - begin <= limit:
            return [*out, (len(out), begin, len(raw), raw[begin:].decode())]
        end = 0
        for low in (begin + max(limit // 2, overlap), begin + overlap):
            found = [(k, p) for p, k in kinds.items() if low < p <= begin + limit]
            end = end or (max(found)[1] if found else 0)
        if not end:
            end = begin + limit
            while raw[end] & 0xC0 == 0x80:
                end -= 1
        out.append((len(out), begin, end, raw[begin:end].decode()))
        begin = end - overlap
        while begin < end and raw[begin] & 0xC0 == 0x80:
            begin += 1


def test_against_plain_cuts(spark, tmp_path):
    """Rows and files are cut alike, whatever the ranges."""
    r = random.Random(4)
    texts = [make(r, 6000) + r.choice(["", "\n", "From " + "a" * 40 + " x\n", "Index: x"]) + make(r, 3000) for _ in range(6)]
    want = [plain(t, 300, 40) for t in texts]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    for k in (1 << 20, 999, 64):
        got = splitting.split_texts(df, item_id="doc_id", text="text", limit=300, overlap=40, range_bytes=k).collect()
        assert [sorted((x.piece, x.begin, x.end, x.text) for x in got if x.doc_id == str(i)) for i in range(6)] == want
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}").write_bytes(t.encode())
    for k in (1 << 20, 500, 97):  # 97: over 64 ranges a file, so the scan has two levels
        got = splitting.split_files(spark, [str(tmp_path / f"f{i}") for i in range(6)], limit=300, overlap=40, range_bytes=k).collect()
        assert [sorted((x.piece, x.begin, x.end, x.text) for x in got if x.path.endswith(f"f{i}")) for i in range(6)] == want


def test_files(spark, tmp_path):
    r = random.Random(1)
    texts = {"a": make(r, 30000), "b": "", "c": "short", "d": "é" * 5000}
    for k, t in texts.items():
        (tmp_path / k).write_bytes(t.encode())
    (tmp_path / "e").write_bytes(b"\x80" * 1000)
    rows = splitting.split_files(spark, [str(tmp_path / k) for k in "abcde"], limit=500, overlap=50, range_bytes=700).collect()
    by = {}
    for x in rows:
        by.setdefault(x.path[-1], []).append((x.piece, x.begin, x.end, x.text))
    assert by["b"] == [(0, 0, 0, "")] and by["c"] == [(0, 0, 5, "short")]
    check(by["a"], texts["a"], 500, 50)
    check(by["d"], texts["d"], 500, 50)
    assert max(x[2] for x in by["e"]) == 1000
    assert splitting.split_files(spark, []).collect() == []


def test_empty_and_bad_parameters(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert splitting.split_texts(df, item_id="doc_id", text="text").collect() == []
    with pytest.raises(ValueError):
        splitting.split_plan(df, item_id="doc_id", text="text", limit=100, overlap=99)
