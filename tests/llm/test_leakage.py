import random
import re

import pytest

from tallyforge.llm import leakage

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, text string, doc_id string"


def words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


def brute(docs, items, n):
    out = set()
    for d, t, _ in docs:
        w = words(t)
        seen = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, q, _ in items:
            v = words(q)
            if i is not None and any(tuple(v[k : k + n]) in seen for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)


@pytest.fixture(params=[None, 150])
def blocks(request, monkeypatch):
    """One block, and many."""
    if request.param:
        monkeypatch.setattr(leakage, "MOST_NGRAMS", request.param)
        monkeypatch.setattr(leakage, "SEGMENT_NGRAMS", 7)


@pytest.fixture
def data():
    r = random.Random(6)
    vocabulary = ["the", "A", "cat", "Café", "naïve", "x1", "42", "東京", "mat", "sat", "on", "und", "Straße"]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "_", "-", "  ", " «"]) for _ in range(k))
    items = [(i, text(r.randrange(3, 30)), "c") for i in range(40)] + [(90, None, ""), (91, "", ""), (None, text(20), ""), (92, "the cat sat", "")]
    docs = []
    for d in range(150):
        t = text(r.randrange(0, 40))
        if r.random() < 0.5:
            q = words(r.choice(items[:40])[1])
            a = r.randrange(len(q))
            t += " / ".join(x.upper() for x in q[a : a + r.randrange(1, 12)]) + " " + text(5)
        docs.append((d, t, "c"))
    return docs + [(500, None, ""), (501, "", ""), (502, "the " * 200000, ""), (503, items[1][1], ""), (503, items[1][1], "")], items


@pytest.mark.parametrize("n", [1, 3, 6])
def test_against_brute_force(spark, data, n):
    docs, items = data
    d, i = frames(spark, docs, items)
    got = [tuple(r) for r in leakage.find_leaks(d, i, n=n).collect()]
    assert set(got) == brute(docs, items, n)


def test_blocks_give_the_same(spark, data, blocks):
    docs, items = data
    d, i = frames(spark, docs, items)
    assert {tuple(r) for r in leakage.find_leaks(d, i, n=4).collect()} == brute(docs, items, 4)


def test_spans_and_cleaning(spark, data, blocks):
    docs, items = data
    docs = docs[:150]
    d, i = frames(spark, docs, items)
    text = {k: t for k, t, _ in docs}
    spans = leakage.leaked_spans(d, i, n=4).collect()
    assert {(r.doc_id, r.item_id) for r in spans} == brute(docs, items, 4)
    quoted = {k: " ".join(words(t)) for k, t, _ in items}
    for r in spans:
        part = words(text[r.doc_id][r.first_char : r.end_char])
        assert len(part) >= 4
        assert all(" ".join(part[k : k + 4]) in quoted[r.item_id] for k in range(len(part) - 3))
    clean = leakage.without_leaks(d, i, n=4).collect()
    assert len(clean) == 150 and all(len(r.text) + r.removed_chars == len(text[r.doc_id]) for r in clean)
    hit = {k for k, _ in brute(docs, items, 4)}
    assert {r.doc_id for r in clean if r.removed_chars} == hit
    kept = leakage.without_leaks(d, i, n=4, drop_documents=True).collect()
    assert {r.doc_id for r in kept} == set(text) - hit and all(r.text == text[r.doc_id] for r in kept)


def test_rows_are_judged_each_for_itself(spark, blocks):
    """Repeated rows, rows of one id and rows without an id, in one block as in several."""
    quote = "one two three four five six"
    items = [(i, f"{quote} x{i} " + " ".join(f"w{i}{k}" for k in range(40)), "") for i in range(12)] + [(3, f"{quote} x3 " + " ".join(f"w3{k}" for k in range(40)), "")]
    docs = [(1, f"a {quote} b", ""), (1, f"a {quote} b", ""), (1, "nothing here at all", ""), (None, f"ÄÖ {quote.upper()}!", ""), (None, f"ÄÖ {quote.upper()}!", ""), (None, None, ""), (2, "w70, w71 \x01w72\x02 W73", ""), (4, "İ " + " ".join(f"w5{k}" for k in range(30)) + " 東京 " + quote, "")]
    d, i = frames(spark, docs, items)
    pairs = sorted((tuple(r) for r in leakage.find_leaks(d, i, n=4).collect()), key=str)
    assert pairs == sorted([(k, x) for k in (1, 1, None, None, 4) for x in range(12)] + [(2, 7)], key=str)
    spans = sorted((tuple(r) for r in leakage.leaked_spans(d, i, n=4).collect()), key=str)
    text5 = docs[7][1]
    want = [(k, x, a, a + len(quote)) for k, a in ((1, 2), (1, 2), (None, 3), (None, 3), (4, text5.index("one"))) for x in range(12)] + [(2, 7, 0, len(docs[6][1])), (4, 5, 2, text5.index(" 東京"))]
    assert spans == sorted(want, key=str)
    clean = sorted((tuple(r) for r in leakage.without_leaks(d, i, n=4).collect()), key=str)
    assert clean == sorted([(1, "a  b", 27), (1, "a  b", 27), (1, "nothing here at all", 0), (None, "ÄÖ !", 27), (None, "ÄÖ !", 27), (None, None, 0), (2, "", len(docs[6][1])), (4, "İ  東京 ", len(text5) - 6)], key=str)
    kept = sorted((tuple(r) for r in leakage.without_leaks(d, i, n=4, drop_documents=True).collect()), key=str)
    assert kept == sorted([(1, "nothing here at all", 0), (None, None, 0)], key=str)


def test_empty_tables(spark, data):
    d, i = frames(spark, *data)
    assert leakage.find_leaks(d.limit(0), i).collect() == []
    assert leakage.find_leaks(d, i.limit(0)).collect() == []
    assert leakage.without_leaks(d, i.limit(0)).count() == d.count()


def test_hash_collisions_are_verified(monkeypatch):
    import numpy as np
    import pyarrow as pa

    grams = leakage.Ngrams([7], pa.array(["a b c"]), 3)
    other = leakage.Ngrams([8], pa.array(["x y z"]), 3)
    grams.hashes = other.hashes  # as if both had one hash
    grams.filter = other.filter
    assert all(len(x) == 0 for x in grams.hits(pa.array(["x y z"])))
    assert [x.tolist() for x in other.hits(pa.array(["q X, y_Z w"]))] == [[0], [1], [8]]
    assert np.array_equal(other.hits(pa.array(["none"]))[0], [])
