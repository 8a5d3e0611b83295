import random
import re

import pyarrow as pa

from tallyforge.columnar import MARKS, NO_VALUE
from tallyforge.operators.multivalue import SEPARATORS, Splitter, split_values


def plain(cell):
    """A state machine over characters."""
    if cell is None:
        return []
    s = cell.strip()
    if len(s) > 1 and (s[0], s[-1]) in (("[", "]"), ("{", "}"), ("(", ")")):
        s = s[1:-1].strip()
    if s.lower() in NO_VALUE or re.fullmatch(MARKS + "+", s):
        return []
    quotes, run = 0, 0
    for ch in s:
        quotes += ch == '"' and run % 2 == 0
        run = run + 1 if ch == "\\" else 0
    parts, cur, inside, run = [], "", False, 0
    for ch in s:
        if ch == '"' and run % 2 == 0:
            inside = not inside
        run = run + 1 if ch == "\\" else 0
        if ch in SEPARATORS and not (inside and quotes % 2 == 0):
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    out = []
    for p in [*parts, cur]:
        p = p.strip()
        if len(p) > 1 and p[0] == p[-1] == '"':
            p = re.sub(r'\\(["\\/])', r"\1", p[1:-1]).replace('""', '"').strip()
        if p:
            out.append(p)
    return out


CASES = {
    "a;b , c|d/e\tf\ng": list("abcdefg"),
    '"x, y";z': ["x, y", "z"],
    '["a", "b\\"c"]': ["a", 'b"c'],
    '"the ""red"" line",x': ['the "red" line', "x"],
    "{a,b}": ["a", "b"],
    "R&B;children's books;sci-fi": ["R&B", "children's books", "sci-fi"],
    "front desk": ["front desk"],
    ";;a;;": ["a"],
    "N/A": [], "unknown": [], "-": [], " ": [], "[]": [], '""': [], "[n/a]": [],
    "a;a": ["a", "a"],
    'a;"b': ["a", '"b'],
}


def test_cases():
    got = Splitter()(pa.array(list(CASES)))
    assert dict(zip(CASES, got.to_pylist())) == CASES
    assert {k: plain(k) for k in CASES} == CASES


def test_against_a_state_machine():
    r = random.Random(2)
    bits = ["a", "é", " ", '"', '""', "\\", '\\"', ",", ";", "|", "/", "\t", "[", "]", "{", "}", "none", "b c", "&", "-", "　"]
    cells = [None, "", ",", '"', "x," * 20000, '"' * 999] + ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(6000)]
    for col in (pa.array(cells), pa.chunked_array([pa.array(cells[:50]), pa.array(cells[50:])]), pa.array(["zz", *cells]).slice(1)):
        assert Splitter()(col).to_pylist() == [plain(c) for c in cells]


def test_table(spark):
    rows = [(1, "a;b", "x,y", "n"), (2, "a", None, "n"), (1, "a;b", "x,y", "n"), (None, "p,q", "", "n")]
    df = spark.createDataFrame(rows, "row_id bigint, v string, w string, item string")
    got = sorted(((r.source_table, r.row_id, r.column_name, r.item_pos, r.item) for r in split_values(df, ["v", "w"], source="s", least=2).collect()), key=str)
    want = [("s", 1, c, i, x) for c, xs in (("v", "ab"), ("w", "xy")) for i, x in enumerate(xs)] * 2 + [("s", None, "v", 0, "p"), ("s", None, "v", 1, "q")]
    assert got == sorted(want, key=str)
    assert len(split_values(df, ["v"], least=1).collect()) == 7
    assert split_values(df.limit(0), ["v"]).collect() == []
