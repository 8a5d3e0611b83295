import csv
import io
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.operators import rowcheck
from tallyforge.operators.rowcheck import USER_ROW, RowSchema, judge

csv.field_size_limit(1 << 30)
FIELD = r'(?:[^",\r\n]*|"(?:[^"]|"")*")'


def plain(line, n, last=r"[0-9]{1,18}"):
    line = line or ""
    body = re.sub(r"(\r\n|\n|\r)\Z", "", line)
    calm = re.sub(r"[\r\n]", " ", body)  # line breaks say nothing of quotes and columns
    if not re.fullmatch(f"{FIELD}(?:,{FIELD})*", calm, re.S):
        return "quoting"
    if len(next(csv.reader(io.StringIO(calm, newline="")), [""])) != n:
        return "column_count"
    if not re.fullmatch(f"{FIELD}(?:,{FIELD})*", body, re.S):
        return "quoting"
    row = next(csv.reader(io.StringIO(body, newline="")), [""])
    return None if not row[-1].strip() or re.fullmatch(last, row[-1]) else "value"


def test_judged_like_a_plain_reader():
    r = random.Random(1)
    parts = ["a", "", '"x"', '"a,b"', '"say ""hi"""', '"line\nbreak"', 'b"c', '"open', '"x"y', "7", '"12"', " ", "7.5", '" "', "　", "８", "\n", '"', '""', "," * 3, "1" * 19]
    lines = [",".join(r.choice(parts) for _ in range(r.randrange(1, 10))) for _ in range(4000)] + [None, "", "\n", "a,b,c,d,e,f,5\r\n", "x" * 300000, '"' * 100001, '""' * 100000 + ",b,c,d,e,f,1"]
    reason, broken = judge(pa.array(lines), USER_ROW)
    for line, got, k in zip(lines, reason, broken):
        assert got == plain(line, 7), (line or "")[:200]
        assert (k > 0) == (got is not None)


def test_first_broken_field():
    schema = RowSchema("t", ("a", "b", "c"), (("c", "[0-9]+"),))
    lines = ["1,2,3", '1,"2,3', "1,2", "1,2,3,4", "1,2,x", "", '"1"z,2,3', '1,2,"4 "', '1,2,"4"', "1|2\n3|4", "1\n,2", '1\n,"2', "1,2\n2,3", "1,2\n2,x", "1,2,3\n"]
    reason, broken = judge(pa.array(lines), schema)
    assert reason.tolist() == [None, "quoting", "column_count", "column_count", "value", "column_count", "quoting", "value", None, "column_count", "column_count", "quoting", "quoting", "quoting", None]
    assert broken.tolist() == [0, 2, 3, 4, 3, 2, 1, 3, 0, 2, 3, 2, 2, 2, 0]


def test_tables(spark):
    good = 'u,e,"a,b",d,1,"{""k"":1}",5'
    rows = [(1, "users", good, "x"), (1, "users", good, "x"), (2, "users", "a,b", "x"), (3, "users", None, "x"), (4, None, good, "x"), (5, "other", "a", "x"), (6, "users", 'u,e,i,d,1,j,"many\nlines"', "x")]
    df = spark.createDataFrame(rows, "row_id bigint, target_table string, line string, reason string")
    got = sorted((r.row_id, r.reason, r.field) for r in rowcheck.failing_lines(df, [USER_ROW]).collect())
    assert got == [(2, "column_count", "interests"), (3, "column_count", "email"), (6, "value", "item_count")]
    loaded = rowcheck.valid_lines(df, USER_ROW).collect()
    assert [tuple(r) for r in loaded] == [(1, "u", "e", "a,b", "d", "1", '{"k":1}', "5")] * 2
    assert rowcheck.failing_lines(df.limit(0), [USER_ROW]).collect() == []
    assert rowcheck.valid_lines(df.limit(0), USER_ROW).collect() == []


def test_schema_of_one_field(spark):
    one = RowSchema("one", ("a",))
    rows = [(1, "one", ""), (2, "one", None), (3, "one", "x\n"), (4, "one", "x,y"), (5, "one", '"x\r\ny"')]
    df = spark.createDataFrame(rows, "row_id bigint, target_table string, line string")
    assert sorted(tuple(r) for r in rowcheck.valid_lines(df, one).fillna("-").collect()) == [(1, "-"), (2, "-"), (3, "x"), (5, "x\r\ny")]
    assert [(r.row_id, r.reason) for r in rowcheck.failing_lines(df, [one]).collect()] == [(4, "column_count")]


def test_landed_values(spark):
    values = [None, "", " ", "　", "1", "-1", "1.5", "1.55", "1.555", "1.", ".5", "+1", "1 ", "NaN", "1e3", "９", "-", "5'2\"", "x" * 100000]
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(values)], "row_id bigint, height string, value string")
    bad = {r.value for r in rowcheck.failing_values(df, rowcheck.CUSTOMER_ROW).collect()}
    assert bad == {"1.555", "1.", ".5", "+1", "1 ", "NaN", "1e3", "９", "-", "5'2\"", "x" * 100000}


def test_first_broken_landed_column(spark):
    schema = RowSchema("t", ("a", "b", "c"), (("a", "[0-9]+"), ("c", "[a-z]")))
    rows = [(1, "1", "?", "x"), (2, None, None, None), (3, "x", None, "?"), (4, "1", None, "?"), (5, "1\x001", None, "x"), (6, "7", None, "x\x00"), (6, "7", None, "x\x00"), (7, " ", None, "\n"), (None, "-", "", "")]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string, c string").withColumn("field", F.lit("clash"))
    got = [tuple(r) for r in rowcheck.failing_values(df, schema).collect()]
    assert sorted(got, key=str) == sorted([(3, "a", "x"), (4, "c", "?"), (5, "a", "1\x001"), (6, "c", "x\x00"), (6, "c", "x\x00"), (None, "a", "-")], key=str)
    assert rowcheck.failing_values(df.limit(0), schema).collect() == []


def test_fields_like_a_plain_reader():
    r = random.Random(3)
    parts = ["a", "", '"x"', '"a,b"', '"say ""hi"""', '"line\nbreak"', '""', '""""', "ü", '"ü,"', " "]
    lines = [",".join(r.choice(parts) for _ in range(3)) + r.choice(["", "\n", "\r\n"]) for _ in range(2000)] + [None] * 0
    want = [[x or None for x in next(csv.reader(io.StringIO(x, newline="")))] for x in lines]
    got = rowcheck.fields_of(pa.array(lines), 3)
    assert [list(row) for row in zip(*(c.to_pylist() for c in got))] == want
    assert [len(c) for c in rowcheck.fields_of(pa.array([], pa.string()), 3)] == [0, 0, 0]
    assert rowcheck.fields_of(pa.array(["", None, "x"]), 1)[0].to_pylist() == [None, None, "x"]
