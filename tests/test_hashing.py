import random

import plain_hashes
import pytest
from pyspark.sql import functions as F

from tallyforge.columnar import string_buffers
from tallyforge.functions import hashing
from tallyforge.plans.compiler import Compiler, scope_of
from tallyforge.plans.parser import parse_expression


def test_vectorised_hashes_are_the_plain_ones():
    import numpy as np
    import pyarrow as pa

    r = random.Random(2)
    texts = ["".join(r.choice("abcé東 ") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 300]))) for _ in range(500)] + ["", "x" * 70_000]
    raw, offsets, _ = string_buffers(pa.array(texts))
    for name in ("murmur64", "siphash"):
        got = getattr(hashing, name)(raw, offsets[:-1], np.diff(offsets))
        assert got.tolist() == [getattr(plain_hashes, name)(t.encode()) for t in texts]


@pytest.mark.parametrize("name", ["hash", "hash.sip"])
def test_missing_and_empty_have_no_hash(spark, name):
    df = spark.createDataFrame([("a",), ("",), (None,)], "s string")
    got = [r.h for r in df.select(Compiler(scope_of(df), "filter").value(parse_expression(f"{name}(s)")).col.alias("h")).collect()]
    assert got[0] is not None and got[1:] == [None, None]
    assert df.where(F.lit(False)).select(Compiler(scope_of(df), "filter").value(parse_expression(f"{name}(s)")).col.alias("h")).collect() == []
