"""Hashes, encodings, identifiers and queries into JSON."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.columnar import padded, string_buffers
from tallyforge.functions import jmespath
from tallyforge.functions.registry import WrongArguments, function
from tallyforge.plans import values as V
from tallyforge.session import ship

_M = 0xC6A4A7935BD1E995


def _by_words(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, take) -> tuple[np.ndarray, np.ndarray]:
    """Hands take the whole words of eight bytes of all texts, word by word: which texts have one, and the words. Returns what is
    left of each text, as a number and as a count of bytes."""
    order = np.argsort(-sizes, kind="stable")
    counts = sizes[order] // 8
    for w in range(int(counts[0]) if len(counts) else 0):
        at = order[: np.searchsorted(-counts, -w, "left")]
        take(at, np.ascontiguousarray(raw[(starts[at] + 8 * w)[:, None] + np.arange(8)]).view("<u8").ravel())
    rest = sizes % 8
    tail = padded(raw, starts + sizes - rest, rest, 8)
    return np.ascontiguousarray(tail).view("<u8").ravel(), rest


def murmur64(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 1) -> np.ndarray:
    """MurmurHash64A of the slices of raw, as signed numbers."""
    m, r = np.uint64(_M), np.uint64(47)
    h = np.uint64(seed) ^ (sizes.astype(np.uint64) * m)

    def take(at: np.ndarray, k: np.ndarray) -> None:
        k = k * m
        h[at] = (h[at] ^ ((k ^ (k >> r)) * m)) * m

    tail, rest = _by_words(raw, starts, sizes, take)
    h = np.where(rest > 0, (h ^ tail) * m, h)
    h = (h ^ (h >> r)) * m
    return (h ^ (h >> r)).view(np.int64)


def siphash(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k0: int = 0, k1: int = 1) -> np.ndarray:
    """SipHash-2-4 of the slices of raw, as signed numbers."""
    # the constants of the published algorithm spell "somepseudorandomlygeneratedbytes"
    start = b"somepseudorandomlygeneratedbytes"
    v = [np.full(len(sizes), int.from_bytes(start[i : i + 8], "big") ^ (k0, k1)[(i // 8) % 2], np.uint64) for i in range(0, 32, 8)]

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def rounds(at, n: int) -> None:
        a, b, c, d = (x[at] for x in v)
        for _ in range(n):
            a, c = a + b, c + d
            b, d = turned(b, 13) ^ a, turned(d, 16) ^ c
            a = turned(a, 32)
            c, a = c + b, a + d
            b, d = turned(b, 17) ^ c, turned(d, 21) ^ a
            c = turned(c, 32)
        for x, y in zip(v, (a, b, c, d)):
            x[at] = y

    def take(at, k: np.ndarray) -> None:
        v[3][at] ^= k
        rounds(at, 2)
        v[0][at] ^= k

    tail, _ = _by_words(raw, starts, sizes, take)
    every = slice(None)
    take(every, tail | (sizes.astype(np.uint64) & np.uint64(0xFF)) << np.uint64(56))
    v[2] ^= np.uint64(0xFF)
    rounds(every, 4)
    return (v[0] ^ v[1] ^ v[2] ^ v[3]).view(np.int64)


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def _hashed(a, f):
    _session()

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        raw, offsets, valid = string_buffers(pa.array(s, pa.large_string(), from_pandas=True))
        return pd.Series(f(raw, offsets[:-1], np.diff(offsets)), dtype="Int64").where(valid)

    return V.whole(run(_full(a)))


@function("hash", args=(1, 1))
def hash_(ctx, a):
    return _hashed(a, murmur64)


@function("hash.sip", args=(1, 1))
def hash_sip(ctx, a):
    return _hashed(a, siphash)


def _full(a):
    return F.nullif(V.as_text(a), F.lit(""))


@function("hash.md5", args=(1, 1))
def md5(ctx, a):
    return V.text(F.md5(_full(a)))


@function("hash.sha1", args=(1, 1))
def sha1(ctx, a):
    return V.text(F.sha1(_full(a)))


@function("hash.sha256", args=(1, 1))
def sha256(ctx, a):
    return V.text(F.sha2(_full(a), 256))


@function("hash.sha512", args=(1, 1))
def sha512(ctx, a):
    return V.text(F.sha2(_full(a), 512))


@function("encoding.b64encode", args=(1, 1))
def b64encode(ctx, a):
    return V.text(F.base64(F.encode(_full(a), "utf-8")))


@function("encoding.b64decode", args=(1, 1))
def b64decode(ctx, a):
    s = _full(a)
    ok = s.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(s) % 4 == 0)
    return V.text(F.when(ok, F.unbase64(s)).cast("string"))


@function("uuid", args=(0, 0))
def uuid(ctx):
    return V.text(F.uuid())


@function("json.jmespath", args=(2, 2))
def json_jmespath(ctx, a, query):
    """The value of a JMESPath expression in JSON text, as text (lists and objects as JSON). A plain path runs in the JVM."""
    if not query.is_literal:
        raise WrongArguments("the expression is a literal")
    try:
        tree = jmespath.parse(str(query.value))
    except ValueError:
        return V.text(F.lit(None).cast("string"))
    path = jmespath.plain_path(tree)
    if path is not None:
        return V.text(F.get_json_object(V.as_text(a), path))
    _session()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _found(x, tree))

    return V.text(run(V.as_text(a)))


def _found(text: str | None, tree) -> str | None:
    if text is None:
        return None
    try:
        v = jmespath.search(tree, json.loads(text))
    except (ValueError, RecursionError):
        return None
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


