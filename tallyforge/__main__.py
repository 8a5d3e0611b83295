"""A shell for statements: ``python -m tallyforge STORE [FILE]``. Statements end with a semicolon; without a file they are read from
standard input. Values stand in aligned columns, missing ones as NULL."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from tallyforge.engine import Engine
from tallyforge.plans.syntax import tokens
from tallyforge.session import build_session
from tallyforge.store import TableStore


def statements(text: str) -> list[str]:
    """The statements of a script, cut at semicolons outside strings."""
    out, start = [], 0
    for t in tokens(text):
        if t.kind == "end" or (t.kind == "op" and t.text == ";"):
            if part := text[start : t.at].strip():
                out.append(part)
            start = t.at + 1
    return out


def shown(df: DataFrame, most: int = 1000) -> str:
    """At most so many rows, as a table of text; a last line says if there are more."""
    cell = lambda v: "NULL" if v is None else ";".join(map(str, v)) if isinstance(v, list) else str(v)
    taken = df.take(most + 1)
    rows = [df.columns, *([cell(v) for v in r] for r in taken[:most])]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows]
    return "\n".join(lines + [f"(more than {most} rows; write them with SELECT ... INTO)"] * (len(taken) > most))


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = build_session("tallyforge shell")
    engine = Engine(spark, TableStore(spark, args[0]), default_limit=5000)
    text = open(args[1]).read() if len(args) > 1 else sys.stdin.read()
    bad = 0
    for s in statements(text):
        try:
            out = engine.sql(s)
            print(shown(out) if isinstance(out, DataFrame) else f"{out} rows")
        except ValueError as e:
            bad += 1
            print(f"ERR: {e}")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
