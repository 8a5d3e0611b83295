"""A small JMESPath: fields, indexes, slices, projections, filters, pipes, multi-selects and comparisons."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r"\s+|(?P<q>\"(?:[^\"\\]|\\.)*\")|(?P<r>'(?:[^'\\]|\\.)*')|(?P<l>`[^`]*`)|(?P<n>-?\d+)|(?P<i>[A-Za-z_]\w*)|(?P<o>\[\?|\[\]|\|\||&&|==|!=|<=|>=|[\[\]{}().,:|*@!<>&])")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"cannot read {text[at:]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    """Trees are tuples whose first element is the kind."""

    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0

    def op(self, *ops: str) -> str | None:
        k, v = self.t[self.i]
        if k == "o" and v in ops:
            self.i += 1
            return v
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            raise ValueError(f"expected {op}")

    def pipe(self):
        left = self.either()
        while self.op("|"):
            left = ("pipe", left, self.either())
        return left

    def either(self):
        left = self.both()
        while self.op("||"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.compare()
        while self.op("&&"):
            left = ("and", left, self.compare())
        return left

    def compare(self):
        left = self.chain()
        if o := self.op("==", "!=", "<", "<=", ">", ">="):
            return ("cmp", o, left, self.chain())
        return left

    def chain(self):
        k, v = self.t[self.i]
        if self.op("!"):
            return ("not", self.chain())
        if self.op("("):
            left = self.pipe()
            self.need(")")
        elif self.op("@"):
            left = ("at",)
        elif self.op("*"):
            left = ("project", ("values", ("at",)), self.rest())
        elif k == "o" and v in ("[", "[?", "[]", "{"):
            left = self.bracket(("at",))
        elif k in "ri" or k == "q":
            self.i += 1
            left = ("lit", v[1:-1].replace("\\'", "'")) if k == "r" else ("field", json.loads(v) if k == "q" else v)
        elif k == "l":
            self.i += 1
            left = ("lit", json.loads(v[1:-1]))
        else:
            raise ValueError(f"unexpected {v!r}")
        return self.more(left)

    def more(self, left, inside: bool = False):
        """What follows a value. inside a projection a flattening ends it, since it is of the projection's result."""
        while True:
            k, v = self.t[self.i]
            if inside and k == "o" and v == "[]":
                return left
            if self.op("."):
                if self.op("*"):
                    left = ("project", ("values", left), self.rest())
                    continue
                k, v = self.t[self.i]
                if k == "o" and v in ("[", "{"):
                    left = ("sub", left, self.select())
                else:
                    self.i += 1
                    if k not in ("i", "q"):
                        raise ValueError("expected a field")
                    left = ("sub", left, ("field", json.loads(v) if k == "q" else v))
            elif k == "o" and v in ("[", "[?", "[]"):
                left = self.bracket(left)
            else:
                return left

    def rest(self):
        return self.more(("at",), True)

    def bracket(self, left):
        if self.op("[?"):
            test = self.pipe()
            self.need("]")
            return ("project", ("filter", left, test), self.rest())
        if self.op("[]"):
            return ("project", ("flatten", left), self.rest())
        k, v = self.t[self.i + 1]
        if self.t[self.i][1] == "{" or (k != "n" and v not in ("*", ":")):
            return ("sub", left, self.select())
        self.need("[")
        if self.op("*"):
            self.need("]")
            return ("project", ("items", left), self.rest())
        parts: list[int | None] = [None]
        while not self.op("]"):
            if self.op(":"):
                parts.append(None)
                continue
            k, v = self.t[self.i]
            if k != "n":
                raise ValueError("expected a number")
            parts[-1] = int(v)
            self.i += 1
        if len(parts) == 1:
            return ("index", left, parts[0])
        return ("project", ("slice", left, parts), self.rest())

    def select(self):
        if self.op("{"):
            out = []
            while not self.op("}"):
                k, v = self.t[self.i]
                self.i += 1
                self.need(":")
                out.append((json.loads(v) if k == "q" else v, self.pipe()))
                self.op(",")
            return ("object", out)
        self.need("[")
        out = []
        while not self.op("]"):
            out.append(self.pipe())
            self.op(",")
        return ("list", out)


def parse(text: str):
    p = _Parser(text)
    tree = p.pipe()
    if p.t[p.i][0] != "end":
        raise ValueError(f"unexpected {p.t[p.i][1]!r}")
    return tree


def plain_path(tree) -> str | None:
    """The path as the JVM's JSON functions write it, if the tree is only fields and indexes from the front."""
    if tree[0] == "field" and re.fullmatch(r"\w+", tree[1]):
        return f"$.{tree[1]}"
    if tree[0] == "sub" and tree[2][0] == "field" and re.fullmatch(r"\w+", tree[2][1]) and (p := plain_path(tree[1])):
        return f"{p}.{tree[2][1]}"
    if tree[0] == "index" and tree[2] >= 0 and (p := "$" if tree[1] == ("at",) else plain_path(tree[1])):
        return f"{p}[{tree[2]}]"
    return None


def _true(v) -> bool:
    return not (v is None or v is False or v in ("", [], {}) and not isinstance(v, (int, float)))


def search(tree, v):
    kind = tree[0]
    if kind == "at":
        return v
    if kind == "lit":
        return tree[1]
    if kind == "field":
        return v.get(tree[1]) if isinstance(v, dict) else None
    if kind in ("sub", "pipe"):
        left = search(tree[1], v)
        return None if left is None and kind == "sub" else search(tree[2], left)
    if kind == "index":
        left = search(tree[1], v)
        return left[tree[2]] if isinstance(left, list) and -len(left) <= tree[2] < len(left) else None
    if kind == "project":
        left = search(tree[1], v)
        return [y for x in left if (y := search(tree[2], x)) is not None] if isinstance(left, list) else None
    if kind == "values":
        left = search(tree[1], v)
        return list(left.values()) if isinstance(left, dict) else None
    if kind == "items":
        left = search(tree[1], v)
        return left if isinstance(left, list) else None
    if kind == "flatten":
        left = search(tree[1], v)
        return [y for x in left for y in (x if isinstance(x, list) else [x])] if isinstance(left, list) else None
    if kind == "slice":
        left = search(tree[1], v)
        return left[slice(*tree[2])] if isinstance(left, list) else None
    if kind == "filter":
        left = search(tree[1], v)
        return [x for x in left if _true(search(tree[2], x))] if isinstance(left, list) else None
    if kind == "not":
        return not _true(search(tree[1], v))
    if kind == "or":
        left = search(tree[1], v)
        return left if _true(left) else search(tree[2], v)
    if kind == "and":
        left = search(tree[1], v)
        return search(tree[2], v) if _true(left) else left
    if kind == "cmp":
        a, b = search(tree[2], v), search(tree[3], v)
        if tree[1] in ("==", "!="):
            return (a == b and isinstance(a, bool) == isinstance(b, bool)) == (tree[1] == "==")
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)):
            return None
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[tree[1]]
    if kind == "list":
        return None if v is None else [search(x, v) for x in tree[1]]
    return None if v is None else {k: search(x, v) for k, x in tree[1]}
