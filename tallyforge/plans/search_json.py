"""Filters written as query documents of a search engine."""

from __future__ import annotations

from tallyforge.plans.compiler import NotAllowed
from tallyforge.plans.syntax import Among, Between, Binary, Everything, Include, Listed, Literal, Name, Unary

_RANGE = {"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


def query_document(e, include=None) -> dict:
    """The bool query that a filter's expression stands for; include(name) gives the expression of an included filter."""
    if isinstance(e, Everything):
        return {"match_all": {}}
    if isinstance(e, Include):
        if include is None:
            raise NotAllowed(f"no filter {e.filter}")
        return query_document(include(e.filter), include)
    if isinstance(e, Unary) and e.op == "NOT":
        return {"bool": {"must_not": [query_document(e.arg, include)]}}
    if isinstance(e, Unary) and e.op == "EXISTS":
        return {"exists": {"field": str(e.arg)}}
    if isinstance(e, Between):
        return {"range": {str(e.arg): {"gt": _plain(e.low), "lt": _plain(e.high)}}}
    if isinstance(e, Among):
        return {"terms": {str(e.arg): [_plain(i) for i in e.items]}}
    if isinstance(e, Binary):
        if e.op in ("AND", "OR"):
            parts = [query_document(x, include) for x in _flat(e, e.op)]
            return {"bool": {"filter": parts} if e.op == "AND" else {"should": parts, "minimum_should_match": 1}}
        if isinstance(e.left, Name):
            name = str(e.left)
            if e.op == "=":
                return {"bool": {"must_not": [{"exists": {"field": name}}]}} if _plain(e.right) is None else {"term": {name: _plain(e.right)}}
            if e.op == "!=":
                return {"exists": {"field": name}} if _plain(e.right) is None else {"bool": {"must_not": [{"term": {name: _plain(e.right)}}]}}
            if e.op in _RANGE:
                return {"range": {name: {_RANGE[e.op]: _plain(e.right)}}}
            if e.op in ("LIKE", "CONTAINS"):
                text = str(_plain(e.right)).replace("%", "*")
                return {"wildcard": {name: text if e.op == "LIKE" and "*" in text else f"*{text}*"}}
            if e.op in ("INTERSECTS", "IN") and isinstance(e.right, Listed):
                return {"terms": {name: [_plain(i) for i in e.right.items]}}
    raise NotAllowed(f"no query document for {e}")


def _flat(e, op: str) -> list:
    return [*_flat(e.left, op), *_flat(e.right, op)] if isinstance(e, Binary) and e.op == op else [e]


def _plain(e):
    if not isinstance(e, Literal):
        raise NotAllowed(f"not a literal: {e}")
    return e.value
