"""The registry of scalar functions: names, arities, and builders of typed columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from tallyforge.plans.values import Val


class WrongArguments(ValueError):
    """A function was called with arguments it doesn't take."""


@dataclass
class Context:
    """What functions may ask of their surroundings: the time they hold for now, the row's columns, the session's names."""

    now: Column
    columns: dict[str, Val] = field(default_factory=dict)
    database: str = "default"


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int | None
    build: Callable[..., Val]

    def __call__(self, ctx: Context, args: list[Val]) -> Val:
        if len(args) < self.least or (self.most is not None and len(args) > self.most):
            takes = f"{self.least}" if self.most == self.least else f"{self.least} or more" if self.most is None else f"{self.least} to {self.most}"
            raise WrongArguments(f"{self.name} takes {takes} arguments, not {len(args)}")
        return self.build(ctx, *args)


REGISTRY: dict[str, Function] = {}
#: Aggregates of one's own: a typed column in, the typed aggregate out.
AGGREGATE_REGISTRY: dict[str, Callable[[Val], Val]] = {}


def function(*names: str, args: tuple[int, int | None]):
    """Register a builder (ctx, *vals) -> Val under these names."""

    def put(build: Callable[..., Val]) -> Callable[..., Val]:
        for n in names:
            REGISTRY[n] = Function(n, args[0], args[1], build)
        return build

    return put


def register(name: str, build: Callable[..., Val], least: int = 0, most: int | None = None) -> None:
    """Add a function of one's own; it may take the place of another."""
    REGISTRY[name.lower()] = Function(name.lower(), least, most, build)


def register_aggregate(name: str, build: Callable[[Val], Val]) -> None:
    """Add an aggregate of one's own of one column, made of Spark's; it can't take the place of a built-in one."""
    from tallyforge.plans.compiler import AGGREGATES

    if name.lower() in AGGREGATES - set(AGGREGATE_REGISTRY):
        raise WrongArguments(f"{name} is built in")
    AGGREGATE_REGISTRY[name.lower()] = build
    AGGREGATES.add(name.lower())


def lookup(name: str) -> Function:
    import tallyforge.functions.library  # noqa: F401  the built-in ones register themselves

    if name.lower() not in REGISTRY:
        raise WrongArguments(f"there is no function {name}")
    return REGISTRY[name.lower()]
