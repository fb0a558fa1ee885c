"""Registry of language operators.

Each operator names the axis that its windows run along, so that the planner
can put operators of one axis under one exchange:

* ``row``: elementwise, no window
* ``time``: per instrument over time
* ``cross``: per date over instruments (also by group)
* ``frame``: needs a DataFrame step of its own
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Window

from panelweave.plans.syntax import ExpressionError

ROW, TIME, CROSS, FRAME = "row", "time", "cross", "frame"


@dataclass(frozen=True)
class Op:
    name: str
    least: int
    most: int
    axis: str
    build: Callable
    windows: tuple[int, ...] = ()  # which arguments are window literals
    groups: tuple[int, ...] = ()  # which arguments are groups
    vectors: tuple[int, ...] = ()
    literals: tuple[int, ...] = ()  # which arguments stay plain numbers
    lookback: Callable | None = None  # rows needed before the first; None: without bound
    check: Callable | None = None  # of the plain numbers, before anything is built; raises
    gives: str = "derived"  # dimension of the result: "pure", "first" (that of the first argument that has one) or "derived"
    text: str = ""


OPS: dict[str, Op] = {}


def op(name: str, least: int, most: int | None = None, axis: str = ROW, **options) -> Callable:
    """Register a function that builds a Column from Columns and plain numbers. Users may register their own."""

    def register(build: Callable) -> Callable:
        OPS[name] = Op(name, least, least if most is None else most, axis, build, text=(build.__doc__ or "").strip(), **options)
        return build

    return register


def of_time():
    return Window.partitionBy("sid").orderBy("t")


def rows(w: int):
    """The last w rows, today included."""
    return of_time().rowsBetween(-(w - 1), 0)


def of_date(*more):
    return Window.partitionBy("t", *more)


def positive_int(value, fn: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ExpressionError(f"{fn}: window must be a positive integer literal")
    return value


def arity_error(fn: str, spec: Op, n: int) -> ExpressionError:
    wanted = str(spec.least) if spec.least == spec.most else f"{spec.least} to {spec.most}"
    return ExpressionError(f"{fn} expects {wanted} arguments, got {n}")


__all__ = ["CROSS", "FRAME", "OPS", "ROW", "TIME", "Op", "arity_error", "of_date", "of_time", "op", "positive_int", "rows"]
