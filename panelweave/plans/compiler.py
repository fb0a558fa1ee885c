"""From syntax tree to DataFrame: kinds, one column for each distinct node, and waves by axis.

The cost of a panel expression is the number of times its data change hands
between instruments (time-series windows) and dates (cross-sectional windows).
Nodes are hash-consed, so each distinct sub-expression is one column; nodes
whose inputs are ready are emitted axis by axis, staying on the present axis as
long as it has any, so Catalyst puts all of an axis' windows under one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import flag, number
from panelweave.operators import cross_section, elementwise, time_series  # noqa: F401  they register their operators
from panelweave.operators.registry import CROSS, FRAME, OPS, ROW, TIME, arity_error, positive_int
from panelweave.plans.syntax import Bin, Call, ExpressionError, Name, Neg, Node, Num, Program, inline, parse_program

SCALAR, MATRIX, GROUP, VECTOR = "scalar", "matrix", "group", "vector"


@dataclass
class Value:
    kind: str
    column: str | None = None
    number: float | int | None = None

    def col(self) -> Column:
        return F.col(self.column) if self.column else number(self.number)


@dataclass
class Step:
    out: str
    axis: str
    needs: tuple[str, ...]
    build: object


class Compiler:
    """Compiles any number of expressions against one set of fields into shared steps."""

    def __init__(self, fields, groups=(), vectors=(), verify_units: bool = True, prefix: str = "__n"):
        self.kinds = {**dict.fromkeys(groups, GROUP), **dict.fromkeys(fields, MATRIX), **dict.fromkeys(vectors, VECTOR)}
        self.verify = verify_units
        self.prefix = prefix
        self.steps: list[Step] = []
        self.seen: dict[Node, Value] = {}

    def add(self, text: str | Program | Node) -> Value:
        program = parse_program(text) if isinstance(text, str) else text
        node = inline(program) if isinstance(program, Program) else program
        value = self.value(node)
        if value.kind in (GROUP, VECTOR):
            if self.verify:
                raise ExpressionError(f"the expression is a {value.kind}, not a matrix")
            return Value(SCALAR)
        return value

    def emit(self, axis: str, needs: list[Value], build) -> Value:
        out = f"{self.prefix}{len(self.steps)}"
        self.steps.append(Step(out, axis, tuple(v.column for v in needs if v.column), build))
        return Value(MATRIX, out)

    def value(self, node: Node) -> Value:
        if node not in self.seen:
            self.seen[node] = self._value(node)
        return self.seen[node]

    def _value(self, node: Node) -> Value:
        if isinstance(node, Num):
            return Value(SCALAR, number=node.value)
        if isinstance(node, Name):
            if node.id in self.kinds:
                return Value(self.kinds[node.id], node.id)
            if node.id == "nan":
                return Value(SCALAR, number=None)
            raise ExpressionError(f"unknown field {node.id!r}")
        if isinstance(node, Neg):
            x = self.matrix(node.x, "-")
            if x.kind == SCALAR:
                return Value(SCALAR, number=None if x.number is None else -x.number)
            return self.emit(ROW, [x], lambda: -x.col())
        if isinstance(node, Bin):
            return self._infix(node)
        return self._call(node)

    def matrix(self, node: Node, fn: str) -> Value:
        value = self.value(node)
        if value.kind in (GROUP, VECTOR):
            if self.verify:
                raise ExpressionError(f"{fn}: expected a matrix, got a {value.kind}")
            return Value(SCALAR, number=None)
        return value

    def _infix(self, node: Bin) -> Value:
        if node.op in ("&", "|"):  # no check of kinds: a group counts as true
            a, b = self.value(node.left), self.value(node.right)
            parts = [F.lit(True) if v.kind in (GROUP, VECTOR) else elementwise.truth(v.col()) for v in (a, b)]
            return self.emit(ROW, [a, b], lambda: flag(parts[0] & parts[1] if node.op == "&" else parts[0] | parts[1]))
        a, b = self.matrix(node.left, node.op), self.matrix(node.right, node.op)
        if node.op in elementwise.COMPARE:
            compare = elementwise.COMPARE[node.op]
            if any(v.kind == SCALAR and v.number is None for v in (a, b)):  # a scalar nan differs from everything and is not passed on
                others = [v.col() for v in (a, b) if v.column]
                known = others[0].isNotNull() if others else F.lit(True)
                return self.emit(ROW, [a, b], lambda: F.when(known, 1.0 if node.op == "!=" else 0.0))
            return self.emit(ROW, [a, b], lambda: flag(compare(a.col(), b.col())))
        return self.emit(ROW, [a, b], lambda: elementwise.INFIX[node.op](a.col(), b.col()))

    def _literal(self, node: Node, fn: str):
        value = self.value(node)
        if value.kind != SCALAR:
            raise ExpressionError(f"{fn}: expected a number")
        return value.number

    def _call(self, node: Call) -> Value:
        spec = OPS.get(node.fn)
        if spec is None:
            raise ExpressionError(f"unknown operator {node.fn!r}")
        n = len(node.args)
        if not spec.least <= n <= spec.most:
            raise arity_error(node.fn, spec, n)
        if node.fn == "ts_step":
            return self.emit(ROW, [], lambda: F.col("t").cast("double"))
        if node.fn == "densify" and self.value(node.args[0]).kind == GROUP:
            g = self.value(node.args[0])
            return self.emit(FRAME, [g], lambda df, out: _densify_group(df, out, g.column))
        args, needs = [], []
        for i, arg in enumerate(node.args):
            if i in spec.windows:
                if not isinstance(arg, Num):
                    raise ExpressionError(f"{node.fn}: window must be a positive integer literal")
                args.append(positive_int(arg.value, node.fn))
                continue
            if i in spec.literals:
                args.append(self._literal(arg, node.fn))
                continue
            if i in spec.vectors:
                value = self.value(arg)
                if value.kind != VECTOR:
                    if self.verify:
                        raise ExpressionError(f"{node.fn}: expected a vector")
                    return Value(SCALAR, number=None)
            elif i in spec.groups:
                value = self.value(arg)
                if value.kind == SCALAR or value.kind == VECTOR or (value.kind == MATRIX and node.fn == "group_neutralize"):
                    raise ExpressionError(f"{node.fn}: expected a group")
            else:
                value = self.matrix(arg, node.fn)
            needs.append(value)
            args.append(value)
        if spec.check:
            spec.check(*[a for a in args if not isinstance(a, Value)])
        if node.fn == "group_backfill" and needs[1].kind == MATRIX:  # a matrix in place of the group: the date's mean
            x = needs[0]
            return self.emit(CROSS, [x], lambda: F.coalesce(x.col(), F.avg(x.col()).over(cross_section.of_date())))
        if node.fn == "ts_regression":
            return self._regression(args, needs)
        if node.fn == "trade_when" and all(v.kind == SCALAR for v in needs):
            return needs[2]
        if all(v.kind == SCALAR for v in needs) and spec.axis != ROW:
            raise ExpressionError(f"{node.fn}: expected a matrix")
        axis = ROW if node.fn == "bucket" and n > 2 else spec.axis
        plain = [a if not isinstance(a, Value) else a for a in args]
        build = (lambda df, out: spec.build(df, out, *[a.col() if isinstance(a, Value) else a for a in plain])) if axis == FRAME else (lambda: spec.build(*[a.col() if isinstance(a, Value) else a for a in plain]))
        return self.emit(axis, needs, build)

    def _regression(self, args, needs) -> Value:
        y, x, w, lag, kind = [*args, *(0, 0)[len(args) - 3 :]]
        if not isinstance(lag, int) or lag < 0:
            raise ExpressionError("ts_regression: the lag must not be negative")
        if kind not in (0, 1, 2):
            raise ExpressionError("ts_regression: kind must be 0, 1 or 2")
        if lag:
            source = x
            x = self.emit(TIME, [source], lambda: F.lag(source.col(), lag).over(time_series.of_time()))
        return self.emit(TIME, [y, x], lambda: time_series.regression(y.col(), x.col(), w, kind))

    def waves(self) -> list[tuple[str, list[Step]]]:
        """Steps in an order that changes axis as seldom as a greedy choice allows."""
        left = {s.out: s for s in self.steps}
        out: list[tuple[str, list[Step]]] = []
        axis = TIME
        while left:
            ready = [s for s in left.values() if not any(n in left for n in s.needs)]
            by = {a: [s for s in ready if s.axis == a] for a in (ROW, TIME, CROSS, FRAME)}
            if by[ROW]:
                chosen, kind = by[ROW], ROW
            elif by.get(axis):
                chosen, kind = by[axis], axis
            else:
                kind = max((a for a in (TIME, CROSS) if by[a]), key=lambda a: len(by[a]), default=FRAME)
                chosen = by[kind] if kind != FRAME else by[FRAME][:1]
                axis = kind
            out.append((kind, chosen))
            for s in chosen:
                del left[s.out]
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        for kind, steps in self.waves():
            if kind == FRAME:
                df = steps[0].build(df, steps[0].out)
            else:
                df = df.withColumns({s.out: s.build() for s in steps})
        return df


def _densify_group(df: DataFrame, out: str, group: str) -> DataFrame:
    """Code of each group value among all of the dimension's, one row for each value."""
    from pyspark.sql import Window

    codes = df.select(F.col(group).alias("__g")).where(F.col("__g").isNotNull()).distinct().withColumn(out, (F.dense_rank().over(Window.orderBy("__g")) - 1).cast("double"))
    return df.join(F.broadcast(codes), df[group] == codes["__g"], "left").drop("__g")


def lookback(node: Node) -> int | None:
    """Rows before a date that its value depends on; None if unbounded."""
    if isinstance(node, Call):
        spec = OPS.get(node.fn)
        inner = [lookback(a) for i, a in enumerate(node.args) if spec is None or i not in (*spec.windows, *spec.literals)]
        if spec is None or spec.axis in (TIME, FRAME) and node.fn != "regression_neut":
            if spec is None or spec.lookback is None:
                return None
            numbers = [a.value for i, a in enumerate(node.args) if i in (*spec.windows, *spec.literals) and isinstance(a, Num)]
            own = spec.lookback(*numbers)
        else:
            own = 0
    elif isinstance(node, Bin):
        inner, own = [lookback(node.left), lookback(node.right)], 0
    elif isinstance(node, Neg):
        inner, own = [lookback(node.x)], 0
    else:
        return 0
    return None if None in inner else own + max(inner, default=0)
