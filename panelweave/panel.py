"""The panel: a long DataFrame keyed by instrument (sid) and dense date index (t)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import fin
from panelweave.plans.compiler import Compiler, lookback
from panelweave.plans.syntax import ExpressionError, inline, parse_program

KEYS = ("sid", "t", "date")


@dataclass
class Panel:
    """df has sid, t, date, the fields (double, NULL is missing), groups (int) and vectors (array of double).

    Each (sid, t) must be there once: windows count rows. ``densify`` makes it so.
    """

    df: DataFrame
    fields: tuple[str, ...]
    groups: tuple[str, ...] = ()
    vectors: tuple[str, ...] = ()
    subuniverse: str | None = None
    dataset_id: str = "panel"
    meta: dict = field(default_factory=dict)

    def compiler(self, verify_units: bool = True, prefix: str = "__n") -> Compiler:
        return Compiler(self.fields, self.groups, self.vectors, verify_units, prefix)

    def with_expressions(self, expressions: dict[str, str], verify_units: bool = True) -> DataFrame:
        """The panel with a column for each expression, all in one plan with shared windows."""
        compiler = self.compiler(verify_units)
        values = {name: compiler.add(text) for name, text in expressions.items()}
        df = compiler.apply(self.df)
        made = {name: fin(v.col().cast("double")) for name, v in values.items()}
        return df.withColumns(made).drop(*[s.out for s in compiler.steps])

    def eval(self, expression: str, first: int | None = None, last: int | None = None, verify_units: bool = True) -> DataFrame:
        """sid, t, date, value. With ``first`` only rows from t = first on are computed, and no more history is read
        than the expression's windows reach back."""
        panel = self
        if first is not None or last is not None:
            back = lookback(inline(parse_program(expression)))
            df = self.df
            if first is not None and back is not None:
                df = df.where(F.col("t") >= first - back)
            if last is not None:
                df = df.where(F.col("t") <= last)
            panel = Panel(df, self.fields, self.groups, self.vectors, self.subuniverse, self.dataset_id)
        out = panel.with_expressions({"__value": expression}, verify_units).select(*KEYS, F.col("__value").alias("value"))
        return out if first is None else out.where(F.col("t") >= first)

    def between(self, start, end) -> Panel:
        """The panel of these dates; t starts anew, as windows do."""
        df = self.df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        first = df.agg(F.min("t").alias("t0"))
        df = df.crossJoin(F.broadcast(first)).withColumn("t", F.col("t") - F.col("t0")).drop("t0")  # one row
        return Panel(df, self.fields, self.groups, self.vectors, self.subuniverse, self.dataset_id)

    def fingerprint(self) -> str:
        """Depends on every value, missing mark, group, array and the sub-universe, and not on the order of rows."""
        names = sorted(c for c in self.df.columns)
        each = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names])
        other = F.crc32(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names]).cast("binary"))
        row = self.df.agg(F.bit_xor(each).alias("x"), F.sum(F.pmod(each, F.lit(1 << 31))).alias("s"), F.sum(other).alias("c"), F.count(F.lit(1)).alias("n")).first()
        import hashlib

        return hashlib.sha256(repr((names, tuple(row), sorted(self.meta.items()))).encode()).hexdigest()


def densify(facts: DataFrame, dates: DataFrame, instruments: DataFrame) -> DataFrame:
    """One row for each date and instrument. dates: t, date, few and so broadcast; instruments: sid and its groups."""
    grid = instruments.crossJoin(F.broadcast(dates))
    return grid.join(facts, ["sid", "t"], "left")


def clean(df: DataFrame, fields) -> DataFrame:
    """Fields as doubles without NaN or infinities."""
    return df.withColumns({c: fin(F.col(c).cast("double")) for c in fields})


def validate(panel: Panel, close: str = "close", adv: str = "adv20") -> list[str]:
    """What is wrong with a panel; an empty list if nothing is."""
    df, out = panel.df, []
    missing = [c for c in (*KEYS, *panel.fields, *panel.groups, *panel.vectors) if c not in df.columns]
    if missing:
        return [f"missing columns: {', '.join(missing)}"]
    shape = df.agg(F.countDistinct("sid").alias("n"), F.countDistinct("t").alias("d"), F.count(F.lit(1)).alias("cells"), F.countDistinct("sid", "t").alias("keys"), F.max("t").alias("last")).first()
    if shape.d < 21 or shape.n < 2:
        out.append("a panel needs 21 dates and 2 instruments")
    if shape.cells != shape.n * shape.d or shape.keys != shape.cells or shape.last != shape.d - 1:
        out.append("not one row for each date and instrument")
    dates = df.select("t", "date").distinct()
    steps = dates.withColumn("before", F.lag("date").over(Window.orderBy("t")))
    if steps.where("before >= date").limit(1).count():
        out.append("dates don't rise")
    if close in panel.fields:
        row = df.agg(F.avg(F.col(close).isNotNull().cast("double")).alias("cover")).first()
        if row.cover < 0.95:
            out.append(f"{close} is known in {row.cover:.1%} of cells; 95 % are needed")
        if df.where("t > 20").groupBy("t").agg(F.count(close).alias("k")).where("k = 0").limit(1).count():
            out.append(f"a date without any {close}")
    if "returns" in panel.fields and df.where("returns <= -1").limit(1).count():
        out.append("returns of -100 % or less")
    if adv in panel.fields:
        cover = df.where("t > 20").agg(F.avg(F.col(adv).isNotNull().cast("double"))).first()[0]
        if cover is not None and cover < 0.9:
            out.append(f"{adv} is known in {cover:.1%} of cells after row 20; 90 % are needed")
    if panel.subuniverse:
        row = df.agg(F.min(F.col(panel.subuniverse).cast("int")).alias("lo"), F.max(F.col(panel.subuniverse).cast("int")).alias("hi")).first()
        if row.lo == row.hi:
            out.append("the sub-universe holds all or none")
    return out


def coverage(panel: Panel) -> DataFrame:
    """field, coverage: share of cells that are known."""
    row = panel.df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in panel.fields])
    return row.unpivot([], list(panel.fields), "field", "coverage")


__all__ = ["KEYS", "ExpressionError", "Panel", "clean", "coverage", "densify", "validate"]
