"""Search conditions and their compilation to column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("=", "<", ">", "<=", ">=", "like", "between", "len")


@dataclass(frozen=True)
class Cond:
    """column (``a|b``: any of them), op and value of one condition."""

    column: str
    op: str
    value: Any

    def human(self, titles: dict[str, str] | None = None) -> str:
        title = (titles or {}).get(self.column, self.column)
        if self.op == "between":
            return f"{title}: {self.value[0]}–{self.value[1]}"
        if self.op == "len":
            return f"{title}: {self.value} знаков"
        sign = {"=": ":", "like": " ~", ">": " >", "<": " <", ">=": " ≥", "<=": " ≤"}[self.op]
        return f"{title}{sign} {self.value}"


def explain(conds: list[Cond], titles: dict[str, str] | None = None) -> list[str]:
    """Each condition for readers, in order."""
    return [c.human(titles) for c in conds]


def valid(cond: Cond, kinds: dict[str, str]) -> bool:
    """Whether columns and operation are known and the value has the operation's form."""
    if cond.op not in OPS or any(c not in kinds for c in cond.column.split("|")):
        return False
    if cond.op == "between":
        return isinstance(cond.value, list | tuple) and len(cond.value) == 2
    return cond.value is not None


def _typed(value: Any, kind: str) -> Column:
    """A literal of the column's type; null if it has none (the condition then holds for no row)."""
    return F.lit(value).try_cast(kind) if kind != "string" else F.lit(str(value))


def compile_one(cond: Cond, kinds: dict[str, str]) -> Column:
    def on(name: str) -> Column:
        c, kind = F.col(name), kinds[name]
        if cond.op == "between":
            return c.between(_typed(cond.value[0], kind), _typed(cond.value[1], kind))
        if cond.op == "like":
            return F.upper(c.cast("string")).contains(str(cond.value).upper())
        if cond.op == "len":
            return F.length(c.cast("string")) == int(cond.value)
        v = _typed(cond.value, kind)
        return {"=": c == v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[cond.op]

    return reduce(lambda a, b: a | b, map(on, cond.column.split("|")))


def compile_all(conds: list[Cond], kinds: dict[str, str]) -> Column:
    """All conditions; several of one column and op ``=`` or ``like`` are alternatives. Unknown ones are left out; none at all holds for every row."""
    groups: dict[tuple[str, str], list[Column]] = {}
    for c in conds:
        if valid(c, kinds):
            groups.setdefault((c.column, c.op), []).append(compile_one(c, kinds))
    parts = [reduce((lambda a, b: a | b) if op in ("=", "like") else (lambda a, b: a & b), g) for (_, op), g in groups.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_text(words: list[str], columns: list[str]) -> Column:
    """Each word occurs in some column."""
    each = [reduce(lambda a, b: a | b, [F.upper(F.col(c)).contains(w.upper()) for c in columns]) for w in words]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def kinds_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def search(cards: DataFrame, conds: list[Cond], words: list[str] = (), order: str = "id", limit: int = 200) -> DataFrame:
    """The first cards that meet the conditions; words count only where there is no condition."""
    kinds = kinds_of(cards)
    found = cards.where(compile_all(conds, kinds))
    if words and not conds:
        found = found.where(any_text(list(words), [c for c, k in kinds.items() if k == "string"]))
    return found.orderBy(order).limit(limit)


def vocabulary(cards: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column of the table."""
    if column not in cards.columns:
        raise ValueError(f"no column {column}")
    return cards.select(column).where(F.col(column).isNotNull()).distinct()
