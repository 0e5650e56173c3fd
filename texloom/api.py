"""The functions that users call."""

from __future__ import annotations

import functools
import sys
import time
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from texloom.functions import regexes as R
from texloom.operators import frame, row
from texloom.operators.frame import all_match, any_match, enum_rows, freq_table, get, get_in, matches, paste_rows, split_rows, top, which
from texloom.operators.magic import expand
from texloom.operators.row import Engine, Val, wrap_text
from texloom.operators.templates import Scope, compile_template, value_of
from texloom.plans.chain import ChainError
from texloom.plans.pattern import PatternError, PatternSpec, parse_pattern
from texloom.plans.template import TemplateError, expressions, variables

_ENGINE = Engine()


def _finish(v: Val) -> Column:
    return v.vector().col if v.kind == "G" else v.col


def ops(col: Column | str, chain: str, *, df: DataFrame | None = None, array: bool = False, engine: Engine | None = None) -> Column:
    """A chain of operators on a string, number or array column.

    With ``df`` the column's type is looked up; else it is a string, or with
    ``array`` an array of strings.
    """
    c = F.col(col) if isinstance(col, str) else col
    v = value_of(c, df.select(c.alias("x")).schema[0].dataType) if df is not None else Val("V" if array else "S", c)
    return _finish((engine or _ENGINE).chain(v, chain))


def template(text: str, *more: str, df: DataFrame | None = None, vars: dict[str, Val | Column] | None = None, engine: Engine | None = None, delim: tuple[str, str] | str = ("{", "}"), sep: str = "", vectorize: bool = False, default: str | None = None, last: str | None = None, collapse: str | None = None, nest: bool = False) -> Column:
    """A template as a column; an array where its longest part is one."""
    delim = tuple(delim.split()) if isinstance(delim, str) else delim
    engine = engine or _ENGINE
    scope = Scope({k: v if isinstance(v, Val) else Val("S", v) for k, v in (vars or {}).items()}, df)
    pieces = [delim[0] + p + delim[1] if nest else p for p in (text, *more)]
    run = functools.partial(compile_template, engine=engine, scope=scope, delim=delim, default=default)
    if vectorize:
        v = Val("V", F.concat(*(run(p).vector().col for p in pieces)))
    else:
        v = run(sep.join(pieces))
    if last:
        v = engine.chain(v, last)
    if collapse is not None:
        v = Val("S", F.array_join(v.text().vector().col, collapse, "NA"))
    return _finish(v)


def interpolate(df: DataFrame, text: str, out: str, **options) -> DataFrame:
    """df with a template's result; only the columns that it names are read."""
    return df.withColumn(out, template(text, df=df, **options))


def clean(col: Column, *items: str, replacement: str = "", pipe: str = "=>", split: bool = True, engine: Engine | None = None, magic: bool = False, vars: dict | None = None, **flags: bool) -> Column:
    """Replacements one after another: ``p1, p2 => new``, or ``@chain`` for operators; ``\\@`` is a plain at sign. With ``magic``, items are templates that may name ``vars``."""
    on = {k for k, v in flags.items() if v}
    for item in items:
        if item.startswith("@"):
            col = _finish((engine or _ENGINE).chain(Val("S", col), item[1:]))
            continue
        item = item.removeprefix("\\") if item.startswith("\\@") else item
        item = item if f" {pipe} " in item or item.endswith(f" {pipe}") or not replacement else f"{item} {pipe} {replacement}"
        col = row.clean_text(col, expand(item, vars, engine, magic), on, split, pipe)
    return col


def replace(col: Column, pattern: str, replacement: str = "", **how) -> Column:
    return clean(col, pattern, replacement=replacement, split=False, **how)


def extract(col: Column, pattern: str, single: bool = False, **flags: bool) -> Column:
    """The first match (or an empty text), or all matches as an array."""
    flagset, body = row.R_flags(pattern, {k for k, v in flags.items() if v})
    opts = set(flagset) - {"single"}
    return row.extract_first(col, body, opts) if single or "single" in flagset else row.extract_all(col, body, opts)


def split(col: Column, pattern: str, **flags: bool) -> Column:
    return row.split_text(col, pattern, {k for k, v in flags.items() if v})


def fill(col: Column, n: int | Column, symbol: str = " ", *, right: bool = False, center: bool = False, center_right: bool = True, na: str | None = "NA") -> Column:
    if len(symbol) != 1:
        raise ChainError("the symbol to fill with is one character")
    col = F.coalesce(col, F.lit(na)) if na is not None else col
    return row.fill_text(col, n, symbol, right, center, center_right)


class Aliases:
    """Functions with other defaults and an operator registry of their own."""

    def __init__(self, *, vars: dict | None = None, **defaults) -> None:
        self.engine, self.defaults = Engine(vars), defaults
        self.register_fun, self.register_ops = self.engine.register_fun, self.engine.register_ops

    def template(self, text: str, *more: str, **options) -> Column:
        return template(text, *more, **{"engine": self.engine} | self.defaults | options)

    def ops(self, col: Column | str, chain: str, **options) -> Column:
        return ops(col, chain, engine=self.engine, **options)

    def clean(self, col: Column, *items: str, **options) -> Column:
        return clean(col, *items, engine=self.engine, **options)

    def vec(self, *items: str, **options):
        from texloom.sources import vec

        return vec(*items, **options)

    def cat(self, spark: SparkSession, text: str, **options) -> str:
        return cat(spark, text, **{"engine": self.engine} | options)


def register_fun(alias: str, fun, options: tuple[str, ...] = ()) -> None:
    _ENGINE.register_fun(alias, fun, options)


def register_ops(alias: str, chain: str) -> None:
    _ENGINE.register_ops(alias, chain)


class Timer:
    """Time since the start, since the last lap, and in total; on the driver."""

    def __init__(self) -> None:
        self.start = self.lap_start = time.monotonic()

    def reset(self) -> None:
        self.lap_start = time.monotonic()

    def lap(self) -> float:
        now, before = time.monotonic(), self.lap_start
        self.lap_start = now
        return now - before

    def total(self) -> float:
        return time.monotonic() - self.start


def cat(spark: SparkSession, text: str, *, width: int | None = None, leader: str = "", end: str = "", file: TextIO | None = None, **options) -> str:
    """Prints a template without columns, wrapped on request, and returns it."""
    c = template(text, **options)
    c = wrap_text(c, width, leader) if width else c
    out = spark.range(1).select(c.alias("x")).first()["x"]
    out = "\n".join(out) if isinstance(out, list) else out
    print(out, end=end, file=file or sys.stdout)
    return out


def message(spark: SparkSession, text: str, *, end: str = "\n", **options) -> str:
    return cat(spark, text, end=end, file=sys.stderr, **options)


__all__ = [
    "Aliases", "ChainError", "Engine", "PatternError", "PatternSpec", "TemplateError", "Timer", "Val", "all_match", "any_match", "cat", "clean", "enum_rows", "expressions", "extract", "fill",
    "frame", "freq_table", "get", "get_in", "interpolate", "matches", "message", "ops", "parse_pattern", "paste_rows", "register_fun", "register_ops", "replace", "split", "split_rows", "template", "top", "variables", "which", "R",
]
