"""Literal sources: vectors, matrices and small tables from comma text; and tables from files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from texloom.plans.template import split_parts


def items(*text: str, split: bool = True, delim: tuple[str, str] = ("{", "}"), vars: dict[str, object] | None = None) -> list[str]:
    """The items of comma text; boxes name variables, and an escaped comma is a plain one."""
    out: list[str] = []
    for t in text:
        parts = split_parts(t, ",", *delim) if split else [t]
        out += [re.sub(r"\\,", ",", p.strip()) for p in parts if p.strip() or not split]
    found = []
    for x in out:
        m = re.fullmatch(r"\{\s*(\w+)\s*\}", x)
        if m and vars and m[1] in vars:
            v = vars[m[1]]
            found += [str(y) for y in v] if isinstance(v, list | tuple) else [str(v)]
        else:
            found.append(re.sub(r"\{\s*(\w+)\s*\}", lambda m: str(vars[m[1]]) if vars and m[1] in vars else m[0], x))
    return found


def _number(x: str) -> float | None:
    try:
        return float(x)
    except ValueError:
        return None


def vec(*text: str, **how) -> Column:
    """An array literal."""
    return F.array(*(F.lit(x) for x in items(*text, **how)))


def matrix(text: str, *, numeric: bool = False, rows: int | None = None, **how) -> list[list]:
    """Rows by line, or by count; a short row is recycled to the longest."""
    lines = [items(line, **how) for line in text.strip().split("\n")] if "\n" in text.strip() else [items(text, **how)]
    if rows:
        flat = [x for line in lines for x in line]
        n = -(-len(flat) // rows)
        lines = [[flat[(r * n + c) % len(flat)] for c in range(n)] for r in range(rows)]
    width = max(map(len, lines))
    lines = [[line[k % len(line)] for k in range(width)] for line in lines]
    return [[_number(x) for x in line] for line in lines] if numeric else lines


def table(spark: SparkSession, text: str, names: list[str] | None = None, *, convert: bool = True, **how) -> DataFrame:
    """A small DataFrame; a column of numbers becomes one of doubles."""
    lines = matrix(text, **how)
    if names is None:
        names, lines = ([f"V{k + 1}" for k in range(len(lines[0]))], lines) if len(lines) == 1 else (lines[0], lines[1:])
    columns = list(zip(*lines, strict=True))
    kinds = ["double" if convert and all(_number(x) is not None for x in c) else "string" for c in columns]
    data = list(zip(*([_number(x) for x in c] if k == "double" else c for c, k in zip(columns, kinds, strict=True)), strict=True))
    return spark.createDataFrame(data, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
