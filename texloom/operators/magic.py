"""The flag ``magic``: patterns and replacements that are templates, expanded once, on the driver."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import SparkSession, functions as F

from texloom.operators.row import Engine, Val
from texloom.plans.pattern import PatternError, split_flags

_QUANTIFIER = re.compile(r"(?<!\\)\{(?=\d+(?:,\d*)?\})")


def literal(x: object) -> Val:
    """A driver's value as a value of templates."""
    if isinstance(x, Val):
        return x
    xs = list(x) if isinstance(x, list | tuple) else [x]
    number = bool(xs) and all(isinstance(y, int | float) and not isinstance(y, bool) for y in xs)
    lits = [F.lit(float(y) if number else y) for y in xs]
    return Val("V", F.array(*lits), number) if isinstance(x, list | tuple) else Val("S", lits[0], number)


def has_magic(text: str) -> bool:
    try:
        return "magic" in split_flags(text)[0]
    except PatternError:
        return False


def expand(text: str, vars: Mapping[str, object] | None, engine: Engine | None = None, on: bool = False) -> str:
    """text with its boxes filled in and the flag taken away; other texts as they are. Quantifiers as ``{2,}`` aren't boxes."""
    if not on and not has_magic(text):
        return text
    from texloom.operators.templates import Scope, compile_template

    flags, body = split_flags(text)
    v = compile_template(_QUANTIFIER.sub(r"\\{", body), engine, Scope({k: literal(x) for k, x in (vars or {}).items()}))
    if v.kind != "S":
        raise PatternError(f"a pattern with magic must give one text: {text!r}")
    done = SparkSession.active().range(1).select(v.text().col.alias("x")).first()["x"]
    rest = ",".join(sorted(flags - {"magic"}))
    return f"{rest}/{done}" if rest else done.replace("/", r"\/", 1)
