"""``if(cond ; ops ; ops)`` and ``vif(cond ; text ; text)``."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, functions as F

from texloom.functions import numbers as N, regexes as R
from texloom.functions.expressions import evaluate
from texloom.plans.chain import ChainError, IfOps, OpCall, parse_chain
from texloom.plans.pattern import parse_pattern

_DOTS = re.compile(r"(?<![\w.])\.(N|len|C|nchar)\b|(?<![\w.)])\.(?![\w.])")


def named(cond: str) -> tuple[str, set[str]]:
    """The condition with its dots as names, and which of them it uses."""
    used: set[str] = set()

    def sub(m: re.Match) -> str:
        name = {"N": "_dot_n", "len": "_dot_n", "C": "_dot_c", "nchar": "_dot_c", None: "_dot"}[m[1]]
        used.add(name)
        return name

    return _DOTS.sub(sub, cond), used


def _nukes(chain: str | None) -> bool:
    return chain is not None and chain.strip() != "" and any(isinstance(s, OpCall) and s.name in ("nuke",) for s in parse_chain(chain))


def if_ops(engine, v, step: IfOps):
    from texloom.operators.templates import compile_template

    quoted = re.fullmatch(r"'(.*)'|\"(.*)\"", step.cond, re.S)
    expr, used = named(step.cond)

    def names(x: Column, number: bool, n: Column) -> dict[str, Column]:
        text = N.plain(x) if number else x
        return {"_dot": x if number else x, "_dot_c": F.length(text), "_dot_n": n}

    def branch(x, chain: str | None):
        """x: a Val."""
        if step.verbatim:
            return x if chain is None else compile_template(chain, engine, {".": x, "_dot": x})
        return x if chain is None or not chain.strip() else engine.chain(x, chain)

    if not quoted and used == {"_dot_n"}:  # one condition for the whole vector
        v = v.vector()
        cond = F.coalesce(evaluate(expr, {"_dot_n": F.size(v.col)}), F.lit(False))
        yes, no = (branch(v, c) for c in (step.yes, step.no))
        if step.verbatim:
            yes, no = (x.vector() if x.kind == "S" else x for x in (yes, no))
        if yes.kind != no.kind:
            raise ChainError(f"both branches of if() must give the same kind of value: {step.cond!r}")
        yes, no = (yes, no) if yes.number == no.number else (yes.text(), no.text())
        return replace(yes, col=F.when(cond, yes.col).otherwise(no.col))

    def test(x: Column, number: bool, n: Column) -> Column:
        if quoted:
            own = R.matches_spec(N.plain(x) if number else x, parse_pattern(quoted[1] if quoted[1] is not None else quoted[2]))
        else:
            own = evaluate(expr, names(x, number, n))
        return F.coalesce(own, F.lit(False))

    if v.kind == "G":
        v = v.vector()
    drops = [not step.verbatim and _nukes(c) for c in (step.yes, step.no)]
    if any(drops):
        v = v.vector()
        n = F.size(v.col)
        return replace(v, col=F.filter(v.col, lambda x: ~test(x, v.number, n) if drops[0] else test(x, v.number, n)))
    n = F.size(v.col) if v.kind == "V" else F.lit(1)

    def element(x: Column) -> Column:
        own = replace(v, kind="S", col=x)
        yes, no = branch(own, step.yes), branch(own, step.no)
        if yes.kind != "S" or no.kind != "S":
            raise ChainError(f"in an elementwise if(), operators must keep the length or drop all: {step.cond!r}")
        return F.when(test(x, v.number, n), yes.text().col).otherwise(no.text().col)

    return v.each(element)
