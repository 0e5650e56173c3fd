"""Templates compiled to one value: the parts are pasted, arrays are recycled to the longest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from texloom.functions.expressions import evaluate
from texloom.operators.conditions import named
from texloom.operators.plural import plural
from texloom.operators.row import Engine, Val
from texloom.plans.template import Box, Choice, Plural, Slash, TemplateError, Text, parse_template

_NAME = re.compile(r"[A-Za-z_]\w*$")


class Scope(dict):
    """Names that expressions may use, besides the columns of ``df``."""

    def __init__(self, values: dict[str, Val] | None = None, df: DataFrame | None = None) -> None:
        super().__init__(values or {})
        self.df = df


def value_of(col: Column, kind: T.DataType) -> Val:
    def number(t: T.DataType) -> bool:
        return isinstance(t, T.NumericType)

    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if number(inner):
            return Val("V", F.transform(col, lambda x: x.cast("double")), True)
        return Val("V", col, False, isinstance(inner, T.BooleanType))
    return Val("S", col.cast("double") if number(kind) else col, number(kind), isinstance(kind, T.BooleanType))


def resolve(text: str, scope: dict, only_scope: bool = False, used: set | None = None) -> Val:
    """The value of an expression."""
    text = text.strip()
    if text in scope:
        if used is not None:
            used.add(text)
        return scope[text]
    if text == ".now":
        return Val("S", F.current_timestamp())
    if text == ".date":
        return Val("S", F.current_date())
    names = {k: v.col for k, v in scope.items() if _NAME.match(k)}
    mentioned = {w for w in re.findall(r"[A-Za-z_]\w*", text) if w in names}
    if mentioned:
        if used is not None:
            used |= mentioned
        number = not re.match(r"\s*(upper|lower|concat|substring|substr|toupper|tolower)\b", text)
        return Val("S", evaluate(text, names), number and not re.search(r"[<>=]", text), bool(re.search(r"[<>=]", text)))
    if only_scope:
        raise TemplateError(f"invalid expression {text!r}; it may use {', '.join(scope)}")
    df = getattr(scope, "df", None)
    if df is not None:
        return value_of(F.expr(text), df.select(F.expr(text).alias("x")).schema[0].dataType)
    return Val("S", F.expr(text))


def paste(parts: list[Val]) -> Val:
    """Parts one after another; a null is NA, and an array without elements an empty text."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("NA"))
    parts = [p.text() if p.kind != "G" else p.text().vector() for p in parts]
    arrays = [p for p in parts if p.kind == "V"]
    if not arrays:
        return Val("S", F.concat(*(text(p.col) for p in parts)) if len(parts) > 1 else text(parts[0].col))
    if len(parts) == 1:
        return Val("V", F.transform(parts[0].col, text))
    n = F.size(arrays[0].col) if len(arrays) == 1 else F.greatest(*(F.size(p.col) for p in arrays))

    def row(i: Column) -> Column:
        return F.concat(*(text(p.col) if p.kind == "S" else F.when(F.size(p.col) == 0, "").otherwise(text(F.get(p.col, (i % F.greatest(F.size(p.col), F.lit(1))).cast("int")))) for p in parts))

    some = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), row)
    return Val("V", some)


def compile_template(template: str, engine: Engine | None = None, scope: dict | None = None, *, delim: tuple[str, str] = ("{", "}"), default: str | None = None, only_scope: bool = False, used: set | None = None) -> Val:
    engine, scope = engine or Engine(), scope if scope is not None else {}
    nodes = parse_template(template, delim)
    sub = lambda text: compile_template(text, engine, scope, delim=delim, only_scope=only_scope, used=used)
    values: dict[int, Val] = {}

    def box_value(k: int) -> Val | None:
        node = nodes[k]
        if k not in values and isinstance(node, Box) and not node.verbatim:
            values[k] = resolve(node.body, scope, only_scope, used)
        return values.get(k)

    parts: list[Val] = []
    for k, node in enumerate(nodes):
        if isinstance(node, Text):
            parts.append(Val("S", F.lit(node.text)))
        elif isinstance(node, Slash):
            parts.append(Val("V", F.array(*(F.lit(x) for x in node.items))))
        elif isinstance(node, Box):
            if node.verbatim:
                v = sub(node.body) if delim[0] in node.body else Val("S", F.lit(node.body))
            else:
                v = box_value(k)
            chain = node.ops or (default if not node.verbatim else None)
            parts.append(engine.chain(v, chain) if chain else v)
        elif isinstance(node, Choice):
            parts.append(_choice(node, scope, sub, resolve))
        elif isinstance(node, Plural):
            if node.body is not None:
                values[k] = v = resolve(node.body, scope, only_scope, used)
            else:
                near = [*range(k - 1, -1, -1), *range(k + 1, len(nodes))]
                v = next((x for j in near if (x := values.get(j) or box_value(j)) is not None), None)
                if v is None:
                    raise TemplateError(f"a plural box without a value: {template!r}")
                values[k] = v
            n = v.col.cast("double") if node.by_value else (F.size(v.vector().col) if v.kind != "S" else F.lit(1)).cast("double")
            parts.append(Val("S", plural(node.ops, n, v, node.by_value, engine, scope)))
    if not parts:
        return Val("S", F.lit(""))
    if len(parts) == 1 and parts[0].kind == "S" and isinstance(nodes[0], Box):
        return paste(parts)
    return paste(parts)


def _choice(node: Choice, scope: dict, sub, resolve) -> Val:
    expr, used = named(node.cond)
    first = next((w for w in re.findall(r"(?<!['\"\w])[A-Za-z_]\w*(?!\w*\s*\()", re.sub(r"_dot\w*", "", expr)) if w.lower() not in ("and", "or", "not", "is", "null", "in", "like")), None)
    value = resolve(first, scope) if first else None
    names = {k: v.col for k, v in scope.items() if _NAME.match(k)}
    if value is not None:
        n = F.size(value.vector().col) if value.kind != "S" else F.lit(1)
        names["_dot_n"] = n
    if value is not None and value.kind == "V" and used != {"_dot_n"}:

        def element(x: Column) -> Column:
            own = names | {first: x, "_dot": x, "_dot_c": F.length(x.cast("string"))}
            cond = F.coalesce(evaluate(expr, own), F.lit(False))
            yes = sub(node.yes).text().col
            no = Val("S", x, value.number).text().col if node.no is None else sub(node.no).text().col
            return F.when(cond, yes).otherwise(no)

        return Val("V", F.transform(value.col, element))
    if used or names.keys() & set(re.findall(r"\w+", expr)):
        if value is not None:
            names |= {"_dot": value.col, "_dot_c": F.length(value.text().col), first: value.col}
        cond = evaluate(expr, names)
    else:
        cond = F.expr(node.cond)
    yes = sub(node.yes)
    no = value if node.no is None else sub(node.no)
    if no is None:
        raise TemplateError(f"the condition names no variable: {node.cond!r}")
    yes, no = yes.text(), no.text()
    if yes.kind != no.kind:
        yes, no = yes.vector(), no.vector()
    return Val(yes.kind, F.when(F.coalesce(cond, F.lit(False)), yes.col).otherwise(no.col))
