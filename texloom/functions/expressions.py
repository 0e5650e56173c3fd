"""Small expressions over given names, as Columns: arithmetic, comparisons, logic and Spark's functions."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, functions as F

_BIN = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.Pow: operator.pow}
_CMP = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_NAMES = {"nchar": "length", "toupper": "upper", "tolower": "lower", "substr": "substring"}


class ExpressionError(ValueError):
    pass


def evaluate(text: str, names: dict[str, Column]) -> Column:
    """names: what the expression may use; any other name is a column."""

    def run(n: ast.AST):
        if isinstance(n, ast.Expression):
            return run(n.body)
        if isinstance(n, ast.Constant):
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            return names[n.id] if n.id in names else F.lit(n.id == "TRUE") if n.id in ("TRUE", "FALSE") else F.col(n.id)
        if isinstance(n, ast.BinOp):
            if isinstance(n.op, ast.FloorDiv):
                return F.floor(run(n.left) / run(n.right))
            return _BIN[type(n.op)](run(n.left), run(n.right))
        if isinstance(n, ast.UnaryOp):
            return ~run(n.operand) if isinstance(n.op, ast.Not | ast.Invert) else -run(n.operand)
        if isinstance(n, ast.BoolOp):
            out = run(n.values[0])
            for v in n.values[1:]:
                out = out & run(v) if isinstance(n.op, ast.And) else out | run(v)
            return out
        if isinstance(n, ast.Compare):
            left, out = run(n.left), None
            for o, right in zip(n.ops, n.comparators, strict=True):
                r = run(right)
                if isinstance(o, ast.In):
                    own = left.isin([ast.literal_eval(x) for x in right.elts])
                else:
                    own = _CMP[type(o)](left, r)
                out, left = own if out is None else out & own, r
            return out
        if isinstance(n, ast.Tuple | ast.List):
            return F.array(*(run(x) for x in n.elts))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
            f = getattr(F, _NAMES.get(n.func.id, n.func.id), None)
            if f is not None:
                return f(*(x.value if isinstance(x, ast.Constant) and k else run(x) for k, x in enumerate(n.args)))
        raise ExpressionError(f"can't be used here: {ast.unparse(n)}")

    try:
        return run(ast.parse(text.replace("&&", " and ").replace("||", " or ").replace("!=", "\0").replace("!", " not ").replace("\0", "!=").strip(), mode="eval"))
    except SyntaxError as error:
        raise ExpressionError(f"not an expression: {text!r}") from error
