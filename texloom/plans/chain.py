"""Operator chains: ``'arg'op.option, 5 first, ~(sort, c), if(cond ; ops ; ops)``."""

from __future__ import annotations

import re
from dataclasses import dataclass


class ChainError(ValueError):
    pass


@dataclass(frozen=True)
class OpCall:
    name: str
    arg: str | None = None
    options: tuple[str, ...] = ()
    evaluate: bool = False


@dataclass(frozen=True)
class GroupOps:
    ops: tuple


@dataclass(frozen=True)
class IfOps:
    cond: str
    yes: str
    no: str | None
    verbatim: bool


def _skip(text: str, k: int) -> int:
    """Behind the quoted or bracketed part that starts at k, or k + 1."""
    c = text[k]
    if c == "\\":
        return k + 2
    if c in "'\"`":
        e = k + 1
        while e < len(text) and text[e] != c:
            e += 2 if text[e] == "\\" else 1
        return e + 1 if e < len(text) else k + 1
    if c == "(":
        e = k + 1
        while e < len(text) and text[e] != ")":
            e = _skip(text, e)
        if e >= len(text):
            raise ChainError(f"a parenthesis isn't closed: {text[k:]!r}")
        return e + 1
    return k + 1


def split_outside(text: str, sign: str) -> list[str]:
    """Parts between signs that stand outside quotes and parentheses."""
    out, at, k = [], 0, 0
    while k < len(text):
        if text[k] == sign:
            out.append(text[at:k])
            at = k = k + 1
        else:
            k = _skip(text, k)
    return [*out, text[at:]]


_CALL = re.compile(r"(~|if|vif)\s*\((.*)\)$", re.S)
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*$")


def _part(text: str) -> str:
    """A part of a conditional: one decorative space on each side goes; an escaped semicolon is a plain one."""
    return text.strip().replace("\\;", ";")


def parse_op(token: str):
    token = token.strip()
    m = _CALL.match(token)
    if m and m[1] == "~":
        return GroupOps(tuple(parse_chain(m[2])))
    if m:
        parts = split_outside(m[2], ";")
        if not 2 <= len(parts) <= 3:
            raise ChainError(f"{m[1]}() takes a condition and one or two branches: {token!r}")
        return IfOps(parts[0].strip(), _part(parts[1]), _part(parts[2]) if len(parts) == 3 else None, m[1] == "vif")
    if token.startswith("%"):
        return OpCall("%", token[1:])
    if token[:1] in ("'", '"', "`"):
        q, e = token[0], 1
        while e < len(token) and token[e] != q:
            e += 2 if token[e] == "\\" else 1
        if e >= len(token):
            raise ChainError(f"a quote isn't closed: {token!r}")
        arg, rest, evaluate = token[1:e].replace("\\" + q, q), token[e + 1 :].strip(), False
        if q == "`":
            evaluate = not arg.startswith("!")
            arg = arg.removeprefix("!")
    else:
        m = re.match(r"(-?\d+)(?=[A-Za-z])", token)
        if m and _NAME.match(token[m.end() :]):
            arg, rest, evaluate = m[1], token[m.end() :], False
        elif re.search(r"\s", token):
            arg, rest = token.rsplit(None, 1)
            arg, evaluate = arg.rstrip(), False
        else:
            arg, rest, evaluate = None, token, False
    if not _NAME.match(rest):
        raise ChainError(f"this isn't an operator: {token!r}")
    name, *options = rest.split(".")
    return OpCall(name, arg, tuple(options), evaluate)


def parse_chain(text: str) -> list:
    return [parse_op(t) for t in split_outside(text, ",") if t.strip()]


def match_name(given: str, names: list[str] | tuple[str, ...], what: str, ignore_case: bool = False) -> str:
    """The name that ``given`` is, or is the only beginning of."""
    if given in names:
        return given
    fold = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    found = [n for n in names if n.startswith(given)] or [n for n in names if fold(n) == fold(given)] or [n for n in names if fold(n).startswith(fold(given))]
    if len(found) == 1:
        return found[0]
    import difflib

    near = difflib.get_close_matches(given, names, 3, 0.4) or found
    raise ChainError(f"unknown {what} {given!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


def split_bar(arg: str) -> tuple[str, str | None, bool]:
    """value, extra and whether two bars stood between them, at the first unescaped bar."""
    k = 0
    while k < len(arg):
        if arg[k] == "\\":
            k += 2
        elif arg[k] == "|":
            double = arg[k + 1 : k + 2] == "|"
            return arg[:k].replace("\\|", "|"), arg[k + 1 + double :].replace("\\|", "|"), double
        else:
            k += 1
    return arg.replace("\\|", "|"), None, False
