"""Templates: text with boxes. ``{ops ? expression}``, ``{ops ! text}``, ``{& cond ; yes ; no}``, ``{#s ? n}``, ``{/a, b}``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .chain import ChainError, _skip, parse_chain


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Box:
    ops: str
    body: str
    verbatim: bool = False


@dataclass(frozen=True)
class Slash:
    items: tuple[str, ...]


@dataclass(frozen=True)
class Choice:
    cond: str
    yes: str
    no: str | None
    damp: bool


@dataclass(frozen=True)
class Plural:
    ops: tuple[str, ...]
    body: str | None
    by_value: bool


def _closing(text: str, k: int, a: str, b: str) -> int:
    depth = 0
    while k < len(text):
        if text[k] == "\\" and text[k + 1 : k + 1 + len(a)] in (a, b):
            k += 1 + len(a)
        elif text.startswith(a, k):
            depth, k = depth + 1, k + len(a)
        elif text.startswith(b, k):
            depth -= 1
            if depth == 0:
                return k
            k += len(b)
        else:
            k += 1
    return -1


def split_parts(text: str, sign: str, a: str, b: str) -> list[str]:
    """Parts between signs outside nested boxes, quotes and parentheses."""
    out, at, k = [], 0, 0
    while k < len(text):
        if text.startswith(a, k):
            e = _closing(text, k, a, b)
            k = len(text) if e < 0 else e + len(b)
        elif text[k] == sign:
            out.append(text[at:k])
            at = k = k + 1
        elif text[k] in "\\(" or text[k] in "'\"" and text.find(text[k], k + 1) > 0 and not text[k - 1 : k].isalnum():
            k = _skip(text, k)
        else:
            k += 1
    return [*out, text[at:]]


def _is_chain(text: str) -> bool:
    try:
        return bool(parse_chain(text))
    except ChainError:
        return False


def parse_box(content: str, a: str, b: str):
    if content.startswith("/"):
        return Slash(tuple(re.split(r",[ \t\n]*", content[1:].strip())))
    if content.startswith("&"):
        damp = content.startswith("&&")
        parts = [p.strip().replace("\\;", ";") for p in split_parts(content[1 + damp :], ";", a, b)]
        if not 2 <= len(parts) <= (2 if damp else 3):
            raise TemplateError(f"a conditional box has a condition and {'one branch' if damp else 'one or two branches'}: {content!r}")
        return Choice(parts[0], parts[1], parts[2] if len(parts) == 3 else None if damp else "", damp)
    if content[:1] in ("$", "#"):
        parts = split_parts(content[1:], "?", a, b)
        ops = tuple(x.strip() for x in split_parts(parts[0], ",", a, b) if x.strip())
        return Plural(ops, "?".join(parts[1:]).strip() if len(parts) > 1 else None, content[0] == "#")
    k = 0
    while k < len(content):
        c = content[k]
        if c in "?!" and not (c == "!" and content[k + 1 : k + 2] == "="):
            left = content[:k]
            if not left.strip() or _is_chain(left):
                body = content[k + 1 :]
                if c == "!":
                    return Box(left.strip(), re.sub(r"^ | $", "", body), True)
                return Box(left.strip(), body.strip())
        try:
            k = _skip(content, k)
        except ChainError:
            k += 1
    return Box("", content.strip())


def parse_template(text: str, delim: tuple[str, str] = ("{", "}")) -> list:
    a, b = delim
    if not a or not b or a == b or re.search(r"[();?! ]", a + b):
        raise TemplateError(f"bad delimiters {a!r} and {b!r}")
    out, plain, k = [], "", 0
    while k < len(text):
        if text[k] == "\\" and text.startswith(a, k + 1):
            plain, k = plain + a, k + 1 + len(a)
        elif text.startswith(a, k):
            e = _closing(text, k, a, b)
            if e < 0:
                raise TemplateError(f"a box isn't closed: {text[k : k + 40]!r}\n{' ' * 22}^")
            if plain:
                out.append(Text(plain))
                plain = ""
            out.append(parse_box(text[k + len(a) : e].replace("\\" + b, b), a, b))
            k = e + len(b)
        else:
            plain, k = plain + text[k], k + 1
    return [*out, Text(plain)] if plain or not out else out


_WORD = re.compile(r"[A-Za-z_]\w*")


def expressions(text: str, delim: tuple[str, str] = ("{", "}")) -> list[str]:
    """Expressions of a template, in order."""
    out: list[str] = []
    for node in parse_template(text, delim):
        if isinstance(node, Box):
            out += expressions(node.body, delim) if node.verbatim and delim[0] in node.body else [] if node.verbatim else [node.body]
        elif isinstance(node, Choice):
            out += [node.cond, *expressions(node.yes, delim), *(expressions(node.no, delim) if node.no else [])]
        elif isinstance(node, Plural) and node.body:
            out.append(node.body)
    return out


def variables(text: str, delim: tuple[str, str] = ("{", "}")) -> list[str]:
    """Names in those expressions, each once; functions and keywords aren't names."""
    found: dict[str, None] = {}
    for e in expressions(text, delim):
        bare = re.sub(r"'[^']*'|\"[^\"]*\"", "", e)
        for m in _WORD.finditer(bare):
            if not bare[m.end() :].lstrip().startswith("(") and m[0].lower() not in ("and", "or", "not", "is", "null", "true", "false", "in", "like", "rlike", "case", "when", "then", "else", "end"):
                found[m[0]] = None
    return list(found)
