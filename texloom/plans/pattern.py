"""The pattern language: ``flags/ p1 & !p2 | p3``.

Flags come before the first unescaped slash; ``\\/`` in its place means there are
none. `` & `` and `` | `` combine from left to right without precedence, a leading
``!`` negates; ``\\&``, ``\\|`` and ``\\!`` stand for themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FLAGS = ("ignore", "fixed", "word", "magic", "total", "single")
SPLIT_WORDS = re.compile(r",[ \t\n]+")


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class PatternSpec:
    patterns: tuple[str, ...]
    is_or: tuple[bool, ...]
    is_not: tuple[bool, ...]
    flags: frozenset[str] = field(default_factory=frozenset)


def _flag_names(block: str, allowed: tuple[str, ...]) -> frozenset[str]:
    names = [x.strip() for x in block.split(",")]
    out = set()
    for name in names:
        full = [f for f in allowed if f.startswith(name)]
        if len(full) == 1:
            out.add(full[0])
        elif all(any(f[0] == c for f in allowed) for c in name):  # glued initials
            out |= {f for c in name for f in allowed if f[0] == c}
        else:
            raise PatternError(f"unknown flag {name!r}; flags are {', '.join(allowed)}")
    return frozenset(out)


def split_flags(text: str, allowed: tuple[str, ...] = FLAGS) -> tuple[frozenset[str], str]:
    slash = text.find("/")
    if slash < 0:
        return frozenset(), text
    before = text[:slash]
    if before.endswith("\\"):
        return frozenset(), before.rstrip("\\") + text[slash:]
    if len(before) > 100 or not re.fullmatch(r"[a-z]+(\s*,\s*[a-z]+)*", before):
        raise PatternError(f"before the first slash must be flags, or the slash must be escaped: {text!r}")
    return _flag_names(before, allowed), text[slash + 1 :]


def parse_pattern(text: str, *, allowed: tuple[str, ...] = FLAGS, parse_flags: bool = True, parse_logic: bool = True, extra: frozenset[str] | set[str] = frozenset()) -> PatternSpec:
    flags, body = split_flags(text, allowed) if parse_flags else (frozenset(), text)
    parts, ors = [body], [False]
    if parse_logic:
        pieces = re.split(r"( (?<!\\)[&|] )", body)
        parts, ors = [pieces[0]], [False]
        for sign, part in zip(pieces[1::2], pieces[2::2], strict=True):
            if parts[-1].endswith("\\"):
                parts[-1] = parts[-1][:-1] + sign + part
            else:
                parts.append(part)
                ors.append("|" in sign)
    nots = []
    for k, part in enumerate(parts):
        negative = parse_logic and part.startswith("!")
        part = part[1:] if negative else part
        if parse_logic:
            part = re.sub(r"^\\!", "!", part)
            part = re.sub(r" \\([&|]) ", r" \1 ", part)
        parts[k] = part
        nots.append(negative)
    return PatternSpec(tuple(parts), tuple(ors), tuple(nots), frozenset(flags) | frozenset(extra))
