"""Patterns and replacements in the form that the JVM's regular expressions take."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from texloom.plans.pattern import SPLIT_WORDS, PatternError, PatternSpec

#: POSIX classes and what the JVM calls them.
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "blank": r"[ \t]", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "word": r"\w"}
#: Word boundary by ASCII words.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def to_java(pattern: str) -> str:
    """A Perl-style pattern for the JVM: POSIX classes by name, boundaries by ASCII words."""
    if "(*UCP)" in pattern or re.search(r"(?<!\\)(?:\\\\)*\\K", pattern):
        raise PatternError(f"(*UCP) and \\K aren't supported: {pattern!r}")
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(BOUNDARY if pattern[k + 1] == "b" and not inside else pattern[k : k + 2])
            k += 2
            continue
        if inside:
            m = re.match(r"\[:(\^?)(\w+):\]", pattern[k:])
            if m:
                if m[2] not in POSIX:
                    raise PatternError(f"unknown class [:{m[2]}:]")
                own = POSIX[m[2]]
                out.append(f"[^{own}]" if m[1] else own)
                k += m.end()
                continue
            if c == "]":
                inside = False
            elif c in "[&":
                c = "\\" + c
        elif c == "[":
            inside = True
            m = re.match(r"\[\^?\]?", pattern[k:])
            own = m[0]
            out.append(own[:-1] + "\\]" if own.endswith("]") else own)
            k += m.end()
            continue
        out.append(c)
        k += 1
    return "".join(out)


def quote(text: str) -> str:
    return "".join("\\" + c if _META.match(c) else c for c in text)


def java_regex(pattern: str, flags: frozenset[str]) -> str:
    """One sub-pattern with its flags as a JVM regular expression."""
    fixed = "fixed" in flags
    if "word" in flags:
        words = [quote(w) if fixed else to_java(w) for w in SPLIT_WORDS.split(pattern)]
        body = f"{BOUNDARY}(?:{'|'.join(words)}){BOUNDARY}" if fixed else f"{BOUNDARY}({'|'.join(words)}){BOUNDARY}"
    else:
        body = quote(pattern) if fixed else to_java(pattern)
    return ("(?iu)" if "ignore" in flags else "") + body


def java_replacement(text: str) -> str:
    r"""A replacement with \1 as groups: $1 for the JVM; other signs stand for themselves."""
    out, k = [], 0
    while k < len(text):
        if text[k] == "\\" and text[k + 1 : k + 2].isdigit():
            out.append("$" + text[k + 1])
            k += 2
        else:
            out.append("\\" + text[k] if text[k] in "\\$" else text[k])
            k += 1
    return "".join(out)


def _one(col: Column, pattern: str, flags: frozenset[str]) -> Column:
    if not flags & {"ignore", "word"}:
        if "fixed" in flags:
            return col.contains(pattern)
        literal = pattern.removeprefix("^")
        if literal and not _META.search(literal):  # plain text needs no regular expression, and a prefix reaches the scan
            return col.startswith(literal) if pattern.startswith("^") else col.contains(literal)
    return col.rlike(java_regex(pattern, flags))


def matches_spec(col: Column, spec: PatternSpec, for_filter: bool = False) -> Column:
    """Whether a string matches; a null matches nothing, so its negation holds.

    A filter drops nulls by itself; ``for_filter`` leaves them as they are where
    nothing is negated, so that prefixes reach the scan.
    """
    keep_null = for_filter and not any(spec.is_not)
    out = None
    for pattern, is_or, is_not in zip(spec.patterns, spec.is_or, spec.is_not, strict=True):
        own = _one(col, pattern, spec.flags)
        own = own if keep_null else F.coalesce(own, F.lit(False))
        own = ~own if is_not else own
        out = own if out is None else (out | own) if is_or else (out & own)
    return out


def replace_all(col: Column, pattern: str, replacement: str, flags: frozenset[str]) -> Column:
    if "single" in flags:
        return replace_first(col, pattern, replacement, flags)
    if "fixed" in flags and not flags & {"ignore", "word"}:
        return F.replace(col, F.lit(pattern), F.lit(replacement))
    repl = replacement if "fixed" not in flags else replacement.replace("\\", "\\\\")
    return F.regexp_replace(col, F.lit(java_regex(pattern, flags)), F.lit(java_replacement(repl)))


def replace_first(col: Column, pattern: str, replacement: str, flags: frozenset[str]) -> Column:
    """The first match alone: what comes before it is captured, and groups are numbered on."""
    shifted = re.sub(r"\\(\d)", lambda m: "\\" + str(int(m[1]) + 1), java_regex(pattern, flags - {"ignore"}))
    prefix = "(?isu)" if "ignore" in flags else "(?s)"
    repl = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}", java_replacement(replacement))
    # "." must not cross lines in the pattern itself
    body = f"(?-s:{shifted})"
    return F.regexp_replace(col, F.lit(rf"{prefix}\A(.*?){body}"), F.lit("$1" + repl))
