"""Row mode: an operator chain compiled to one Column.

A value is a scalar (S), an array (V) or an array of arrays (G: what split and
extract make of each element). Class E operators work on each element; the
others on the whole array. ``~( )`` works inside each inner array.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

from texloom.functions import letters as L, numbers as N, regexes as R
from texloom.functions.letters import upper_first
from texloom.plans.chain import ChainError, GroupOps, IfOps, OpCall, match_name, parse_chain, split_bar
from texloom.plans.pattern import SPLIT_WORDS, parse_pattern

#: The Snowball list of English stopwords.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing would should could ought "
    "i'm you're he's she's it's we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll "
    "isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't "
    "let's that's who's what's here's there's when's where's why's how's a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very"
).split()


@dataclass(frozen=True)
class Val:
    kind: str  # S, V or G
    col: Column
    number: bool = False  # a double rather than a string
    boolean: bool = False
    grouped: bool = False  # inside ~( )

    def each(self, f: Callable[[Column], Column], **change) -> Val:
        if self.kind == "S":
            col = f(self.col)
        elif self.kind == "V":
            col = F.transform(self.col, f)
        else:
            col = F.transform(self.col, lambda g: F.transform(g, f))
        return replace(self, **{"number": False, "boolean": False, **change}, col=col)

    def text(self) -> Val:
        if self.number:
            return self.each(N.plain)
        return self.each(lambda x: x.cast("string")) if self.boolean else self

    def vector(self) -> Val:
        """As one array; groups are given up."""
        if self.kind == "S":
            return replace(self, kind="V", col=F.array(self.col))
        return self if self.kind == "V" else replace(self, kind="V", col=F.flatten(self.col))


@dataclass(frozen=True)
class Op:
    name: str
    run: Callable[[Engine, Val, str | None, set[str]], Val]
    default: str | None = None
    options: tuple[str, ...] = ()
    needs: bool = False
    in_groups: bool = True


BUILTIN: dict[str, Op] = {}


def op(*names: str, default: str | None = None, options: str = "", needs: bool = False, in_groups: bool = True):
    def add(f):
        for n in names:
            BUILTIN[n] = Op(n, f, default, tuple(options.split()), needs, in_groups)
        return f

    return add


#: Operators whose argument is a pattern.
_PATTERNED = frozenset("s S split x X extract r R replace clean get is which erase rm".split())


class Engine:
    """A registry of operators and the values that arguments in backticks may name."""

    def __init__(self, vars: dict | None = None, user_ops: dict[str, Op] | None = None) -> None:
        self.vars, self.user_ops = dict(vars or {}), dict(user_ops or {})

    def register_fun(self, alias: str, fun: Callable, options: tuple[str, ...] = ()) -> None:
        """fun(column, argument, options) -> Column, applied to each element. It is tried on a literal at once."""
        if alias in BUILTIN:
            raise ChainError(f"{alias!r} is built in")
        if not isinstance(fun(F.lit("x"), None, set()), Column):
            raise ChainError("a registered function returns a Column")
        self.user_ops[alias] = Op(alias, lambda e, v, arg, opts: v.text().each(lambda x: fun(x, arg, opts)), None, options)

    def register_ops(self, alias: str, chain: str) -> None:
        """A chain under a name of its own."""
        if alias in BUILTIN:
            raise ChainError(f"{alias!r} is built in")
        parse_chain(chain)
        self.user_ops[alias] = Op(alias, lambda e, v, arg, opts: e.chain(v, chain))

    def evaluate(self, call: OpCall) -> str | None:
        if not call.evaluate:
            return call.arg
        if call.arg not in self.vars:
            raise ChainError(f"no variable {call.arg!r}")
        return str(self.vars[call.arg])

    def find(self, call: OpCall) -> tuple[Op, OpCall]:
        name = call.name
        m = re.fullmatch(r"([rs])([0-6])", name)
        if m:
            return BUILTIN["round" if m[1] == "r" else "signif"], replace(call, arg=call.arg, options=(*call.options, f"#{m[2]}"))
        if name in ("Ko", "KO"):
            return BUILTIN["K"], replace(call, name="K", arg=f"{call.arg or ''}||:{'rest' if name == 'Ko' else 'REST'}: others")
        if name in self.user_ops:
            return self.user_ops[name], call
        return (self.user_ops | BUILTIN)[match_name(name, [*self.user_ops, *BUILTIN], "operator")], call

    def chain(self, v: Val, chain) -> Val:
        for step in parse_chain(chain) if isinstance(chain, str) else chain:
            v = self.step(v, step)
        return v

    def step(self, v: Val, step) -> Val:
        if isinstance(step, GroupOps):
            return self._groups(v, step)
        if isinstance(step, IfOps):
            from texloom.operators.conditions import if_ops

            return if_ops(self, v, step)
        spec, call = self.find(step)
        arg = self.evaluate(call)
        if arg is None:
            arg = spec.default
        elif spec.name in _PATTERNED and "/" in arg:
            from texloom.operators.magic import expand

            arg = expand(arg, self.vars, self)
        if arg is None and spec.needs:
            raise ChainError(f"{spec.name!r} needs an argument")
        if v.grouped and not spec.in_groups:
            raise ChainError(f"{spec.name!r} can't be used inside ~( )")
        options = {o if o.startswith("#") or re.fullmatch(r"[rs]?\d+", o) else match_name(o, spec.options, f"option of {spec.name}", True) for o in call.options}
        return spec.run(self, v, arg, options)

    def _groups(self, v: Val, step: GroupOps) -> Val:
        if v.kind != "G":  # one group
            inner = self.chain(replace(v.vector(), grouped=True), step.ops)
            return replace(inner, grouped=False)
        seen: list[Val] = []

        def run(g: Column) -> Column:
            seen.append(self.chain(Val("V", g, v.number, v.boolean, True), step.ops))
            return seen[-1].col

        col = F.transform(v.col, run)
        last = seen[-1]
        return Val({"S": "V", "V": "G"}[last.kind], col, last.number, last.boolean)


# split, extract, replace, detect


def _spec(arg: str, opts: set[str]):
    return parse_pattern(arg, extra=frozenset(opts & {"ignore", "fixed", "word"}))


def split_text(x: Column, arg: str, opts: set[str] = frozenset(), keep_empty: bool = True) -> Column:
    """Pieces of a string; one empty piece at the end is dropped. An empty string stays one piece, or has none."""
    spec = parse_pattern(arg, parse_logic=False, extra=frozenset(opts))
    regex = R.java_regex(spec.patterns[0], spec.flags)
    parts = F.split(x, regex if spec.patterns[0] else "")
    parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(x == "", F.array(F.lit("")) if keep_empty else F.array().cast("array<string>")).otherwise(parts)


def _expand(v: Val, f: Callable[[Column], Column]) -> Val:
    v = v.text()
    if v.kind == "G":
        v = v.vector()
    return replace(v, kind="V", col=f(v.col)) if v.kind == "S" else replace(v, kind="G", col=F.transform(v.col, f))


@op("s", "split", default=" ", options="word ignore fixed")
def _split(e, v, arg, opts):
    return _expand(v, lambda x: split_text(x, arg, opts))


BUILTIN["S"] = BUILTIN["Split"] = replace(BUILTIN["s"], name="S", default=",[ \t\n]*")


def extract_all(x: Column, arg: str, opts: set[str]) -> Column:
    spec = parse_pattern(arg, parse_logic=False, extra=frozenset(opts))
    return F.regexp_extract_all(x, F.lit(R.java_regex(spec.patterns[0], spec.flags)), F.lit(0))


def extract_first(x: Column, arg: str, opts: set[str]) -> Column:
    spec = parse_pattern(arg, parse_logic=False, extra=frozenset(opts))
    return F.regexp_extract(x, R.java_regex(spec.patterns[0], spec.flags), 0)


@op("extract", "X", default="[[:alnum:]]+", options="first word ignore fixed")
def _extract(e, v, arg, opts):
    if "first" in opts:
        return v.text().each(lambda x: extract_first(x, arg, opts - {"first"}))
    return _expand(v, lambda x: extract_all(x, arg, opts))


@op("x", default="[[:alnum:]]+", options="word ignore fixed")
def _x(e, v, arg, opts):
    return v.text().each(lambda x: extract_first(x, arg, opts))


def clean_text(x: Column, arg: str, opts: set[str], comma: bool, pipe: str = "=>", engine: Engine | None = None) -> Column:
    """One item ``patterns => replacement``; with ``comma``, patterns are separated by commas."""
    left, sign, right = arg.partition(f" {pipe} ") if f" {pipe} " in arg else (arg.rpartition(f" {pipe}")[0], pipe, "") if arg.endswith(f" {pipe}") else (arg, "", "")
    flags, body = R_flags(left, opts)
    for pattern in SPLIT_WORDS.split(body) if comma and "word" not in flags else [body]:
        if "total" in flags:
            x = F.when(R.matches_spec(x, parse_pattern(pattern, parse_flags=False, extra=flags)), F.lit(right)).otherwise(x)
        else:
            x = R.replace_all(x, pattern, right, flags)
    return x


def R_flags(text: str, opts: set[str]) -> tuple[frozenset[str], str]:
    from texloom.plans.pattern import split_flags

    flags, body = split_flags(text)
    return frozenset(flags | frozenset(opts)), body


@op("r", "R", "replace", options="word ignore fixed total single", needs=True)
def _replace(e, v, arg, opts):
    return v.text().each(lambda x: clean_text(x, arg, opts, False))


@op("clean", options="word ignore fixed total single", needs=True)
def _clean(e, v, arg, opts):
    return v.text().each(lambda x: clean_text(x, arg, opts, True))


def _predicate(arg: str, opts: set[str]) -> Callable[[Column], Column]:
    if "in" in opts:
        items = SPLIT_WORDS.split(arg)
        return lambda x: F.coalesce(x.isin(items), F.lit(False))
    if "equal" in opts:
        return lambda x: F.coalesce(x == arg, F.lit(False))
    spec = _spec(arg, opts)
    return lambda x: R.matches_spec(x, spec)


def _keep(v: Val, test: Callable[[Column], Column]) -> Val:
    """Elements that pass; emptied groups vanish."""
    if v.kind == "G":
        return replace(v, col=F.filter(F.transform(v.col, lambda g: F.filter(g, test)), lambda g: F.size(g) > 0))
    v = v.vector()
    return replace(v, col=F.filter(v.col, test))


@op("get", options="equal in word ignore fixed", needs=True, in_groups=False)
def _get(e, v, arg, opts):
    return _keep(v.text(), _predicate(arg, opts))


@op("is", options="equal in word ignore fixed", needs=True)
def _is(e, v, arg, opts):
    return v.text().each(_predicate(arg, opts), boolean=True)


@op("which", options="equal in word ignore fixed", in_groups=False)
def _which(e, v, arg, opts):
    if arg is None:
        test = lambda x: F.coalesce(x.cast("boolean"), F.lit(False))
    else:
        v, test = v.text(), _predicate(arg, opts)
    col = v.vector().col
    at = F.filter(F.transform(col, lambda x, i: F.when(test(x), i + 1)), lambda x: x.isNotNull())
    return Val("V", F.transform(at, lambda i: i.cast("double")), True)


@op("erase", options="word ignore fixed")
def _erase(e, v, arg, opts):
    test = _predicate(arg, opts) if arg is not None else (lambda x: F.lit(True))
    return v.text().each(lambda x: F.when(test(x), "").otherwise(x))


@op("stopwords")
def _stopwords(e, v, arg, opts):
    token = r"[\p{Alnum}](?:[\p{Alnum}']*[\p{Alnum}])?|[^\p{Alnum}]+"
    return v.text().each(lambda x: F.array_join(F.filter(F.regexp_extract_all(x, F.lit(token), F.lit(0)), lambda w: ~F.lower(w).isin(STOPWORDS)), ""))


#: Letters that stand for several ASCII letters.
_MULTI = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "TH", "…": "...", "€": "EUR"}


def _ascii_table() -> tuple[str, str]:
    import unicodedata

    source, target = "", ""
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0xA0]:
        c = chr(code)
        base = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\xa0": " ", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L"}.get(c) or unicodedata.normalize("NFD", c)[0]
        if ord(base) < 128:
            source, target = source + c, target + base
    return source, target


@op("ascii", options="silent utf8")
def _ascii(e, v, arg, opts):
    source, target = _ascii_table()

    def fold(x: Column) -> Column:
        for c, to in _MULTI.items():
            x = F.replace(x, F.lit(c), F.lit(to))
        x = F.regexp_replace(F.translate(x, source, target), r"\p{M}+", "")
        return x if "utf8" in opts else F.regexp_replace(x, r"[^\x00-\x7F]", "?")

    return v.text().each(fold)


# collapse, enumerate, count


def collapse(col: Column, sep: str, last: str | None) -> Column:
    joined = F.array_join(col, sep, "NA")
    if last is None:
        return joined
    n = F.size(col)
    head = F.array_join(F.slice(col, 1, F.greatest(n - 1, F.lit(0))), sep, "NA")
    return F.when(n <= 1, joined).otherwise(F.concat(head, F.lit(last), F.coalesce(F.try_element_at(col, F.lit(-1)), F.lit("NA"))))


@op("c", "collapse", default=" ")
def _collapse(e, v, arg, opts):
    sep, last, _ = split_bar(arg)
    v = v.text().vector()
    return Val("S", collapse(v.col, sep, last), grouped=v.grouped)


BUILTIN["C"] = BUILTIN["Collapse"] = replace(BUILTIN["c"], name="C", default=", | and ")

_QUOTES = {"q": "'", "Q": '"', "bq": "`"}


def number_mark(style: str, i: Column) -> Column:
    """The mark of the i-th item (from 0): roman, letters or digits."""
    n = i + 1
    if style in "iI":
        out = N.roman(n.cast("double"))
        return F.lower(out) if style == "i" else out
    if style in "aA":
        first, second = F.floor((n - 1) / 26), (n - 1) % 26
        letter = lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (k + 1).cast("int"), F.lit(1))
        out = F.concat(F.when(first > 0, letter(first - 1)).otherwise(""), letter(second))
        return F.upper(out) if style == "A" else out
    return n.cast("string")


def enumeration(col: Column, opts: set[str], limit: int = 7) -> Column:
    for o in opts:
        if o.isdigit() and o != "1":
            limit = int(o)
    q = next((_QUOTES[o] for o in ("q", "Q", "bq") if o in opts), "")
    word = "nor" if "nor" in opts else "or" if "or" in opts else "and"
    style = next((o for o in ("i", "I", "a", "A", "1") if o in opts), None)
    n = F.size(col)
    over = n > limit
    quoted = F.transform(col, lambda x: F.concat(F.lit(q), F.coalesce(x, F.lit("NA")), F.lit(q)))
    kept = F.when(over, F.slice(quoted, 1, limit - 1)).otherwise(quoted)
    if style:
        kept = F.when(n > 1, F.transform(kept, lambda x, i: F.concat(number_mark(style, i), F.lit(") "), x))).otherwise(kept)
    items = F.when(over, F.concat(kept, F.array(F.concat((n - (limit - 1)).cast("string"), F.lit(" others"))))).otherwise(kept)
    oxford = style is not None or "oxford" in opts or "comma" in opts
    m = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(m - 1, F.lit(0))), ", ")
    join = F.when((m > 2) | F.lit(style is not None), f", {word} ").otherwise(f" {word} ") if oxford else F.lit(f" {word} ")
    if "comma" in opts:
        return F.array_join(items, ", ")
    return F.when(m <= 1, F.array_join(items, "")).otherwise(F.concat(head, join, F.try_element_at(items, F.lit(-1))))


@op("enum", options="q Q bq or nor i I a A oxford comma")
def _enum(e, v, arg, opts):
    v = v.text().vector()
    return Val("S", enumeration(v.col, opts), grouped=v.grouped)


def number_text(x: Column, opts: set[str], capital: bool = False) -> Column:
    letters = capital or "letter" in opts
    out = N.roman(x) if "Roman" in opts else F.lower(N.roman(x)) if "roman" in opts else N.in_words(x) if letters else N.plain(x) if "num" in opts else N.comma(x)
    return upper_first(out) if "upper" in opts else out


@op("len", options="letter upper num")
def _len(e, v, arg, opts):
    v = v.vector()
    n = F.size(v.col).cast("double")
    return Val("S", n, True, grouped=v.grouped) if "num" in opts and not opts & {"letter", "upper"} else Val("S", number_text(n, opts), grouped=v.grouped)


@op("Len", options="letter upper num")
def _Len(e, v, arg, opts):
    return _len(e, v, arg, opts | {"letter"})


def table_items(col: Column, opts: set[str]) -> Column:
    """Structs x, n, s of the different elements, in the order that the options ask for."""
    total = F.size(col)
    rows = F.transform(F.array_distinct(col), lambda x, i: F.struct(x.alias("x"), F.size(F.filter(col, lambda y: y.eqNullSafe(x))).alias("n"), i.alias("i")))
    by_n = 1 if "fsort" in opts else 0 if opts & {"sort", "dsort", "nosort"} and "dfsort" not in opts else -1
    by_x = 1 if "sort" in opts else -1 if "dsort" in opts else 0

    def order(a: Column, b: Column) -> Column:
        n = F.signum(a["n"] - b["n"]).cast("int") * by_n
        x = F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0) * by_x
        return F.when(n != 0, n).when(x != 0, x).otherwise(F.signum(a["i"] - b["i"]).cast("int"))

    if "nosort" not in opts:
        rows = F.array_sort(rows, order)
    return F.transform(rows, lambda r: F.struct(r["x"].alias("x"), r["n"].cast("double").alias("n"), (r["n"] / total).alias("s")))


@op("table", default="{x} ({n ? n})", options="sort dsort fsort dfsort nosort", in_groups=False)
def _table(e, v, arg, opts):
    from texloom.operators.templates import compile_template

    v = v.text().vector()
    used: set[str] = set()

    def line(r: Column) -> Column:
        scope = {"x": Val("S", r["x"]), "n": Val("S", r["n"], True), "s": Val("S", r["s"], True)}
        return compile_template(arg, e, scope, only_scope=True, used=used).text().col

    col = F.transform(table_items(v.col, opts), line)
    if not used:
        raise ChainError("the argument of table must interpolate x, n or s")
    return replace(v, kind="V", col=col)


# order, subset, repeat


def sort_array(v: Val, key: Callable[[Column], Column], descending: bool) -> Val:
    """Stable; nulls last either way."""
    v = v.vector()
    rows = F.transform(v.col, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    sign = -1 if descending else 1

    def order(a: Column, b: Column) -> Column:
        by = F.when(a["k"].isNull() & b["k"].isNull(), 0).when(a["k"].isNull(), 1).when(b["k"].isNull(), -1).when(a["k"] < b["k"], -sign).when(a["k"] > b["k"], sign).otherwise(0)
        return F.when(by != 0, by).otherwise(F.signum(a["i"] - b["i"]).cast("int"))

    return replace(v, col=F.transform(F.array_sort(rows, order), lambda r: r["x"]))


def _sort(descending: bool):
    def run(e, v, arg, opts):
        key = (lambda x: x) if arg is None else (lambda x: clean_text(x, arg, set(), True))
        if "num" in opts:
            inner = key
            key = lambda x: N.as_number(inner(x))
        return sort_array(v, key, descending)

    return run


op("sort", options="num")(_sort(False))
op("dsort", options="num")(_sort(True))


@op("rev")
def _rev(e, v, arg, opts):
    if v.kind == "G":
        return replace(v, col=F.reverse(F.transform(v.col, F.reverse)))
    v = v.vector()
    return replace(v, col=F.reverse(v.col))


def head(col: Column, n: int) -> Column:
    return F.slice(col, 1, n) if n >= 0 else F.slice(col, -n + 1, F.greatest(F.size(col) + n, F.lit(0)))


def tail(col: Column, n: int) -> Column:
    size = F.size(col)
    if n >= 0:
        return F.slice(col, F.greatest(F.lit(1), size - n + 1), n)
    return F.slice(col, 1, F.greatest(size + n, F.lit(0)))


def _count(arg: str | None, opts: set[str]) -> int:
    given = next((o for o in opts if re.fullmatch(r"\d+", o)), None)
    return int(given if given is not None else arg or 1)


@op("first")
def _first(e, v, arg, opts):
    a, b, _ = split_bar(arg or "")
    v = v.vector()
    if b is not None:
        n, m = int(a), int(b)
        if n < 0 or m < 0:
            raise ChainError("both numbers of first must be positive")
        whole = F.size(v.col) <= n + m
        return replace(v, col=F.when(whole, v.col).otherwise(F.concat(head(v.col, n), tail(v.col, m))))
    return replace(v, col=head(v.col, _count(arg, opts)))


@op("last")
def _last(e, v, arg, opts):
    v = v.vector()
    return replace(v, col=tail(v.col, _count(arg, opts)))


@op("K", needs=True, in_groups=False)
def _K(e, v, arg, opts):
    value, extra, double = split_bar(arg)
    n = int(value)
    v = v.text().vector()
    size, kept = F.size(v.col), n - (1 if double else 0)
    items = head(v.col, kept)
    if extra is not None:
        rest = (size - kept).cast("double")
        message = F.lit(extra)
        for mark, num in ((":rest:", rest), (":n:", size.cast("double"))):
            message = F.replace(message, F.lit(mark), N.comma(num))
            message = F.replace(message, F.lit(mark.upper()), N.in_words(num))
        items = F.concat(items, F.array(message))
    return replace(v, col=F.when(size > n, items).otherwise(v.col))


@op("head", default="6")
def _head(e, v, arg, opts):
    v = v.vector()
    return replace(v, col=head(v.col, int(arg)))


@op("unik")
def _unik(e, v, arg, opts):
    v = v.vector()
    return replace(v, col=F.array_distinct(v.col))


@op("rm", options="empty blank noalpha noalnum all word ignore fixed")
def _rm(e, v, arg, opts):
    v = v.text()
    if "all" in opts:
        return _nuke(e, v, arg, opts)
    tests = []
    if arg is not None:
        tests.append(_predicate(arg, opts))
    if "blank" in opts:
        tests.append(lambda x: F.trim(F.translate(x, "\t\n\r", "   ")) == "")
    if "noalpha" in opts:
        tests.append(lambda x: ~x.rlike(r"\p{L}"))
    if "noalnum" in opts:
        tests.append(lambda x: ~x.rlike(r"[\p{L}\p{N}]"))
    if "empty" in opts or not tests:
        tests.append(lambda x: x == "")

    def keep(x: Column) -> Column:
        gone = F.lit(False)
        for t in tests:
            gone = gone | F.coalesce(t(x), F.lit(False))
        return ~gone

    return _keep(v, keep)


@op("nuke")
def _nuke(e, v, arg, opts):
    v = v.vector()
    return replace(v, col=F.slice(v.col, 1, 0))


@op("insert", options="left right both", needs=True, in_groups=False)
def _insert(e, v, arg, opts):
    left, right, _ = split_bar(arg)
    v = v.text().vector()
    if right is None:
        left, right = (left, left) if "both" in opts else (None, left) if "right" in opts else (left, None)
    parts = [F.array(F.lit(x)) if isinstance(x, str) else x for x in (left, v.col, right) if x is not None and not (isinstance(x, str) and x == "")]
    return replace(v, col=F.concat(*parts) if len(parts) > 1 else parts[0])


@op("each", options="c", needs=True)
def _each(e, v, arg, opts):
    v = v.vector()
    col = F.flatten(F.transform(v.col, lambda x: F.array_repeat(x, int(arg))))
    return Val("S", F.array_join(col, "", "NA"), grouped=v.grouped) if "c" in opts else replace(v, col=col)


@op("times", options="c", needs=True)
def _times(e, v, arg, opts):
    v = v.vector()
    col = F.flatten(F.array_repeat(v.col, int(arg)))
    return Val("S", F.array_join(col, "", "NA"), grouped=v.grouped) if "c" in opts else replace(v, col=col)


@op("num", options="warn soft rm clear")
def _num(e, v, arg, opts):
    if v.number:
        return v
    v = v.text()
    if "clear" in opts:
        return v.each(lambda x: F.coalesce(N.plain(N.as_number(x)), F.lit("")))
    if "soft" in opts:
        if v.kind == "S":
            return v.each(lambda x: F.coalesce(N.plain(N.as_number(x)), x))
        v = v.vector()
        return replace(v, col=F.when(F.forall(v.col, lambda x: N.as_number(x).isNotNull()), F.transform(v.col, lambda x: N.plain(N.as_number(x)))).otherwise(v.col))
    out = v.each(N.as_number, number=True)
    return _keep(out, lambda x: x.isNotNull()) if "rm" in opts else out


# case, quotes, white space, parts of strings


@op("upper", options="first sentence")
def _upper(e, v, arg, opts):
    if "first" in opts:
        return v.text().each(upper_first)
    if "sentence" in opts:
        return v.text().each(L.upper_sentences)
    return v.text().each(L.upper)


@op("lower")
def _lower(e, v, arg, opts):
    return v.text().each(L.lower)


#: Words that title.ignore leaves in lower case.
_SMALL = "a the in on at of for to".split()


@op("title", options="force ignore")
def _title(e, v, arg, opts):
    def run(x: Column) -> Column:
        x = L.lower(x) if "force" in opts else x
        pieces = F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
        if "ignore" not in opts:
            return F.array_join(F.transform(pieces, L.capital), "")

        def up(p: Column, i: Column) -> Column:
            before = F.coalesce(F.get(pieces, i - 1), F.lit(":"))
            return F.when(p.isin(_SMALL) & ~before.rlike(r"[:!?.]\s*$") & (i > 0), p).otherwise(L.capital(p))

        return F.array_join(F.transform(pieces, up), "")

    return v.text().each(run)


def _wrap(sign: str):
    return lambda e, v, arg, opts: v.text().each(lambda x: F.concat(F.lit(sign), x, F.lit(sign)))


for _name, _sign in _QUOTES.items():
    op(_name)(_wrap(_sign))


@op("ws", options="punct digit isolated")
def _ws(e, v, arg, opts):
    gone = r" \t\n" + (r"\p{Punct}" if "punct" in opts else "") + (r"0-9" if "digit" in opts else "")

    def run(x: Column) -> Column:
        x = F.trim(F.regexp_replace(x, f"[{gone}]+", " "))
        return F.array_join(F.filter(F.split(x, " "), lambda w: F.octet_length(w) > 1), " ") if "isolated" in opts else x

    return v.text().each(run)


@op("tws")
def _tws(e, v, arg, opts):
    return v.text().each(lambda x: F.regexp_replace(x, r"^[ \t\n]+|[ \t\n]+\z", ""))


def drop_chars(x: Column, left: int, right: int = 0) -> Column:
    return F.substring(x, F.lit(left + 1), F.greatest(F.length(x) - left - right, F.lit(0)))


@op("trim", options="left right both", needs=True)
def _trim(e, v, arg, opts):
    n = int(arg)
    right = "right" in opts or n < 0
    n = abs(n)
    return v.text().each(lambda x: drop_chars(x, n, n) if "both" in opts else drop_chars(x, 0, n) if right else drop_chars(x, n))


@op("firstchar", default="1")
def _firstchar(e, v, arg, opts):
    n = int(arg)
    return v.text().each(lambda x: F.substring(x, 1, n) if n >= 0 else drop_chars(x, -n))


@op("lastchar", default="1")
def _lastchar(e, v, arg, opts):
    n = int(arg)
    return v.text().each(lambda x: F.right(x, F.lit(n)) if n >= 0 else drop_chars(x, 0, -n))


@op("k", "shorten", options="include dots", needs=True)
def _shorten(e, v, arg, opts):
    value, extra, double = split_bar(arg)
    n, extra = int(value), extra or ""
    if "dots" in opts:
        return v.text().each(lambda x: F.when(F.length(x) > n + 1, F.concat(F.substring(x, 1, n - 1), F.lit(".."))).otherwise(x))
    keep = n - len(extra) if double or "include" in opts else n
    return v.text().each(lambda x: F.when(F.length(x) > n, F.concat(F.substring(x, 1, max(0, keep)), F.lit(extra))).otherwise(x))


@op("Shorten", options="include dots", needs=True)
def _Shorten(e, v, arg, opts):
    return _shorten(e, v, arg, opts | {"dots"})


def fill_text(x: Column, n, symbol: str = " ", right: bool = False, center: bool = False, center_right: bool = True) -> Column:
    """x padded to n characters; longer strings stay."""
    n = F.lit(n) if isinstance(n, int) else n
    room = n - F.length(x)
    if center:
        big, small = F.ceil(room / 2).cast("int"), F.floor(room / 2).cast("int")
        a, b = (big, small) if center_right else (small, big)
        out = F.concat(F.repeat(F.lit(symbol), a), x, F.repeat(F.lit(symbol), b))
    else:
        pad = F.repeat(F.lit(symbol), room.cast("int"))
        out = F.concat(pad, x) if right else F.concat(x, pad)
    return F.when(room > 0, out).otherwise(x)


@op("fill", "align", "width", options="left right center")
def _fill(e, v, arg, opts):
    value, symbol, _ = split_bar(arg or "")
    how = dict(symbol=symbol or " ", right="right" in opts, center="center" in opts)
    v = v.text()
    if value.strip() and int(value):
        return v.each(lambda x: fill_text(x, int(value), **how))
    v = v.vector()
    width = F.array_max(F.transform(v.col, F.length))
    return replace(v, col=F.transform(v.col, lambda x: fill_text(x, width, **how)))


def wrap_text(x: Column, width: int, lead: str = "") -> Column:
    """Lines of at most ``width`` characters, broken at spaces."""
    room = max(1, width - len(lead))

    def add(acc: Column, w: Column) -> Column:
        fits = F.length(acc["line"]) + 1 + F.length(w) <= room
        first = acc["line"] == ""
        done = F.when(first | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"])))
        line = F.when(first, w).when(fits, F.concat(acc["line"], F.lit(" "), w)).otherwise(w)
        return F.struct(done.alias("done"), line.alias("line"))

    def paragraph(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
        return F.aggregate(F.split(p, " "), start, add, lambda a: F.array_join(F.transform(F.concat(a["done"], F.array(a["line"])), lambda s: F.concat(F.lit(lead), s)), "\n"))

    return F.array_join(F.transform(F.split(x, "\n"), paragraph), "\n")


@op("swidth", default="80")
def _swidth(e, v, arg, opts):
    value, lead, _ = split_bar(arg)
    width = float(value) if value not in ("", ".sw") else 80
    width = max(15, int(width * 80) if width <= 1 else int(width))
    lead = "" if lead is None else lead[:-1] if lead.endswith("_") else lead + " "
    return v.text().each(lambda x: wrap_text(x, width, lead))


_PLACE = re.compile(r":(01|1|i|I|a|A):")


@op("paste", "append", options="right both front back delete", needs=True)
def _paste(e, v, arg, opts):
    left, right, _ = split_bar(arg)
    if right is None:
        left, right = (left, left) if "both" in opts else ("", left) if opts & {"right", "back"} else (left, "")
    v = v.text()
    if "delete" in opts:
        return v.each(lambda x: F.lit(left + right))

    def affix(text: str, i: Column | None, n: Column | None) -> Column:
        parts, at = [], 0
        for m in _PLACE.finditer(text) if i is not None else ():
            parts.append(F.lit(text[at : m.start()]))
            mark = (i + 1).cast("string")
            parts.append(F.lpad(mark, F.greatest(F.length(n.cast("string")), F.length(mark)), F.lit("0")) if m[1] == "01" else number_mark(m[1], i))
            at = m.end()
        return F.concat(*parts, F.lit(text[at:]))

    if _PLACE.search(left + right):
        v = v.vector()
        n = F.size(v.col)
        return replace(v, col=F.transform(v.col, lambda x, i: F.concat(affix(left, i, n), x, affix(right, i, n))))
    return v.each(lambda x: F.concat(F.lit(left), x, F.lit(right)))


@op("join")
def _join(e, v, arg, opts):
    return v.text().each(lambda x: F.regexp_replace(x, r"\\\n\s*", ""))


@op("escape", options="nl tab")
def _escape(e, v, arg, opts):
    def run(x: Column) -> Column:
        if not opts or "nl" in opts:
            x = F.replace(x, F.lit("\n"), F.lit("\\n"))
        if not opts or "tab" in opts:
            x = F.replace(x, F.lit("\t"), F.lit("\\t"))
        return x

    return v.text().each(run)


# numbers and dates


def _numeric(v: Val, f: Callable[[Column], Column]) -> Val:
    """f of numbers; what isn't one stays."""
    if v.number:
        return v.each(f)
    return v.text().each(lambda x: F.coalesce(f(N.as_number(x)), x.cast("string")))


def _n(letters: bool):
    def run(e, v, arg, opts):
        if opts & {"0", "zero"}:
            v = _numeric(v, N.plain).vector()
            width = F.array_max(F.transform(v.col, F.length))
            return replace(v, col=F.transform(v.col, lambda x: F.lpad(x, width, F.lit("0"))))
        return _numeric(v, lambda x: number_text(x, opts, letters))

    return run


op("n", options="letter upper zero roman Roman")(_n(False))
op("N", options="letter upper zero roman Roman")(_n(True))


def _compact(v: Val, f: Callable[[Column], Column]) -> Val:
    """A run of consecutive numbers as its first and last."""
    v = v.vector()
    nums = v.col if v.number else F.transform(v.col, N.as_number)
    run = F.forall(F.transform(nums, lambda x, i: F.coalesce(x - F.get(nums, i - 1), F.lit(1.0))), lambda d: d == 1)
    ends = F.concat(f(F.try_element_at(nums, F.lit(1))), F.lit(" to "), f(F.try_element_at(nums, F.lit(-1))))
    return Val("V", F.when((F.size(nums) > 1) & run, F.array(ends)).otherwise(F.transform(nums, f)), grouped=v.grouped)


def _nth(letters: bool):
    def run(e, v, arg, opts):
        f = lambda x: N.ordinal(x, letters or "letter" in opts)
        g = (lambda x: upper_first(f(x))) if "upper" in opts else f
        return _compact(v, g) if "compact" in opts else _numeric(v, g)

    return run


def _ntimes(letters: bool):
    def run(e, v, arg, opts):
        f = lambda x: N.times(x, letters or "letter" in opts)
        return _numeric(v, (lambda x: upper_first(f(x))) if "upper" in opts else f)

    return run


for _name, _letters in (("nth", False), ("Nth", True)):
    op(_name, options="letter upper compact")(_nth(_letters))
for _name, _letters in (("ntimes", False), ("Ntimes", True)):
    op(_name, options="letter upper")(_ntimes(_letters))


def _affixed(arg: str | None, f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    if not arg:
        return f
    a, b, _ = split_bar(arg)
    prefix, suffix = ("", a) if b is None else (a, b)
    return lambda x: F.concat(F.lit(prefix), f(x), F.lit(suffix))


def _digits(opts: set[str], default: int) -> int:
    return next((int(o[1:]) for o in opts if o.startswith("#")), next((int(o) for o in opts if o.isdigit()), default))


@op("round", options="int nocomma digit")
def _round(e, v, arg, opts):
    digits = _digits(opts, 0)
    s = next((int(o[1:]) for o in opts if re.fullmatch(r"s\d+", o)), 0)
    how = dict(int_as_double="int" in opts, commas="nocomma" not in opts)
    f = (lambda x: N.significant(x, s, digits, **how)) if s else (lambda x: N.rounded(x, digits, **how))
    return _numeric(v, _affixed(arg, f))


@op("signif", options="int nocomma digit")
def _signif(e, v, arg, opts):
    digits = _digits(opts, 3)
    r = next((int(o[1:]) for o in opts if re.fullmatch(r"r\d+", o)), 1)
    how = dict(int_as_double="int" in opts, commas="nocomma" not in opts)
    return _numeric(v, _affixed(arg, lambda x: N.significant(x, digits, r, **how)))


#: Strptime signs as datetime patterns.
_STRPTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "E", "p": "a", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "Z": "z", "z": "xx", "%": "%"}


def date_pattern(arg: str) -> str:
    out, k = [], 0
    while k < len(arg):
        if arg[k] == "%" and k + 1 < len(arg):
            out.append(_STRPTIME[arg[k + 1]])
            k += 2
        else:
            out.append("'" + arg[k] + "'" if arg[k].isalpha() else "''" if arg[k] == "'" else arg[k])
            k += 1
    return "".join(out).replace("''", "") if "'" not in arg else "".join(out)


@op("format", "Format", options="0 zero left right center")
def _format(e, v, arg, opts):
    if arg is not None:
        return v.each(lambda x: F.date_format(x, date_pattern(arg)))
    v = (_numeric(v, N.comma) if v.number else v.text()).vector()
    width = F.array_max(F.transform(v.col, F.length))
    if opts & {"0", "zero"}:
        return replace(v, col=F.transform(v.col, lambda x: F.lpad(x, width, F.lit("0"))))
    return replace(v, col=F.transform(v.col, lambda x: fill_text(x, width, right="right" in opts, center="center" in opts)))


@op("%", needs=True)
def _sprintf(e, v, arg, opts):
    fmt = "%" + re.sub(r"^ (?=\d+s)", "", arg)
    kind = re.search(r"[a-zA-Z]", arg)[0]
    if kind in "di":
        fmt = fmt.replace("i", "d", 1) if kind == "i" else fmt
        return (v if v.number else v.text().each(N.as_number, number=True)).each(lambda x: F.format_string(fmt, x.cast("bigint")))
    if kind in "feEgG":
        return (v if v.number else v.text().each(N.as_number, number=True)).each(lambda x: F.format_string(fmt, x))
    return v.text().each(lambda x: F.format_string(fmt, x))


@op("difftime", options="silent full")
def _difftime(e, v, arg, opts):
    f = N.duration_full if "full" in opts else N.duration
    return v.each(f) if v.number else v.text().each(lambda x: F.coalesce(f(N.as_number(x)), F.lit("(difftime: NA)")))


@op("dp", "deparse", options="long")
def _deparse(e, v, arg, opts):
    col = v.col.cast("string") if v.kind == "S" else F.to_json(v.col)
    n = int(arg or 35)
    return Val("S", col if "long" in opts else F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col), grouped=v.grouped)
