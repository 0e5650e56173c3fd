"""Column mode: operators over a whole column or its groups, as DataFrame steps.

A column has no order of its own; operators for which order counts take
``order_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from texloom.functions import numbers as N, regexes as R
from texloom.operators.row import Engine, enumeration, split_text
from texloom.plans.pattern import PatternSpec, parse_pattern

Order = str | Column | list


def _order(order_by: Order) -> list:
    return list(order_by) if isinstance(order_by, list | tuple) else [order_by]


def free_name(df: DataFrame, base: str) -> str:
    """A name for a helper column that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(x for k in range(len(taken) + 1) if (x := f"{base}{k or ''}").lower() not in taken)


def specs(patterns: tuple[str, ...], *, magic: bool = False, vars: dict | None = None, **flags: bool) -> list[PatternSpec]:
    from texloom.operators.magic import expand

    extra = {k for k, v in flags.items() if v}
    return [parse_pattern(expand(p, vars, on=magic), extra=extra) for p in patterns]


def matches(col: Column, *patterns: str, any_of: bool = False, fixed: bool = False, ignore: bool = False, word: bool = False, magic: bool = False, vars: dict | None = None, for_filter: bool = False) -> Column:
    """Whether each string matches all patterns, or any of them. With ``magic``, patterns are templates that may name ``vars``."""
    out = None
    for spec in specs(patterns, magic=magic, vars=vars, fixed=fixed, ignore=ignore, word=word):
        own = R.matches_spec(col, spec, for_filter)
        out = own if out is None else (out | own) if any_of else (out & own)
    return out


def any_match(df: DataFrame, text: str, *patterns: str, by: list[str] | None = None, **how) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.coalesce(F.bool_or(matches(F.col(text), *patterns, **how)), F.lit(False)).alias("any"))


def all_match(df: DataFrame, text: str, *patterns: str, by: list[str] | None = None, **how) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.coalesce(F.bool_and(matches(F.col(text), *patterns, **how)), F.lit(True)).alias("all"))


def which(df: DataFrame, text: str, *patterns: str, order_by: Order, by: list[str] | None = None, **how) -> DataFrame:
    """Positions, from 1, of the rows that match. Give ``by`` where the data are large: positions of a whole column are counted in one task."""
    w = Window.partitionBy(*(by or [])).orderBy(*_order(order_by))
    hit = matches(F.col(text), *patterns, **how)
    return df.select(*(by or []), F.row_number().over(w).alias("position"), hit.alias("_hit")).filter("_hit").drop("_hit")


def get(df: DataFrame, text: str, *patterns: str, seq: bool = False, seq_unik: bool = False, **how) -> DataFrame:
    """Rows that match. ``seq``: those of the first pattern, then those of the second and so on; ``seq_unik``: without repeats of the text."""
    if not (seq or seq_unik):
        return df.filter(matches(F.col(text), *patterns, for_filter=True, **how))
    out = None
    for p in patterns:
        own = df.filter(matches(F.col(text), p, for_filter=True, **how))
        out = own if out is None else out.unionByName(own)
    return out.dropDuplicates([text]) if seq_unik else out


def get_in(df: DataFrame, text: str, values: list[str] | DataFrame, negate: bool = False) -> DataFrame:
    """Set membership. A DataFrame of values (its first column) is joined, so it may be large."""
    if isinstance(values, DataFrame):
        other = values.select(F.col(values.columns[0]).alias("_value"))
        return df.join(other, df[text] == other["_value"], "left_anti" if negate else "left_semi")
    hit = F.coalesce(F.col(text).isin(values), F.lit(False))
    return df.filter(~hit if negate else hit)


def split_rows(df: DataFrame, text: str, split: str, ids: list[str] | None = None, *, pos: bool = False, obs: str | None = None, out: str | None = None, keep_empty: bool = False, **flags: bool) -> DataFrame:
    """One row for each piece: ids, optionally its position, and the piece. An empty text has no rows."""
    ids = ids or []
    pieces = split_text(F.col(text), split, {k for k, v in flags.items() if v}, keep_empty)
    keep = [F.col(c) for c in ids] + ([F.monotonically_increasing_id().alias(obs)] if obs else [])
    place = free_name(df, "_pos")
    d = df.select(*keep, F.posexplode(pieces).alias(place, out or text))
    return d.select(*d.columns[: len(keep)], *([(F.col(place) + 1).alias("pos")] if pos else []), d.columns[-1])


def paste_rows(df: DataFrame, text: str, ids: list[str], sep: str = " ", *, order_by: Order | None = None, last: str | None = None, out: str | None = None) -> DataFrame:
    """Texts pasted by key, in the order given; nulls are NA. One row for each key."""
    x = F.coalesce(F.col(text).cast("string"), F.lit("NA"))
    order = _order(order_by if order_by is not None else text)
    parts = F.sort_array(F.collect_list(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], x.alias("_x"))))
    from texloom.operators.row import collapse

    g = df.groupBy(*ids).agg(parts.alias("_parts"))
    return g.select(*ids, collapse(F.transform("_parts", lambda p: p["_x"]), sep, last).alias(out or text))


def enum_rows(df: DataFrame, text: str, ids: list[str], *, order_by: Order | None = None, options: set[str] = frozenset(), out: str = "enum") -> DataFrame:
    order = _order(order_by if order_by is not None else text)
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).cast("string").alias("_x"))))
    return df.groupBy(*ids).agg(parts.alias("_parts")).select(*ids, enumeration(F.transform("_parts", lambda p: p["_x"]), set(options)).alias(out))


def freq_table(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """text, n and share of each different value, counted with partial sums."""
    by = by or []
    counts = df.groupBy(*by, text).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    joined = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))  # one row
    return joined.select(*by, text, "n", (F.col("n") / F.col("_total")).alias("s"))


def unik(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    return df.select(*(by or []), text).dropDuplicates()


def top(df: DataFrame, n: int, order_by: Order, by: list[str] | None = None) -> DataFrame:
    """The first n rows, of the whole (sorted in part by each task) or of each group."""
    if not by:
        return df.orderBy(*_order(order_by)).limit(n)
    w = Window.partitionBy(*by).orderBy(*_order(order_by))
    rank = free_name(df, "_rn")
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).drop(rank)


def last(df: DataFrame, n: int, order_by: Order, by: list[str] | None = None) -> DataFrame:
    back = [(F.col(o) if isinstance(o, str) else o).desc() for o in _order(order_by)]
    return top(df, n, back, by)


def length(df: DataFrame, by: list[str] | None = None, out: str = "len") -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias(out))


def rm(df: DataFrame, text: str, what: str = "empty") -> DataFrame:
    c = F.col(text)
    gone = {"empty": c == "", "blank": F.trim(F.translate(c, "\t\n\r", "   ")) == "", "noalpha": ~c.rlike(r"\p{L}"), "noalnum": ~c.rlike(r"[\p{L}\p{N}]"), "all": F.lit(True)}[what]
    return df.filter(~F.coalesce(gone, F.lit(False)))


def num_rm(df: DataFrame, text: str, out: str | None = None) -> DataFrame:
    """Rows whose text is a number, as one."""
    return df.withColumn(out or text, N.as_number(F.col(text))).filter(F.col(out or text).isNotNull())


def fill_max(df: DataFrame, text: str, by: list[str] | None = None, **how) -> DataFrame:
    """Padded to the longest text of the column or group: one partial maximum, joined back."""
    from texloom.operators.row import fill_text

    by = by or []
    most = free_name(df, "_width")
    width = df.groupBy(*by).agg(F.max(F.length(text)).alias(most))
    d = df.join(width, by) if by else df.crossJoin(F.broadcast(width))
    return d.withColumn(text, fill_text(F.col(text), F.col(most), **how)).drop(most)


def apply_ops(df: DataFrame, text: str, chain: str, *, out: str | None = None, engine: Engine | None = None, dedupe: bool = False) -> DataFrame:
    """A chain on a column. ``dedupe`` runs it on the different values alone and joins the results back; only for chains that work on each string."""
    from texloom.api import ops

    out = out or text
    if not dedupe:
        return df.withColumn(out, ops(F.col(text), chain, df=df, engine=engine))
    key, done = free_name(df, "_key"), free_name(df, "_out")
    values = df.select(F.col(text).alias(key)).dropDuplicates()
    values = values.withColumn(done, ops(F.col(key), chain, df=values, engine=engine))
    return df.join(values, F.col(text).eqNullSafe(F.col(key))).withColumn(out, F.col(done)).drop(key, done)
