"""Queries for the template grammar, row-mode operators, literals and registries, with the SQL that gives the same rows."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, functions as F

from texloom import api as A, sources
from texloom.operators import frame as C
from texloom.queries import query

_LINES = "(SELECT l_orderkey, list(l_linenumber::VARCHAR ORDER BY l_linenumber) AS l FROM lineitem GROUP BY 1)"
_COUNTS = "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"
_WORDS = "(SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)"
_ONES = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine']"


def _joined(items: str, last: str, limit: int | None = None, quote: str = "") -> str:
    """SQL of an enumeration of a list."""
    q = quote.replace("'", "''")
    each = f"list_transform({items}, lambda x: '{q}' || x || '{q}')"
    few = f"CASE WHEN len({items}) = 1 THEN {each}[1] ELSE array_to_string({each}[1:len({items}) - 1], ', ') || '{last}' || {each}[len({items})] END"
    if limit is None:
        return few
    return f"CASE WHEN len({items}) > {limit} THEN array_to_string({each}[1:{limit - 1}], ', ') || '{last}' || (len({items}) - {limit - 1}) || ' others' ELSE {few} END"


def _lines(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"))


def _counts(t) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


# boxes and templates


@query("SELECT p_partkey, 'SIZE ' || p_size || '-' || p_brand AS x FROM part")
def verbatim_box(t):
    d = t("part")
    return d.select("p_partkey", A.template("{upper ! size} {p_size}{!-}{?p_brand}", df=d).alias("x"))


@query("SELECT p_partkey, 'x:' || p_size || '; y:' || p_size AS x FROM part")
def slash_box(t):
    d = t("part")
    return d.select("p_partkey", A.template("{/x, y}:{p_size}", df=d, collapse="; ").alias("x"))


@query("SELECT p_partkey, p_brand || '/' || lower(p_type) || '/' || p_size AS x FROM part")
def sep_pieces(t):
    d = t("part")
    return d.select("p_partkey", A.template("{p_brand}", "{lower ? p_type}", "{p_size}", df=d, sep="/").alias("x"))


@query("SELECT p_partkey, p_brand || '+' || p_size AS x FROM part")
def vectorize_collapse(t):
    d = t("part")
    return d.select("p_partkey", A.template("{p_brand}", "{p_size}", df=d, vectorize=True, collapse="+").alias("x"))


@query("SELECT p_partkey, '<' || upper(p_brand) || '>!' AS x, lower(p_type) AS nested FROM part")
def default_last_nest(t):
    d = t("part")
    return d.select("p_partkey", A.template("<{p_brand}>", df=d, default="upper", last="'!'paste.right").alias("x"), A.template("lower ? p_type", df=d, nest=True).alias("nested"))


@query("SELECT p_partkey, upper(p_brand) || ' {x}' AS x, '{x} ' || p_size AS y FROM part")
def delimiters_escapes(t):
    d = t("part")
    return d.select("p_partkey", A.template("<<upper ? p_brand>> {x}", df=d, delim="<< >>").alias("x"), A.template(r"\{x} {p_size}", df=d).alias("y"))


@query("SELECT l_orderkey, list_transform(l, lambda x: l_orderkey || '-' || x) AS x FROM " + _LINES)
def recycle_lines(t):
    d = _lines(t)
    return d.select("l_orderkey", A.template("{l_orderkey}-{lines}", df=d).alias("x"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b + c'), (3, 'd > 1'), (4, 'd')) AS v(position, expression)")
def template_expressions(t):
    found = A.expressions("{a} {upper ? b + c} {& d > 1 ; {d} ; no}")
    return t("nation").sparkSession.createDataFrame(list(enumerate(found, 1)), "position int, expression string")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS v(position, name)")
def template_variables(t):
    return t("nation").sparkSession.createDataFrame(list(enumerate(A.variables("{upper(a)} {b + c} {a}"), 1)), "position int, name string")


@query("SELECT '> one TWO' || chr(10) || '> three' AS printed, 'four 4' AS told")
def cat_message(t):
    spark = t("nation").sparkSession
    printed = A.cat(spark, "one {upper ! two} three", width=12, leader="> ", file=io.StringIO())
    told = A.cat(spark, "four {len ? x}", vars={"x": A.Val("V", F.array(*(F.lit(c) for c in "abcd")))}, file=io.StringIO())
    return spark.createDataFrame([(printed, told)], "printed string, told string")


# plurals


@query(f"SELECT l_orderkey, 'Line' || CASE WHEN len(l) > 1 THEN 's' ELSE '' END || ' ' || {_joined('l', ' and ', 7)} || CASE WHEN len(l) > 1 THEN ' are' ELSE ' is' END || ' in order ' || l_orderkey AS x FROM " + _LINES)
def plural_of_length(t):
    d = _lines(t)
    return d.select("l_orderkey", A.template("Line{$s ? lines} {$enum} {$is} in order {l_orderkey}", df=d).alias("x"))


@query(f"SELECT o_custkey, n || ' entr' || CASE WHEN n > 1 THEN 'ies don''t match' ELSE 'y doesn''t match' END || ', box' || CASE WHEN n > 1 THEN 'es' ELSE '' END AS x FROM {_COUNTS}")
def plural_endings_verbs(t):
    d = _counts(t)
    return d.select("o_custkey", A.template("{n} entr{#y ? n} {#don't} match, box{#es}", df=d).alias("x"))


@query(f"SELECT l_orderkey, l_linenumber, ({_ONES})[n + 1] || ' of ' || CASE n WHEN 0 THEN 'no line' WHEN 1 THEN '1 line' ELSE n || ' lines' END AS x, n AS len FROM (SELECT l_orderkey, l_linenumber, (l_linenumber - 1)::BIGINT AS n FROM lineitem)")
def plural_numbers(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).cast("bigint").alias("n"))
    return d.select("l_orderkey", "l_linenumber", A.template("{#N ? n} of {#n.no} line{#s}", df=d).alias("x"), F.col("n").alias("len"))


@query("SELECT l_orderkey, l_linenumber, (['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth'])[l_linenumber] || ' line, sent ' || CASE l_linenumber WHEN 1 THEN 'once' WHEN 2 THEN 'twice' ELSE l_linenumber || ' times' END AS x FROM lineitem")
def plural_order_times(t):
    d = t("lineitem")
    return d.select("l_orderkey", "l_linenumber", A.template("{#Nth ? l_linenumber} line, sent {#ntimes}", df=d).alias("x"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'none' WHEN 2 THEN 'one' ELSE 'several (' || (l_linenumber - 1) || ')' END || CASE WHEN l_linenumber > 2 THEN ' they' ELSE ' it' END AS x FROM lineitem")
def plural_cases(t):
    d = t("lineitem").withColumn("n", F.col("l_linenumber") - 1)
    return d.select("l_orderkey", "l_linenumber", A.template("{#(none;one;several ({n ? n})) ? n} {#(it;they)}", df=d).alias("x"))


# arrays in rows


@query(f"SELECT p_partkey, w[len(w)] AS last, array_to_string(w[1:len(w) - 1], ' ') AS but_last, array_to_string(w[1:2], ' ') AS head, '0' AS none FROM {_WORDS}")
def first_last_head(t):
    return t("part").select("p_partkey", A.ops("p_type", "' 's, last, ''c").alias("last"), A.ops("p_type", "' 's, -1 last, ' 'c").alias("but_last"), A.ops("p_type", "' 's, 2 head, ' 'c").alias("head"), A.ops("p_type", "' 's, nuke, len").alias("none"))


@query(f"SELECT p_partkey, w[1] AS first, array_to_string(w[2:], ' ') AS but_first, CASE WHEN len(w) > 2 THEN w[1] || w[len(w)] ELSE array_to_string(w, '') END AS ends FROM {_WORDS}")
def first_and_ends(t):
    return t("part").select("p_partkey", A.ops("p_type", "' 's, first, ''c").alias("first"), A.ops("p_type", "' 's, -1 first, ' 'c").alias("but_first"), A.ops("p_type", "' 's, '1|1'first, ''c").alias("ends"))


@query(f"SELECT p_partkey, array_to_string(list_transform(w, lambda x: left(x, 2)), ' ') AS heads, array_to_string(list_transform(w, lambda x: right(x, 1)), ' ') AS tails FROM {_WORDS}")
def group_first_last(t):
    return t("part").select("p_partkey", A.ops("p_type", "' 's, ''s, ~(2 first, ''c), ' 'c").alias("heads"), A.ops("p_type", "' 's, ''s, ~(1 last, ''c), ' 'c").alias("tails"))


@query(f"SELECT p_partkey, array_to_string(list_reverse_sort(w), ' ') AS x FROM {_WORDS}")
def dsort_row(t):
    return t("part").select("p_partkey", A.ops("p_type", "' 's, dsort, ' 'c").alias("x"))


@query(f"SELECT p_partkey, {_joined('w', ' and ')} AS x FROM {_WORDS}")
def collapse_and(t):
    return t("part").select("p_partkey", A.ops("p_type", "' 's, C").alias("x"))


@query("SELECT p_partkey, p_brand || '+' || p_type AS x FROM part")
def split_commas(t):
    return t("part").select("p_partkey", A.ops(F.concat_ws(", ", "p_brand", "p_type"), "S, '+'c").alias("x"))


@query(f"SELECT p_partkey, array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN x LIKE '%A%' THEN i END), lambda i: i IS NOT NULL), ',') AS x FROM {_WORDS}")
def which_row(t):
    return t("part").select("p_partkey", A.ops("p_type", "' 's, 'A'which, ','c").alias("x"))


@query(f"SELECT l_orderkey, {_joined('l', ' or ', 4, chr(39))} AS x, {_joined('l', ' nor ', 7)} AS y FROM " + _LINES)
def enum_row(t):
    d = _lines(t)
    return d.select("l_orderkey", A.ops("lines", "enum.q.or.4", df=d).alias("x"), A.ops("lines", "enum.nor", df=d).alias("y"))


@query("SELECT p_partkey, '''' || p_brand || '''' AS q, '\"' || p_brand || '\"' AS qq, '`' || p_brand || '`' AS bq FROM part")
def quotes(t):
    return t("part").select("p_partkey", A.ops("p_brand", "q").alias("q"), A.ops("p_brand", "Q").alias("qq"), A.ops("p_brand", "bq").alias("bq"))


@query(r"SELECT doc_id, replace(replace(text, chr(10), '\n'), chr(9), '\t') AS text FROM documents")
def escape_text(t):
    return t("documents").select("doc_id", A.ops("text", "escape").alias("text"))


@query("SELECT conv_id, turn, role || ':' || text AS x FROM conversations")
def join_lines(t):
    return t("conversations").select("conv_id", "turn", A.ops(F.concat("role", F.lit(":\\\n   "), "text"), "join").alias("x"))


@query("SELECT doc_id, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS x FROM documents")
def deparse_text(t):
    return t("documents").select("doc_id", A.ops("text", "20 dp").alias("x"))


@query("SELECT p_partkey, p_size || '. ' || p_name AS x, lpad(p_size::VARCHAR, 5, '0') AS y FROM part")
def sprintf_number(t):
    d = t("part")
    return d.select("p_partkey", A.template("{p_size}. {p_name}", df=d).alias("x"), A.ops("p_size", "%05i", df=d).alias("y"))


@query("SELECT p_partkey, CASE WHEN r > 0 THEN repeat(' ', (r + 1) // 2) || p_name || repeat(' ', r // 2) ELSE p_name END AS x FROM (SELECT p_partkey, p_name, 12 - length(p_name) AS r FROM part)")
def fill_center(t):
    return t("part").select("p_partkey", A.ops("p_name", "12 fill.center").alias("x"))


# patterns


@query("SELECT page_id, url LIKE '%://%' AS plain, regexp_matches(url, '^[a-z]+://[^/]+/') AS both FROM pages")
def escaped_slash(t):
    return t("pages").select("page_id", A.matches(F.col("url"), r"fixed/:\/\/".replace("\\", "")).alias("plain"), A.matches(F.col("url"), r"^[a-z]+:\//[^/]+/").alias("both"))


@query("SELECT p_partkey, p_name LIKE '%w%' AND p_name LIKE '%o%' AS every, p_name LIKE '%w%' OR p_name LIKE '%x%' AS some, (p_name LIKE '%w%' OR p_name LIKE '%x%') AND p_name NOT LIKE '%o%' AS mixed FROM part")
def several_patterns(t):
    x = F.col("p_name")
    return t("part").select("p_partkey", A.matches(x, "w", "o").alias("every"), A.matches(x, "w", "x", any_of=True).alias("some"), A.matches(x, "w | x & !o").alias("mixed"))


@query("SELECT p_partkey, regexp_replace(p_name, 'cold|warm|hot', '<heat>', 'g') AS x, regexp_matches(p_name, 'cold|warm|hot') AS has FROM part")
def magic_pattern(t):
    heat = {"heat": ["cold", "warm", "hot"], "name": "heat"}
    x = F.col("p_name")
    return t("part").select("p_partkey", A.replace(x, r"magic/{'\|'c ? heat} => <{name}>", vars=heat).alias("x"), A.matches(x, r"magic/{'\|'c ? heat}", vars=heat).alias("has"))


# registries and literals


@query("SELECT p_partkey, upper(p_name || p_name) || '!' AS x, upper(p_brand) AS y FROM part")
def registered_ops(t):
    own = A.Aliases(delim=".[ ]")
    own.register_fun("twice", lambda x, arg, opts: F.concat(x, x))
    own.register_ops("loud", "upper, '!'paste.right")
    d = t("part")
    return d.select("p_partkey", own.ops("p_name", "twice, loud").alias("x"), own.template(".[upper ? p_brand]", df=d).alias("y"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
def vec_literal(t):
    return t("customer").filter(F.array_contains(sources.vec("BUILDING, {more}", vars={"more": ["MACHINERY", "FURNITURE"]}), F.col("c_mktsegment"))).select("c_custkey")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'pending' END AS status FROM orders")
def matrix_literal(t):
    names = sources.matrix("O, open\nF, filled\nP, pending")
    return t("orders").select("o_orderkey", F.create_map(*(F.lit(x) for row in names for x in row))[F.col("o_orderstatus")].alias("status"))


@query("SELECT l_returnflag, note, count(*) AS n FROM lineitem JOIN (VALUES ('R', 'returned'), ('A', 'accepted')) AS v(flag, note) ON flag = l_returnflag GROUP BY 1, 2")
def table_literal(t):
    d = t("lineitem")
    notes = sources.table(d.sparkSession, "flag, note\nR, returned\nA, accepted")
    return d.join(F.broadcast(notes), d["l_returnflag"] == notes["flag"]).groupBy("l_returnflag", "note").agg(F.count(F.lit(1)).alias("n"))


# columns and groups of large tables


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def split_rows_plain(t):
    return C.split_rows(t("part"), "p_type", " ", ["p_partkey"], out="word")


@query("SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS x FROM orders GROUP BY 1")
def paste_orders(t):
    return C.paste_rows(t("orders"), "o_orderpriority", ["o_custkey"], "; ", order_by="o_orderkey", out="x")


@query(f"SELECT o_custkey, {_joined('l', ' and ', 5, '`')} AS x FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)")
def enum_orders(t):
    return C.enum_rows(t("orders"), "o_orderstatus", ["o_custkey"], order_by="o_orderkey", options={"bq", "5"}, out="x")


@query("SELECT o_custkey, position FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders) WHERE o_orderpriority LIKE '1%'")
def which_orders(t):
    return C.which(t("orders"), "o_orderpriority", "^1", order_by="o_orderkey", by=["o_custkey"])


@query("SELECT l_returnflag, l_linestatus, n, n / sum(n) OVER (PARTITION BY l_returnflag) AS s FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def table_by_group(t):
    return C.freq_table(t("lineitem"), "l_linestatus", ["l_returnflag"])


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%w%' UNION ALL SELECT p_partkey FROM part WHERE p_name LIKE '%o%'")
def get_seq_parts(t):
    return C.get(t("part"), "p_name", "w", "o", seq=True).select("p_partkey")


@query("SELECT p_partkey, rpad(p_type, m, ' ') AS p_type FROM part, (SELECT max(length(p_type))::INT AS m FROM part)")
def fill_max_parts(t):
    return C.fill_max(t("part").select("p_partkey", "p_type"), "p_type")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 2")
def last_by_group(t):
    return C.last(t("orders"), 2, "o_orderkey", ["o_custkey"]).select("o_custkey", "o_orderkey")
