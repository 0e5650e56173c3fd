"""Queries over the generated tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from texloom import api as A
from texloom.operators import frame as C
from texloom.operators.row import STOPWORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d, f=f: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = r"""
WITH w AS (SELECT unnest(string_split(trim(regexp_replace(lower(text), '[[:punct:] \t\n]+', ' ', 'g')), ' ')) AS word FROM documents WHERE lang = 'en')
"""


@query(_WORDS + f"SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN ({', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in STOPWORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def frequent_words(t):
    d = t("documents").filter("lang = 'en'").select(A.ops("text", "lower, ws.punct").alias("text"))
    words = C.rm(C.split_rows(d, "text", " ", out="word"), "word")
    return C.top(C.freq_table(C.get_in(words, "word", STOPWORDS, negate=True), "word").select("word", "n"), 20, [F.desc("n"), "word"])


@query(_WORDS.replace(" WHERE lang = 'en'", "") + f"SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN ({', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in STOPWORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def frequent_words_all(t):
    d = t("documents").select(A.ops("text", "lower, ws.punct").alias("text"))
    words = C.rm(C.split_rows(d, "text", " ", out="word"), "word")
    return C.top(C.freq_table(C.get_in(words, "word", STOPWORDS, negate=True), "word").select("word", "n"), 20, [F.desc("n"), "word"])


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'w') AND NOT regexp_matches(lower(p_name), 'cold')")
def is_logic(t):
    return t("part").filter(A.matches(F.col("p_name"), "i/W & !COLD")).select("p_partkey", "p_name")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\b(the|of)\b')")
def get_word(t):
    return C.get(t("documents"), "text", "w/the, of").select("doc_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def get_in(t):
    return C.get_in(t("customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def get_equal(t):
    d = t("customer")
    return d.filter(F.size(A.ops(F.array("c_mktsegment"), "'BUILDING'get.equal", array=True)) > 0).select("c_custkey")


@query("SELECT o_orderstatus, bool_or(o_orderpriority LIKE '1%') AS \"any\", bool_and(o_orderpriority LIKE '%-%') AS \"all\" FROM orders GROUP BY 1")
def any_all_by_group(t):
    d = t("orders")
    return C.any_match(d, "o_orderpriority", "^1", by=["o_orderstatus"]).join(C.all_match(d, "o_orderpriority", "-", by=["o_orderstatus"]), "o_orderstatus")


@query("SELECT n_regionkey, position FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position FROM nation) WHERE regexp_matches(n_name, '[13579]$')")
def which_by_group(t):
    return C.which(t("nation"), "n_name", "[13579]$", order_by="n_nationkey", by=["n_regionkey"])


@query("SELECT n_name FROM nation WHERE n_name LIKE '%2%' UNION ALL SELECT n_name FROM nation WHERE n_name LIKE '%1%'")
def get_seq(t):
    return C.get(t("nation"), "n_name", "2", "1", seq=True).select("n_name")


@query("SELECT DISTINCT n_name FROM nation WHERE n_name LIKE '%2%' OR n_name LIKE '%1%'")
def get_seq_unik(t):
    return C.get(t("nation"), "n_name", "2", "1", seq_unik=True).select("n_name")


@query("SELECT p_partkey, CASE WHEN regexp_matches(x, 'BRASS') THEN 'metal' ELSE x END AS cleaned FROM (SELECT p_partkey, regexp_replace(replace(p_type, ' ', '_'), '[AE]', '', 'g') AS x FROM part)")
def clean_multi(t):
    c = A.clean(A.replace(F.col("p_type"), " ", "_", fixed=True), "A, E", "total/BRASS => metal")
    return t("part").select("p_partkey", c.alias("cleaned"))


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS x FROM part")
def replace_single(t):
    return t("part").select("p_partkey", A.ops("p_name", "'single/[aeiou] => _'r").alias("x"))


@query(r"SELECT p_partkey, regexp_replace(p_name, '(\w+) (\w+)', '\2 \1', 'g') AS x FROM part")
def replace_groups(t):
    return t("part").select("p_partkey", A.replace(F.col("p_name"), r"(\w+) (\w+)", r"\2 \1").alias("x"))


@query("SELECT c_custkey, regexp_extract(c_name, '[0-9]+', 0) AS first_number FROM customer")
def extract_first(t):
    return t("customer").select("c_custkey", A.ops("c_name", "'[[:digit:]]+'x").alias("first_number"))


@query("SELECT page_id, array_to_string(regexp_extract_all(url, '[a-z]+'), '-') AS words FROM pages")
def extract_all_join(t):
    return t("pages").select("page_id", A.ops("url", "'[a-z]+'X, '-'c").alias("words"))


@query("SELECT doc_id, pos, piece FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS piece, generate_subscripts(string_split(text, '. '), 1) AS pos, len(string_split(text, '. ')) AS n FROM documents WHERE text <> '') WHERE NOT (pos = n AND piece = '' AND n > 1)")
def split_rows_pos(t):
    return C.split_rows(t("documents"), "text", "fixed/. ", ["doc_id"], pos=True, out="piece").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def paste_rows_key(t):
    return C.paste_rows(t("nation"), "n_name", ["n_regionkey"], "; ", order_by="n_nationkey", out="names")


@query("SELECT n_regionkey, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l)-1], ', ') || ' and ' || l[len(l)] END AS names FROM (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)")
def collapse_last(t):
    return C.paste_rows(t("nation"), "n_name", ["n_regionkey"], ", ", order_by="n_nationkey", last=" and ", out="names")


@query("SELECT n_regionkey, CASE WHEN len(l) > 4 THEN array_to_string(list_transform(l[1:3], lambda x: '''' || x || ''''), ', ') || ' or ' || (len(l) - 3) || ' others' WHEN len(l) = 1 THEN '''' || l[1] || '''' ELSE array_to_string(list_transform(l[1:len(l)-1], lambda x: '''' || x || ''''), ', ') || ' or ''' || l[len(l)] || '''' END AS names FROM (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)")
def enum_by_group(t):
    return C.enum_rows(t("nation"), "n_name", ["n_regionkey"], order_by="n_nationkey", options={"q", "or", "4"}, out="names")


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, upper(left(p_name, 1)) || substr(p_name, 2) AS first FROM part")
def case_upper(t):
    return t("part").select("p_partkey", A.ops("p_name", "upper").alias("up"), A.ops("p_type", "lower").alias("low"), A.ops("p_name", "upper.first").alias("first"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM part")
def case_title(t):
    return t("part").select("p_partkey", A.ops("p_type", "title.force").alias("title"))


@query(r"SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(lower(text), '[^.?!]*[.?!]+\s*|[^.?!]+$'), lambda p: regexp_extract(p, '^[^\pL]*') || upper(left(regexp_replace(p, '^[^\pL]*', ''), 1)) || substr(regexp_replace(p, '^[^\pL]*', ''), 2)), ''), '') AS text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def case_sentence(t):
    return t("documents").select("doc_id", A.ops("text", "lower, upper.sentence").alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[!-/:-@\[-`{-~ \t\n0-9]+', ' ', 'g')) AS text FROM documents")
def ws_punct(t):
    return t("documents").select("doc_id", A.ops("text", "ws.punct.digit").alias("text"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(string_split(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')), ' '), lambda w: strlen(w) > 1), ' ') AS text FROM conversations")
def ws_isolated(t):
    return t("conversations").select("conv_id", "turn", A.ops("text", "ws.isolated").alias("text"))


@query(r"SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10)) AS text FROM conversations")
def tws_trim(t):
    return t("conversations").select("conv_id", "turn", A.ops("text", "tws").alias("text"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN left(p_name, 7) || '..' ELSE p_name END AS dots, CASE WHEN length(p_name) > 6 THEN left(p_name, 6) || '~' ELSE p_name END AS k, left(p_name, 3) AS head, right(p_name, 3) AS tail, substr(p_name, 3) AS cut FROM part")
def shorten_dots(t):
    return t("part").select("p_partkey", A.ops("p_name", "8Shorten").alias("dots"), A.ops("p_name", "'6|~'k").alias("k"), A.ops("p_name", "3 firstchar").alias("head"), A.ops("p_name", "3 lastchar").alias("tail"), A.ops("p_name", "2 trim").alias("cut"))


@query("SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) < 8 THEN lpad(p_partkey::VARCHAR, 8, '0') ELSE p_partkey::VARCHAR END AS x, '[' || p_name || ']' AS q FROM part")
def fill_right_zero(t):
    return t("part").select("p_partkey", A.ops(F.col("p_partkey").cast("string"), "'8|0'fill.right").alias("x"), A.ops("p_name", "'[|]'paste").alias("q"))


@query("SELECT n_nationkey, rpad(n_name, m, ' ') AS n_name FROM nation, (SELECT max(length(n_name))::INT AS m FROM nation)")
def fill_max(t):
    return C.fill_max(t("nation").select("n_nationkey", "n_name"), "n_name")


@query("SELECT o_orderstatus, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS s FROM orders GROUP BY 1")
def table_freq(t):
    return C.freq_table(t("orders"), "o_orderstatus")


@query("SELECT user_id, array_to_string(list_transform(list_sort(l), lambda r: r.event_type || ' (' || r.n || ')'), ', ') AS types FROM (SELECT user_id, list({'event_type': event_type, 'n': n}) AS l FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)")
def table_row(t):
    d = t("events").groupBy("user_id").agg(F.collect_list("event_type").alias("types"))
    return d.select("user_id", A.ops("types", "table.sort, ', 'c", array=True).alias("types"))


@query("SELECT DISTINCT l_quantity FROM lineitem")
def unik_column(t):
    return C.unik(t("lineitem"), "l_quantity")


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_shipmode))), ',') AS x FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def unik_sorted(t):
    d = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("x"))
    return d.select("l_orderkey", A.ops("x", "unik, sort, ','c", array=True).alias("x"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top3_desc(t):
    return C.top(t("orders"), 3, [F.desc("o_totalprice"), "o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT doc_id FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def rm_blank(t):
    return C.rm(t("documents"), "text", "blank").select("doc_id")


@query("SELECT c_custkey, try_cast(regexp_extract(c_name, '[0-9]+$', 0) AS DOUBLE) AS x FROM customer WHERE try_cast(regexp_extract(c_name, '[0-9]+$', 0) AS DOUBLE) IS NOT NULL")
def num_rm(t):
    d = t("customer").select("c_custkey", A.extract(F.col("c_name"), "[0-9]+$", single=True).alias("x"))
    return C.num_rm(d, "x")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: array_to_string(list_sort(string_split(w, '')), '')), '+') AS x FROM part")
def group_sort_collapse(t):
    return t("part").select("p_partkey", A.ops("p_name", "' 's, ''s, ~(sort, ''c), '+'c").alias("x"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: length(w)), ',') AS x FROM part")
def group_len(t):
    return t("part").select("p_partkey", A.ops("p_name", "' 's, ''s, ~(len), ','c").alias("x"))


@query("SELECT p_partkey, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS nth, CASE p_size WHEN 1 THEN 'once' WHEN 2 THEN 'twice' ELSE p_size || ' times' END AS ntimes FROM part")
def nth_words(t):
    d = t("part")
    return d.select("p_partkey", A.ops("p_size", "nth", df=d).alias("nth"), A.ops("p_size", "ntimes", df=d).alias("ntimes"))


@query("SELECT l_orderkey, l_linenumber, (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[l_linenumber + 1] AS roman, (['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'])[l_linenumber + 1] AS words FROM lineitem")
def number_words(t):
    d = t("lineitem")
    return d.select("l_orderkey", "l_linenumber", A.ops("l_linenumber", "n.R", df=d).alias("roman"), A.ops("l_linenumber", "N", df=d).alias("words"))


@query("SELECT o_orderkey, format('{:,}', floor(abs(x))::BIGINT) || '.' || lpad(((x * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS price FROM (SELECT o_orderkey, o_totalprice::DECIMAL(18, 2) AS x FROM orders)")
def round_comma(t):
    d = t("orders")
    return d.select("o_orderkey", A.ops("o_totalprice", "r2.int", df=d).alias("price"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'many: ' || l_quantity::BIGINT ELSE 'few' END AS x FROM lineitem")
def ifelse_box(t):
    d = t("lineitem")
    return d.select("l_orderkey", "l_linenumber", A.template("{& l_quantity > 25 ; many: {l_quantity} ; few}", df=d).alias("x"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'large' ELSE (l_quantity::BIGINT)::VARCHAR END AS x FROM lineitem")
def dampif_box(t):
    d = t("lineitem")
    return d.select("l_orderkey", "l_linenumber", A.template("{&& l_quantity > 25 ; large}", df=d).alias("x"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'returned R' ELSE l_returnflag END AS x FROM lineitem")
def vif_box(t):
    d = t("lineitem")
    return d.select("l_orderkey", "l_linenumber", A.template("{vif('^R$' ; returned {.}) ? l_returnflag}", df=d).alias("x"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN upper(p_name) ELSE left(p_name, 4) END AS x FROM part")
def if_ops(t):
    return t("part").select("p_partkey", A.ops("p_name", "if(.nchar > 9 ; upper ; 4 firstchar)").alias("x"))


@query("SELECT o_custkey, CASE WHEN n = 1 THEN 'There is 1 order' ELSE 'There are ' || n || ' orders' END AS x FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def plural_value(t):
    d = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return d.select("o_custkey", A.template("There {#is ? n} {n} order{#s}", df=d).alias("x"))


@query("SELECT c_custkey, upper(c_mktsegment) || ': ' || c_name || ' [' || n_name || ']' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def template_concat(t):
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.interpolate(d, "{upper ? c_mktsegment}: {c_name} [{n_name}]", "label").select("c_custkey", "label")


@query("SELECT n_nationkey, list_transform([1, 2, 3], lambda i: n_name || '-' || i)[2] AS second, 'A' || n_nationkey || '/' || n_name AS x FROM nation")
def template_recycle(t):
    d = t("nation").withColumn("parts", F.array(F.lit(1), F.lit(2), F.lit(3)))
    return d.select("n_nationkey", F.get(A.template("{n_name}-{parts}", df=d), F.lit(1)).alias("second"), A.template("A{n_nationkey}/{n_name}", df=d).alias("x"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


@query(f"""SELECT doc_id, trim(regexp_replace(CASE WHEN lang = 'en' THEN array_to_string(list_filter(regexp_extract_all(text, '[[:alnum:]](?:[[:alnum:]'']*[[:alnum:]])?|[^[:alnum:]]+'), lambda w: lower(w) NOT IN ({_STOP})), '') ELSE text END, '[ \\t\\n]+', ' ', 'g')) AS text FROM documents""")
def stopwords_drop(t):
    # the words are English: other documents keep theirs
    text = F.when(F.col("lang") == "en", A.ops("text", "stopwords, ws")).otherwise(A.ops("text", "ws"))
    return t("documents").select("doc_id", text.alias("text"))


@query("SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda p: '> ' || replace(list_reduce(string_split(p, ' '), lambda a, w: CASE WHEN regexp_extract(a, '[^\\n]*$') = '' THEN a || w WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(w) <= 58 THEN a || ' ' || w ELSE a || chr(10) || w END), chr(10), chr(10) || '> ')), chr(10)) AS text FROM conversations")
def swidth_wrap(t):
    return t("conversations").select("conv_id", "turn", A.ops("text", "'60|>'swidth").alias("text"))


@query(r"SELECT doc_id, regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'Æ', 'AE'), 'Œ', 'OE'), '…', '...'), '€', 'EUR')), '[^\x00-\x7F]', '?', 'g') AS text FROM documents")
def ascii_fold(t):
    return t("documents").select("doc_id", A.ops("text", "ascii").alias("text"))


@query("SELECT p_partkey, format('{:,}', floor(p_retailprice)::BIGINT) AS x FROM part WHERE p_retailprice >= 1000")
def signif(t):
    d = t("part").filter("p_retailprice >= 1000")
    return d.select("p_partkey", A.ops("p_retailprice", "s4.r0", df=d).alias("x"))


@query("SELECT p_partkey, CASE WHEN p_retailprice >= 1000 OR p_retailprice = floor(p_retailprice) THEN format('{:,}', floor(p_retailprice)::BIGINT) ELSE floor(p_retailprice)::BIGINT || '.' || left(lpad(((p_retailprice - floor(p_retailprice)) * 1000000)::BIGINT::VARCHAR, 6, '0'), 4 - length(floor(p_retailprice)::BIGINT::VARCHAR)::INT) END AS x FROM part")
def signif_all(t):
    d = t("part")
    return d.select("p_partkey", A.ops("p_retailprice", "s4.r0", df=d).alias("x"))


@query("SELECT p_partkey, reverse(p_name) AS rev, p_name || p_name AS twice, array_to_string(list_transform(string_split(p_name, ''), lambda c: c || c), '') AS each FROM part")
def rev_each_times(t):
    return t("part").select("p_partkey", A.ops("p_name", "''s, rev, ''c").alias("rev"), A.ops(F.array("p_name"), "2 times.c", array=True).alias("twice"), A.ops("p_name", "''s, 2 each.c").alias("each"))


@query("SELECT p_partkey, CASE WHEN len(l) > 2 THEN l[1] || ', ' || l[2] || ', ' || (len(l) - 2) || ' others' ELSE array_to_string(l, ', ') END AS x FROM (SELECT p_partkey, string_split(p_type, ' ') AS l FROM part)")
def keep_k(t):
    return t("part").select("p_partkey", A.ops("p_type", "' 's, 2Ko, ', 'c").alias("x"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %m %Y') AS day, lpad(o_orderstatus, 5, ' ') AS status FROM orders")
def format_date(t):
    d = t("orders")
    return d.select("o_orderkey", A.ops("o_orderdate", "'%d %m %Y'format", df=d).alias("day"), A.ops("o_orderstatus", "% 5s").alias("status"))


@query("SELECT n_nationkey, 'a ' || n_name || ' b' AS ins, CASE WHEN n_name LIKE '%1%' THEN '' ELSE n_name END AS erased FROM nation")
def insert_erase(t):
    return t("nation").select("n_nationkey", A.ops(F.array("n_name"), "'a|b'insert, ' 'c", array=True).alias("ins"), A.ops("n_name", "'1'erase").alias("erased"))


@query("SELECT event_id, CASE WHEN s > 3600 THEN format('{:,}', (s // 3600)::BIGINT) || ' hour' || CASE WHEN s // 3600 > 1 THEN 's' ELSE '' END || ' ' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') || ' min' WHEN s > 60 THEN (s // 60) || ' min ' || lpad((s % 60)::VARCHAR, 2, '0') || ' sec' ELSE s || '.0s' END AS x FROM (SELECT event_id, event_id * 37 + 61 AS s FROM events)")
def difftime(t):
    d = t("events").select("event_id", (F.col("event_id") * 37 + 61).alias("s"))
    return d.select("event_id", A.ops("s", "difftime", df=d).alias("x"))


@query("SELECT l_orderkey, count(*) AS len FROM lineitem GROUP BY 1")
def len_by_group(t):
    return C.length(t("lineitem"), ["l_orderkey"])


@query("SELECT p_partkey, regexp_matches(p_name, 'w') AS has, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w LIKE '%o%'), ' ') AS words FROM part")
def is_get_row(t):
    return t("part").select("p_partkey", A.ops("p_name", "'w'is").alias("has"), A.ops("p_name", "' 's, 'o'get, ' 'c").alias("words"))


@query("SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment FROM customer")
def dedupe_apply(t):
    return C.apply_ops(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "upper", dedupe=True)
