import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from texloom import api as A, sources
from texloom.functions import regexes as R
from texloom.operators import frame as C
from texloom.operators.plural import conjugate
from texloom.operators.row import BUILTIN, Val
from texloom.plans.chain import ChainError, GroupOps, IfOps, OpCall, parse_chain, split_bar
from texloom.plans.pattern import PatternError, parse_pattern
from texloom.plans.template import TemplateError, expressions, parse_template, variables
from texloom.queries import QUERIES, SQL


def S(x):
    return (x,)


def V(*xs):
    return list(xs)


def val(x):
    """A one-tuple as a scalar, a list as an array; literals need a session, so they are made late."""
    number = all(isinstance(y, int | float) for y in x)
    lits = [F.lit(float(y) if number else y) for y in x]
    return Val("V", F.array(*lits), number) if isinstance(x, list) else Val("S", lits[0], number)


def vals(v):
    return {k: val(x) for k, x in v.items()}


def test_patterns():
    p = parse_pattern("wi/one & !two | three")
    assert p.patterns == ("one", "two", "three") and p.is_or == (False, False, True) and p.is_not == (False, True, False) and p.flags == {"word", "ignore"}
    assert parse_pattern(r"http:\//x").patterns == ("http://x",)
    assert parse_pattern(r"a \& b").patterns == ("a & b",) and parse_pattern(r"\!x").patterns == ("!x",)
    assert parse_pattern("fix, ig/x").flags == {"fixed", "ignore"}
    with pytest.raises(PatternError):
        parse_pattern("Not flags/x")
    with pytest.raises(PatternError):
        parse_pattern("zz/x")


def test_java_patterns():
    assert R.to_java("[[:alpha:]_]+") == r"[\p{Alpha}_]+" and R.to_java(r"\bx") == R.BOUNDARY + "x" and R.to_java("[]a]") == r"[\]a]"
    assert R.java_replacement(r"\1$") == r"$1\$" and R.quote("a.b") == r"a\.b"
    with pytest.raises(PatternError):
        R.to_java(r"a\Kb")


def test_chains():
    assert parse_chain("'a, b'c, 5 first, 3Ko, upper.first, %05i") == [OpCall("c", "a, b"), OpCall("first", "5"), OpCall("Ko", "3"), OpCall("upper", None, ("first",)), OpCall("%", "05i")]
    assert parse_chain("~(sort, ', 'c), if(. > 2 ; upper ; nuke)") == [GroupOps((OpCall("sort"), OpCall("c", ", "))), IfOps(". > 2", "upper", "nuke", False)]
    assert parse_chain("`n`first, `!it's`paste") == [OpCall("first", "n", (), True), OpCall("paste", "it's", (), False)]
    assert split_bar(r"a\|b|c") == ("a|b", "c", False) and split_bar("3||x") == ("3", "x", True)
    for bad in ("'a", "~(sort", "if(a)", "a b !"):
        with pytest.raises(ChainError):
            parse_chain(bad)


def test_templates_parse():
    nodes = parse_template(r"a \{x} {upper ? y}")
    assert nodes[0].text == "a {x} " and nodes[1].body == "y"
    assert expressions("{a} {upper ? b + 1} {'-'c ! x{d}} {& e > 1 ; {f} ; no}") == ["a", "b + 1", "d", "e > 1", "f"]
    assert variables("{upper(a)} {b + c} {a}") == ["a", "b", "c"]
    with pytest.raises(TemplateError):
        parse_template("{a")
    with pytest.raises(TemplateError):
        parse_template("a", ("(", ")"))


@pytest.mark.parametrize(
    "word,forms",
    [("is", ("is", "are")), ("have", ("has", "have")), ("don't", ("doesn't", "don't")), ("want", ("wants", "want")), ("go", ("goes", "go")), ("try", ("tries", "try")), ("play", ("plays", "play")), ("Weren't", ("Wasn't", "Weren't")), ("DO", ("DOES", "DO")), ("arenot", ("is not", "are not")), ("watches", ("watches", "watch")), ("passes", ("passes", "pass")), ("dies", ("dies", "die")), ("uses", ("uses", "use")), ("fix", ("fixes", "fix"))],
)
def test_verbs(word, forms):
    assert conjugate(word) == forms


CASES = [
    ("Hello {C ? x}!", "Hello a, b and c!", dict(x=V("a", "b", "c"))),
    ("{', | et 'c ? x}", "a et b", dict(x=V("a", "b"))),
    ("{'{q ? x} {round(s * 100)}%'table, enum ? x}", "'g' 36%, 'a' 29%, 'f' 21% and 's' 14%", dict(x=V(*"gggggaaaafffss"))),
    ("{'{x}: {n}'table.sort, ', 'c ? x}", "a: 4, f: 3, g: 5, s: 2", dict(x=V(*"gggggaaaafffss"))),
    ("{table.dfsort.sort, ', 'c ? x}", "b (3), u (3), a (2), c (2), e (2)", dict(x=V(*"ubaaccbeebuu"))),
    ("{table.fsort.dsort, ', 'c ? x}", "e (2), c (2), a (2), u (3), b (3)", dict(x=V(*"ubaaccbeebuu"))),
    ("{nth, C ? x}; {Nth, C ? x}; {ntimes, C ? x}; {Ntimes, C ? x}", "1st and 6th; first and sixth; once and 6 times; once and six times", dict(x=V(1, 6))),
    ("{n.l ? 55} {N.up ? 8}", "fifty-five Eight", {}),
    ("{n ? x}", ["45,546", "bonjour"], dict(x=V("45546", "bonjour"))),
    ("{n.R?y} {n.r?y}", "MMXXIII mmxxiii", dict(y=S(2023))),
    ("{len ? x}, {Len.up ? x}, {len.num ? x}", "2, Two, 2", dict(x=V(1, 2))),
    ("{' 'S, ~(len), C ? x}", "3, 2 and 4", dict(x=V("bonjour les gens", "la pluie", "est drue, je rentre"))),
    ("{difftime ? x} {difftime ? y}", "1 hour 00 min 41 min 42 sec", dict(x=S(3654), y=S(2502.95))),
    ("{n} file{#s} {#is} here", "5 files are here", dict(n=S(5))),
    ("{#n.no ? n} file{#s} found", "no file found", dict(n=S(0))),
    ("{$enum ? x} {$don't} agree, {$(he;they)}", "a and b don't agree, they", dict(x=V("a", "b"))),
    ("{#(none;one;several {n ? n}) ? n}", "several 1,200", dict(n=S(1200))),
    ("{& n > 3 ; big {n} ; small}{& n < 3 ; never}", "big 5", dict(n=S(5))),
    ("{/a, b, c}", ["a", "b", "c"], {}),
    ("a{x}b{y}", ["a1bu", "a2bv", "a3bu"], dict(x=V(1, 2, 3), y=V("u", "v"))),
    ("{','s, ~(sort, '-'c), '+'c ? x}", "a-b+c-d", dict(x=V("b,a", "d,c"))),
    ("{if(.nchar > 3 ; upper ; lower), ' 'c ? x}", "ABCD ab", dict(x=V("abcd", "AB"))),
    ("{if('^a' ; nuke), ' 'c ? x}", "bc", dict(x=V("ab", "bc"))),
    ("{if(.N > 2 ; 2 first, '..'insert.right), ' 'c ? x}", "a b ..", dict(x=V("a", "b", "c"))),
    ("{vif(. > 2 ; big {n ? .}), ' 'c ? x}", "1 big 3", dict(x=V(1, 3))),
    ("{enum.i.or ? x}; {enum.3 ? x}; {enum.bq ? y}", "i) a, ii) b, iii) c, or iv) d; a, b and 2 others; `z`", dict(x=V(*"abcd"), y=V("z"))),
    ("{3Ko, ', 'c ? x}; {'2|+:rest:'K, ' 'c ? x}; {2KO, ', 'c ? x}", "a, b, 3 others; a b +3; a, four others", dict(x=V(*"abcde"))),
    ("{'5|..'k ? x} {'5||..'k ? x} {5Shorten ? x}", "abcde.. abc.. abcd..", dict(x=S("abcdefgh"))),
    ("{stop, ws, C ? x}", "tall and young", dict(x=V("He is tall", "He isn't young"))),
    ("{'i/hello => bye'r ? x} {'single/o => 0'r ? x} {'total/W => !'r ? x}", "bye World Hell0 World !", dict(x=S("Hello World"))),
    ("{title ? x} {lower, upper.sentence ? x} {title.force ? x}", "Hey HO Hey ho Hey Ho", dict(x=S("hey HO"))),
    ("{r2 ? x} {s3 ? x} {r0 ? x}", "1,234.57 1,234.5 1,235", dict(x=S(1234.5678))),
    ("{%.3f ? x}|{%05i ? y}|{% 5s ? z}", "3.142|00042|   ab", dict(x=S(3.14159), y=S(42), z=S("ab"))),
    ("{ws.punct.digit ? x}|{tws ? x}|{ws.isolated ? y}", "a b|, a, 12 b!|bc", dict(x=S(", a, 12 b! "), y=S("a bc d"))),
    ("{2 trim.right ? x} {3 firstchar ? x} {-2 lastchar ? x} {1 trim.both ? x}", "abcd abc abcd bcde", dict(x=S("abcdef"))),
    ("{'a|z'insert, ' 'c ? x} {2 each, ''c ? y} {2 times.c ? y}", "a m z aabb abab", dict(x=V("m"), y=V("a", "b"))),
    ("{dsort.num, ' 'c ? x} {sort, ' 'c ? x} {rev, ' 'c ? x}", "10 9 x 10 9 x x 10 9", dict(x=V("9", "10", "x"))),
    ("{':1:. 'paste, ' 'c ? x} {'|:A:'paste, ''c ? x} {'-'append.both, ''c ? x}", "1. a 2. b aAbB -a--b-", dict(x=V("a", "b"))),
    ("{num.rm, ' 'c ? x} {num.clear, ' 'c ? x}", "5 7.5 5  7.5", dict(x=V("5", "b", "7.5"))),
    ("{fill, '+'c ? x}+{'5|0'fill.right, '+'c ? x}+{5 fill.center, '+'c ? x}", "a  +bcd+0000a+00bcd+  a  + bcd ", dict(x=V("a", "bcd"))),
    ("{'1|1'first, ' 'c ? x} {-1 first, ''c ? x} {2 last, ''c ? x} {-3 last, ''c ? x}", "a d bcd cd a", dict(x=V(*"abcd"))),
    ("{'a, b'get.in, ''c ? x} {'^a'is, ' 'c ? x} {'b | c'which, ' 'c ? x}", "ab true false false 2 3", dict(x=V("a", "b", "c"))),
    ("{ascii ? x} {'c'erase ? y} {rm, '+'c ? z} {rm.blank, '+'c ? z}", "ecole Strasse  a+ +b a+b", dict(x=S("école Straße"), y=S("abc"), z=V("a", "", " ", "b"))),
    ("{escape ? x} {q ! a} {Q ! a} {bq ! a}", "a\\nb 'a' \"a\" `a`", dict(x=S("a\nb"))),
    ("{'[[:digit:]]+'X, '-'c ? x} {'[a-z]+'x ? x} {extract.first ? x}", "1-22 a a1", dict(x=S("a1 b22"))),
    ("{unik, ''c ? x} {nuke, len ? x} {head, ''c ? x}", "ab 0 aab", dict(x=V("a", "a", "b"))),
]


@pytest.mark.parametrize("start", range(0, len(CASES), 8))
def test_operators(spark, start):
    cases = CASES[start : start + 8]
    row = spark.range(1).select(*(A.template(t, vars=vals(v)).alias(f"c{k}") for k, (t, _, v) in enumerate(cases))).first()
    for k, (t, want, _) in enumerate(cases):
        assert row[k] == want, t


def test_every_name_of_the_checklist_is_there():
    names = "s S split Split x X extract c C collapse Collapse r R replace clean times each align fill width join escape upper lower q Q bq format Format % erase rm nuke insert append paste k shorten Shorten K head last first firstchar lastchar unik num enum rev sort dsort ascii title ws tws trim get is which n N len Len difftime stopwords nth Nth ntimes Ntimes dp deparse swidth table round signif"
    assert not set(names.split()) - set(BUILTIN)


def test_width(spark):
    text = "Rome, l'unique objet de mon ressentiment, Rome a qui vient ton bras d'immoler mon amant"
    got = spark.range(1).select(A.ops(F.lit(text), "'40|>'swidth")).first()[0]
    assert got.split("\n") == ["> Rome, l'unique objet de mon", "> ressentiment, Rome a qui vient ton", "> bras d'immoler mon amant"]


def test_dates_and_types(spark):
    df = spark.sql("select date'2023-06-23' d, array(1, 12) v, 1.5 x, 'b' s")
    r = df.select(A.ops("d", "'%B %d, %Y'format", df=df), A.ops("v", "n.0, ' 'c", df=df), A.template("{x} {upper ? s} {v}", df=df), A.template("{s}", "{x}", sep="/", df=df), A.template("{s}", "{x}", vectorize=True, collapse="+", df=df)).first()
    assert r[0] == "June 23, 2023" and r[1] == "01 12" and r[2] == ["1.5 B 1", "1.5 B 12"] and r[3] == "b/1.5" and r[4] == "b+1.5"


def test_errors(spark):
    for chain in ("uper", "table.zzz", "~('a'get)", "r"):
        with pytest.raises(ChainError):
            A.ops(F.array(F.lit("a")), chain, array=True)
    with pytest.raises(ChainError, match="upper"):
        A.ops("x", "uper")
    with pytest.raises(TemplateError):
        A.template("{'{zz}'table ? x}", vars=vals(dict(x=V("a"))))


def test_registry(spark):
    a = A.Aliases(delim=(".[", "]"))
    a.register_fun("twice", lambda x, arg, opts: F.concat(x, x))
    a.register_ops("loud", "upper, '!'paste.right")
    assert spark.range(1).select(a.template(".[twice, loud ! ab]")).first()[0] == "ABAB!"
    with pytest.raises(ChainError):
        A.ops("x", "loud")
    with pytest.raises(ChainError):
        a.register_ops("upper", "lower")


def test_column_mode(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "b c,d")], "id int, x string")
    long = C.split_rows(df, "x", "[ ,]", ["id"], pos=True)
    assert [tuple(r) for r in long.orderBy("id", "pos").collect()] == [(1, 1, "a"), (1, 2, "b"), (4, 1, "b"), (4, 2, "c"), (4, 3, "d")]
    back = C.paste_rows(long, "x", ["id"], " ", order_by="pos", last=" & ")
    assert {r["id"]: r["x"] for r in back.collect()} == {1: "a & b", 4: "b c & d"}
    assert C.freq_table(long, "x").filter("x = 'b'").first()["n"] == 2
    assert {r["id"] for r in C.get(df, "x", "!a").collect()} == {2, 3, 4}
    assert C.get(df, "x", "b", "c", seq=True).count() == 3 and C.get(df, "x", "b", "c", seq_unik=True).count() == 2
    values = spark.createDataFrame([("a b",)], "v string")
    assert C.get_in(df, "x", values).first()["id"] == 1 and C.get_in(df, "x", values, negate=True).count() == 3
    assert [r["position"] for r in C.which(df, "x", "b", order_by="id").collect()] == [1, 4]
    assert C.any_match(df, "x", "c").first()["any"] and not C.all_match(df, "x", "c").first()["all"]
    assert {r["x"] for r in C.apply_ops(df, "x", "upper", dedupe=True).collect()} == {"A B", "", None, "B C,D"}


def test_pushdown(spark, tmp_path):
    spark.createDataFrame([("abc", 1)], "x string, y int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = C.get(df, "x", "^ab").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan and "y#" not in plan


def test_sources(spark):
    assert sources.items(r"a, b\, c, {x}", vars={"x": [1, 2]}) == ["a", "b, c", "1", "2"]
    assert sources.matrix("1, 2\n3", numeric=True) == [[1.0, 2.0], [3.0, 3.0]]
    t = sources.table(spark, "id, name\n1, a\n2, b")
    assert t.dtypes == [("id", "double"), ("name", "string")] and t.count() == 2
    assert A.cat(spark, "a {upper ! b}", width=20, leader="> ") == "> a B"


def test_streaming(spark, tmp_path):
    from texloom.streaming import stream_ops, windowed_table

    spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'a b' x union all select timestamp'2024-01-01 00:10:00', 'c'").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, x string").parquet(str(tmp_path / "in"))
    q = windowed_table(stream_ops(s, "x", "upper"), "x", "ts", window="5 minutes", watermark="1 minute").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["x"], r["n"]) for r in spark.sql("select * from counts").collect()} == {("A B", 1), ("C", 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("abc ,", max_size=12), min_size=1, max_size=6))
def test_split_and_paste_round_trip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    back = C.paste_rows(C.split_rows(df, "x", "fixed/,", ["id"], pos=True), "x", ["id"], ",", order_by="pos")
    got = {r["id"]: r["x"] for r in back.collect()}
    assert got == {k: t[:-1] if t.endswith(",") and len(t) > 1 or t == "," else t for k, t in enumerate(texts) if t}


def test_row_mode_equals_column_mode(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"])], "id int, v array<string>")
    a = {r["id"]: r["x"] for r in df.select("id", A.ops("v", "sort, '-'c", df=df).alias("x")).collect()}
    b = {r["id"]: r["v"] for r in C.paste_rows(df.select("id", F.explode("v").alias("v")), "v", ["id"], "-").collect()}
    assert a == b


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["signif_all", "frequent_words_all"])
def test_whole_tables_equal_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for table in ("part", "documents"):
        c.sql(f"create view {table} as select * from '{d}/{table}.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, d).collect()]
    assert got and sorted(got) == sorted(c.sql(SQL[name]).fetchall())


def test_magic(spark):
    x = F.col("x")
    df = spark.createDataFrame([(1, "aab"), (2, "cd"), (3, None)], "id int, x string")
    words = {"two": "a{2}", "all": ["b", "d"]}
    assert [r["id"] for r in df.filter(A.matches(x, "magic/a{2}b")).collect()] == [1]
    assert [r["id"] for r in df.filter(A.matches(x, "{two}", magic=True, vars=words)).collect()] == [1]
    got = df.select(A.replace(x, r"magic, ignore/{'\|'c, upper ? all} => <{upper ! z}>", vars=words).alias("y")).collect()
    assert [r["y"] for r in got] == ["aa<Z>", "c<Z>", None]
    engine = A.Engine({"all": ["b", "d"]})
    assert [r[0] for r in df.select(A.ops(x, "\"magic/{1 first, ''c ? all}\"is", engine=engine)).collect()] == [True, False, False]
    with pytest.raises(PatternError):
        A.matches(x, "magic/{all}", vars=words)


@pytest.mark.parametrize("x,digits,want", [(1.2345e-8, 3, "0.0000000123"), (1234.5678, 6, "1,234.56"), (-0.25, 2, "-0.25"), (3e-25, 1, "0." + "0" * 24 + "3")])
def test_significant_digits_are_cut(spark, x, digits, want):
    assert spark.range(1).select(A.ops(F.lit(x), f"s{digits}", df=spark.range(1))).first()[0] == want


def test_stop_words_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert QUERIES["stopwords_drop"](spark, "/root/testdata/sf0.001").count() == docs.count()


def test_helper_columns_dont_clash(spark):
    df = spark.createDataFrame([("b a", 1, 7), ("c", 1, 8), ("c", 2, 9)], "text string, _pos int, _width int")
    df = df.withColumn("_RN", F.lit(1)).withColumn("_out", F.lit(2)).withColumn("_key", F.lit(3))
    assert [tuple(r) for r in C.split_rows(df.limit(1), "text", " ", ["_pos"], pos=True, out="p").collect()] == [(1, 1, "b"), (1, 2, "a")]
    assert C.split_rows(df, "text", " ", ["_pos", "_width"]).columns == ["_pos", "_width", "text"]
    assert sorted(tuple(r) for r in C.top(df, 1, "text", ["_pos"]).collect()) == [("b a", 1, 7, 1, 2, 3), ("c", 2, 9, 1, 2, 3)]
    assert sorted(r["text"] for r in C.fill_max(df, "text").collect()) == ["b a", "c  ", "c  "]
    assert sorted(tuple(r) for r in C.apply_ops(df, "text", "upper", dedupe=True).collect())[0] == ("B A", 1, 7, 1, 2, 3)
    assert sorted(tuple(r) for r in C.apply_ops(df, "text", "upper", out="_out", dedupe=True).collect())[2] == ("c", 2, 9, 1, "C", 3)


#: All letters come before it.
LAST = 0x32400


def test_sentences_of_all_characters_equal_sql(spark, tmp_path):
    signs = [chr(c) for c in range(LAST) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a. {c}b?7{c}; AB{c} c{c}" for c in signs[k : k + 997]) for k in range(0, len(signs), 997)]
    texts += [None, "", "...", "\n", "ßa. ßb.\x0bßc\r\n!? ß", "ⓐ ⅰͅx. ⓑ", "ΟΔΟΣ ΟΔΟΣ. İİ", "a.b?c!d", "\x00a.\x00b", ".a", "1. \n2 ﬁx"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(path)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/*.parquet'")
    got, want = dict(QUERIES["case_sentence"](spark, str(tmp_path)).collect()), dict(c.sql(SQL["case_sentence"]).fetchall())
    assert len(got) == len(want) == len(texts) and [k for k in got if got[k] != want[k]] == []


def test_case_of_all_characters_equals_sql(spark, tmp_path):
    path = str(tmp_path / "signs.parquet")
    ops = {"lower": "lower(x)", "upper": "upper(x)", "upper.first": "upper(left(x, 1)) || substr(x, 2)"}
    signs = spark.range(LAST).filter("id not between 55296 and 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    signs.select("id", F.concat("c", F.lit("Σß a"), "c").alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    df.select("id", *(A.ops("x", o).alias(o) for o in ops)).write.parquet(str(tmp_path / "got"))
    differ = " or ".join(f'"{o}" is distinct from {sql}' for o, sql in ops.items())
    c = duckdb.connect()
    assert c.sql(f"select count(*), count(*) filter ({differ}) from '{path}/*.parquet' s join '{tmp_path}/got/*.parquet' g using (id)").fetchall() == [(LAST - 2048, 0)]
