import duckdb
import pytest

from texloom.llm import html_extract as op1, perspectives as op7
from tests.llm.fixtures import ordered

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="has-sidebar"><div class="site-header"><a href=/>Home</a> Logo of the site.</div><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies, really. Accept all of them now.</div>
<div><article><h1>The title</h1><p>First &amp; long paragraph, with several   sentences.<br> It goes on, and on.<p><b>Second one, which isn't closed. Also long, yes.
<ul><li>one</li><li>two, item</ul><aside>Related, but elsewhere.</aside><form><p>Sign up, now.</p></form></article></div>
<div id="comments"><p>Great article! I liked it, a lot. Truly.</p></div><div class="ad">Buy this, now.</div><footer>&copy; us.</footer></body></html>"""


def test_extraction():
    want = "The title\nFirst & long paragraph, with several sentences. It goes on, and on.\nSecond one, which isn't closed. Also long, yes.\none\ntwo, item"
    assert op1.extract_text(PAGE) == want


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\nb"), ("<div>x <!-- y", "x"), ("<script>z", ""), ("a < b <", "a < b <"), ("<p>" * 300 + "deep", "deep")])
def test_broken_pages(html, text):
    assert op1.extract_text(html) == text


def test_all_content_of_a_page():
    p = "<p>A long paragraph, with several sentences. It goes on, and on, for a while, and says little.</p>"
    lead = "<p>A lead, beside the post, that is content as well. It has its own sentences, two of them.</p>"
    assert op1.extract_text(f"<body><div id=content><div>{lead}</div><div class=post>{p * 8}</div></div></body>").startswith("A lead")
    two = op1.extract_text(f"<body><article>{p * 6}</article><article><p>The second one.</p>{p * 4}</article></body>")
    assert "The second one." in two and two.count("A long") == 10
    linked = "<p><a href=x>A paragraph that is one link, in the text, of some length.</a></p>"
    assert "one link" in op1.extract_text(f"<body><article>{p * 4}{linked}{p * 4}</article></body>")


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)]
    out = op1.extract(spark.createDataFrame(rows, "page_id long, url string, html string, other string")).collect()
    assert ordered(r["text"] for r in out) == ordered([op1.extract_text(PAGE)] * 2 + [""])


def chats():
    rows = [(1, 0, "system", "Rules."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé 😀"), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye"), (2, 0, "user", None), (2, None, None, "x"), (3, 0, "system", "alone"), (None, 5, "a", ""), (None, 5, "", "b")]
    rows += [(9, k, "ab"[k % 2], "t" * (k % 5)) for k in range(1500)]
    return rows


def test_perspectives_equal_sql(spark):
    df = spark.createDataFrame([(*r, r[3]) for r in chats()], "conv_id long, turn long, role string, text string, segment string")
    c = duckdb.connect()
    c.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", chats())
    want = c.sql(op7.ORACLE_SQL)
    names = want.columns
    out = op7.rotate(df, run=64)
    assert ordered(tuple(r) for r in out.select(*names).collect()) == ordered(want.fetchall())
    one = op7.render(out.filter("conv_id = 1 and perspective = 'ann'")).first()
    assert one["rendered"].startswith("<|system|>\nRules.\n<|assistant|>\nHi\n<|user name=bob|>\n")
    assert [one["rendered"][a:b] for a, b in one["learn_spans"]] == ["Hi", "Bye", "Bye"]


def test_no_turns(spark):
    assert op7.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_main_path_is_native(spark):
    plan = op7.rotate(spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
