"""The HTML tokeniser: states, references, and properties over any text."""

import html
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clickloom.functions import markup, text
from clickloom.operators import clean


@pytest.mark.parametrize(
    "source, shown",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a</p><p> b </p>", ["a", "b"]),
        ('<a title="1 > 0">x</a>', ["x"]),
        ("<a title='1 > \" 0' b=c>x</a>", ["x"]),
        ("<a title = 'y>z'>x", ["x"]),
        ('<a b=c"d>e', ["e"]),
        ('a<b title="open>never closed', ["a"]),
        ("a<b", ["a"]),
        ("1 < 2 and 3 <4 <", ["1 < 2 and 3 <4 <"]),
        ("<!-- c > c -->a<!---->b<!-->c<!-- d --!>e<!-- open > f", ["a", "b", "c", "e"]),
        ("<!doctype html><?php x ?>a</>b</ p>c</p x='>'>d", ["a", "b", "c", "d"]),
        ("<script>if (a < b) '</p>' </scripty> </script >x", ["x"]),
        ("<STYLE>p > a</Style>x<style>open", ["x"]),
        ("<template><p>no</p></template>x", ["x"]),
        ("<title>a <b> &amp; c</title>d<textarea></textareas></textarea>e", ["a <b> & c", "d", "</textareas>", "e"]),
        ("<scripts>seen</scripts></script>", ["seen"]),
        ("&lt;b&gt; &amp;lt; &notit; &notin; &AMP &amp", ["<b> &lt; ¬it; ∉ & &"]),
        ("&#0; &#x110000; &#xD800; &#128; &#x81; &#99999999999999;", ["� � � € \x81 �"]),
        ("&; &#; &#x; & &unknown; &fjlig;", ["&; &#; &#x; & &unknown; fj"]),
    ],
)
def test_states(source, shown):
    assert markup.shown_texts(source) == shown


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.sampled_from("&#xX;0123aAmnotlgtquPLE <"), max_size=40))
def test_references_equal_the_standard_ones(source):
    assert markup.decode_references(source) == html.unescape(source)


@given(st.text(max_size=60))
def test_escaped_text_comes_back(source):
    assert " ".join(markup.shown_texts(f"<p title='{html.escape(source)}'>{html.escape(source)}</p>")) == source.strip() or "\x00" in source or any("\x7f" < c < "\xa0" for c in source)


class _Texts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.run = [], ""

    def handle_data(self, data):
        self.run += data

    def handle_starttag(self, tag, attrs):
        self.cut()

    def handle_endtag(self, tag):
        self.cut()

    def cut(self):
        if self.run.strip():
            self.out.append(self.run.strip())
        self.run = ""


WELL_FORMED = st.recursive(
    st.text(alphabet="ab é&<>'\"", max_size=8).map(html.escape),
    lambda inner: st.tuples(st.sampled_from(["p", "b", "div", "a"]), st.text(alphabet="x>'<= ", max_size=6), inner, inner).map(lambda t: f'<{t[0]} k="{html.escape(t[1], quote=True).replace("&gt;", ">")}">{t[2]}</{t[0]}>{t[3]}'),
    max_leaves=8,
)


@settings(deadline=None)
@given(WELL_FORMED)
def test_well_formed_markup_is_read_as_by_a_parser(source):
    parser = _Texts()
    parser.feed(source)
    parser.close()
    parser.cut()
    assert markup.shown_texts(source) == parser.out


@pytest.mark.parametrize("source", ["<" * 200_000, "<a " * 100_000, "<a b='" * 100_000, "<!--" * 100_000, "&" * 300_000, "&#" * 200_000, "<a " + "x=y " * 100_000, "<script>" * 50_000, "<textarea>" * 20_000])
def test_long_odd_markup_takes_little_time(source):
    began = time.perf_counter()
    markup.shown_texts(source)
    assert time.perf_counter() - began < 3


def test_columns(spark):
    df = spark.createDataFrame([("<p>a</p>b",), (None,), ("",), ("&lt;p&gt;a&amp;lt;",)], "t string")
    assert [r[0] for r in df.select(markup.visible_text(F.col("t"))).collect()] == ["a b", None, "", "<p>a&lt;"]
    assert [r[0] for r in df.select(markup.visible_of_escaped(F.col("t"))).collect()] == ["a b", None, "", "a<"]


def test_tables_are_cleaned_by_states(spark):
    rows = [('<a title="1 > 0">Caf&eacute;</a>, good', "B1 &amp; B2", "12 in X", "unknown"), (None, "unknown", None, "<b>fine</b>")]
    df = spark.createDataFrame(rows, "title string, also_buy string, rank string, description string")
    got = clean.clean_table(df, visible=markup.visible_of_escaped).collect()
    assert tuple(got[0]) == ("Café , good", "B1, B2", "12", "unknown") and tuple(got[1]) == ("unknown", "unknown", None, "Fine")
    plain = df.select("also_buy")
    assert clean.clean_table(plain).collect() == clean.clean_table(plain, visible=markup.visible_of_escaped).collect()


def test_references_that_a_cut_left_stay_where_asked():
    source = "<title>a &amp;&quot</title>b &amp &#66 c &notit; &#68<i>d</i> &copy"
    assert markup.shown_texts(source, cut_stay=True) == ["a &&quot", "b & B c ¬it; &#68", "d", "&copy"]
    assert markup.shown_texts(source) == ['a &"', "b & B c ¬it; D", "d", "©"]
    assert markup.decode_references("&lt;b&gt;x&amp</b>", cut_stay=True) == "<b>x&amp</b>"


def test_pages_cut_within_references_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from clickloom.plans import queries_text

    rows = [(1, "u", "<title>x&amp;&amp</title><h1>y &amp; z&quot</h1>&copy;"), (2, "u", "<p>&middot; a&am</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_clean_parsed", "html_visible_text"):
        query, sql = queries_text.QUERIES[name]
        got, want = query(spark, str(tmp_path)), con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_imputation_takes_any_nesting(spark):
    df = spark.createDataFrame([({"a": [{"b": ["x", ""]}]}, [["p"], ["q", None]], ["1 in X (see)"])], "details map<string,array<map<string,array<string>>>>, category array<array<string>>, rank array<string>")
    assert tuple(clean.impute(df).first()) == ("a: b: x", "p and q", "1 in X")
    assert text.MAX_DEPTH == 50
