import re

import pytest

from netloom.llm.html_text import extract, extract_text, op1_html_text

CASES = [
    ("<p>One<p>Two  <b>bold</b>\n text", "One\n\nTwo bold text"),
    ("<title>t</title><style>p{}</style><script>var a='</p>';</script>Seen<!-- not -->", "Seen"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ol start=3><li>in<li>ner</ol></ul>after", "- x\n- y\n  3. in\n  4. ner\n\nafter"),
    ("<table><tr><th>n<th>value<tr><td>long name<td>1</table>", "n          value\nlong name  1"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>", "A  B\n   C\nD  E"),
    ("<table><tr><td rowspan=3 colspan=2>A<td>B<tr><td>C</table>x", "A  B\n   C\n\nx"),
    ("<table><tr><td colspan=2>wide head<td>x<tr><td>1<td>2<td>3</table>", "wide head  x\n1  2       3"),
    ("<table><tr><td>a<td>b<tr><td><table><tr><td>i</table>c</table>d", "a  b\n\ni\n\nc\n\nd"),
    ("<table><tr><td><ul><li>x<li>y</ul><td><p>one<p>two<tr><td>1<td>2</table>", "- x  one\n- y\n     two\n\n1    2"),
    ("<table><caption>Cap</caption><tr><td>a<td><table><tr><td>i<td>j<tr><td>k<td>l</table></table>", "Cap\na  i  j\n   k  l"),
    ("<table><tr><td>" + "long " * 60 + "<td>b<tr><td>c<td>d</table>", "long " * 59 + "long  b\nc  d"),
    ("<table><tr><td>a<td>b<br>c<td>d<tr><td>e<br>f<td>g</table>", "a  b  d\n   c\ne  g\nf"),
    ("<table><tr><td rowspan=2>1<br>2<br>3<td>a<tr><td>b<tr><td>c<td>d</table>", "1  a\n2  b\n3\nc  d"),
    ("<table><tr><td rowspan=9>1<br>2<br>3<td>a<tr><td>b</table>", "1  a\n2  b\n3"),
    ("<table><tr><td>a<td>b" + "<tr>" + "<td colspan=1000>x" * 3000 + "</table>", "a  b\nx     " + "  ".join("x" * 2999)),
    ("<ol><li value=5>e<li>f<li value=-1>g</ol>", "5. e\n6. f\n-1. g"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ("<pre>a\n  b\n\n c</pre>d", "a\n  b\n\n c\n\nd"),
    ("1 &lt; 2 &amp; 3 < 4 &copy;", "1 < 2 & 3 < 4 ©"),
    ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
    ("<h1>Head</h1>text</div></p>tail<", "Head\n\ntext\n\ntail<"),
    ("<p><a href='x>y'>link</a><img alt=q> <input value=v>z", "link z"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("", ""), ("   ", ""), (None, None), ("<", "<"), ("<p", ""), ("<!-- open", ""),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_cases(source, want):
    assert extract(source) == want


def test_deep_and_long():
    assert extract("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert extract("<ul><li>" * 300 + "x").strip().endswith("x")
    assert len(extract("word " * 200_000).split()) == 200_000
    assert extract("<table>" * 200 + "<tr><td>x").split() == ["x"]


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op1_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:  # every visible word is there, in order
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", pages[r.page_id])
        body = re.sub(r"</?(?:b|a|i|em|strong|span)\b[^>]*>", "", body)
        import html

        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert [w for w in r.text.split() if w != "-"] == [w for w in want if w != "-"]


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t"), (None, "<p>x", "t")], "page_id long, html string, text string")
    assert [(r.page_id, r.text) for r in extract_text(rows).collect()] == [(1, None), (2, ""), (2, ""), (None, "x")]
    assert extract_text(rows.filter("false")).collect() == []
