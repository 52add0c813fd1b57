import pytest

from netloom.llm.html_text import extract

CASES = [
    ('<div style="backface-visibility:hidden">card</div>x', "card\nx"),
    ('<div style="color:red; VISIBILITY : hidden">no</div>x', "x"),
    ('<div style="visibility:hidden">no <b style="visibility:visible">yes</b> no</div>x', "yes\nx"),
    ('<div style="visibility:collapse"><p>no<p style="visibility: visible !important">yes</div>x', "yes\n\nx"),
    ('<div style="display:none"><b style="visibility:visible;display:block">no</b></div>x', "x"),
    ('<p style="display:none;display:block">yes</p>x', "yes\n\nx"),
    ('<p style="/* display:none */">yes</p>x', "yes\n\nx"),
    ('<table style="visibility:hidden"><tr><td>no<td style="visibility:visible">yes</td></tr></table>x', "  yes\n\nx"),
    ("a <svg><text>label</text></svg> <math><mi>y</mi><mo>=</mo><mn>2</mn></math>", "a label y=2"),
    ("<svg><defs><text>no</text></defs><text>a</text><text>b</text></svg><math><mi>z</mi><annotation>no</annotation></math>", "a bz"),
    ('a<span style="display:block">b</span>c', "a\nb\nc"),
    ('<div style="display:flex">a</div><div style="display:inline">b</div><div style="display:inline">c</div>', "a\nbc"),
    ('<p style="display:inline">a</p> <p style="display:inline">b</p>', "a b"),
    ('<ul><li style="display:inline">a</li> <li style="display:inline">b</li></ul>c', "a b\n\nc"),
    ('<ul><li><ul><li style="display:inline">a</li></ul><li>b</ul>', "- a\n- b"),
    ('<table><tr><td style="display:inline">a<td>b</table>', "a  b"),
    ("<textarea>t</textarea><button>go</button>", "t go"),
    ("press<button> go </button>now<select><option>x</select>y", "press go now\nx\ny"),
    ("<details><summary>head</summary>folded<p>away</details>x", "head\nx"),
    ("<details open><summary>head</summary>seen</details>x", "head\nseen\nx"),
    ("<details>folded<table><tr><td>t</table></details>x", "x"),
    ("<style>.no{color:red;display:none}</style><p class='a no'>no</p><p class=none>yes", "yes"),
    ("<style>/* .a{display:none} */ p.no, #x , li{ visibility:hidden }</style><div class=no>yes</div><p class=no>no<div id=x>no <b style='visibility:visible'>b</b></div><ul><li>no</ul>", "yes\n\nb"),
    ("<style>.a{display:none} div.a{display:block} #k{display:none!important}</style><p class=a>no</p><div class=a>yes</div><div class=a id=k style='display:block'>no</div>", "yes"),
    ("<style>.a{display:none}.a{display:block}</style><span class=a>x</span><span class=a>y</span>", "x\ny"),
    ("<style>.a{display:none}</style><p class=a style='display:block'>own</p><span class=a>no", "own"),
    ("<style>@media print{.a{display:none} .b{x:y}} @import 'z'; nav .b{display:none} .c:hover{display:none} .d{display:none</style><p class=a>a<p class=b>b<p class=c>c<p class=d>d", "a\n\nb\n\nc"),
    ("<style media=print>p{display:none}</style><style>b{display:none}{}}}@{</style><p>a<b>no</b>z", "az"),
    ("<style>td.no{display:none}</style><table><tr><td>a<td class=no>no<td>b</table>", "a  b"),
    ("<svg><title>t</title><style>p{}</style><text>in</text></svg>", "in"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_visibility(source, want):
    assert extract(source) == want


def test_long_sheets():
    assert extract("<style>" + "@media x{" * 50_000 + "</style>a") == "a"
    assert extract("<style>" + "{" * 100_000 + ".a{" * 50_000 + "</style>a") == "a"
    sheet = "".join(f".c{i}{{display:none}}" for i in range(30_000))
    assert extract(f"<style>{sheet}</style>" + "".join(f"<i class='c{i} d'>no</i>" for i in range(30_000)) + "yes") == "yes"
    crowd = "".join(f"p.a.b{i}{{display:none}}" for i in range(20_000))
    assert extract(f"<style>{crowd}</style>" + "<p class='a b7'>no</p><p class='a'>yes</p>" * 2_000).split() == ["yes"] * 2_000
