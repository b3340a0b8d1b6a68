import random
import re
import time

import pytest

from pagequarry.llm import html_text as H

CASES = {
    "<p>one<p>two": "one\n\ntwo",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ul><li>c</ul></ul>d": "- a\n- b\n  - c\n\nd",
    "<ol start=3><li>x</li><li>y</ol>": "3. x\n4. y",
    "<table><tr><th>name<th>n<tr><td>long name<td>1</table>": "name       n\nlong name  1",
    "<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>": "a     b\nc  d  e",
    "<p>x &amp; y &lt;z&gt; &eacute;&#233;": "x & y <z> éé",
    "<pre> a\n  b\n</pre>c": " a\n  b\n\nc",
    "<head><title>t</title></head><body>b<script>var x = '<p>';</script><style>p{}</style>": "b",
    "<p hidden>a</p><p style='display: none'>b</p><p style=\"Visibility:hidden\">c</p>d": "d",
    "<div>a<!-- b --><span> c </span> d</div>": "a c d",
    "<p>a</b></div></p>b": "a\n\nb",
    "<a href='x>y'>k</a>": "k",
    "<h1>T</h1>text<blockquote>q</blockquote>": "T\n\ntext\n\n  q",
    "<dl><dt>a<dd>b<dt>c<dd>d</dl>": "a\n  b\nc\n  d",
    "<img alt='pic'> <input type=hidden value=no><input type=submit value=Go>": "pic Go",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<p>a <b>b</b><i>c</i>": "a bc",
    "": "",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>": "x=2",
    "<svg><title>t</title><text>a</text><text>b</text></svg>": "a\nb",
    "<object>shown</object><object data=x>kept back</object>": "shown",
    "<xmp><b>&amp;</b></xmp>c": "<b>&amp;</b>\n\nc",
    "a<plaintext>b<c>d": "a\n\nb<c>d",
    "<input type=number value=5> <input type=email value=a@b.c> <input type=password value=no> <input placeholder=name> <textarea placeholder=here></textarea>": "5 a@b.c name here",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>": "b",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>a<td rowspan=3>b<td>x<tr><td>c<td>y<tr><td colspan=2>d<td>z</table>": "a  b  x\nc     y\nd     z",
    "<table><tr><form action=x><td>a</td><td>b</td></form></tr></table>": "a  b",
    "<table><tr><a href=x><td>a</td></a></tr></table>": "a",
    "<table><tr>loose text</tr><tr><td>a</table>": "loose text\na",
    "<table><tr><table><tr><td>in</table></tr></table>": "in",
    "<style>.x,p>i{display:none} #k{visibility:hidden} b.y{display:none} @media print{em{display:none}} @media screen{u{display:none}}</style><p>a<i>b</i><span><i>c</i></span><b class='y z'>d</b><b>e</b><em>f</em><u>g</u><s id=k>h</s><s class=x>i</s>": "acef",
    "<style>p{display:none} .on{display:block}</style><p>a<p class=on>b<p style='display:inline'>c": "b\n\nc",
    "<style>i{display:none!important}</style><i style='display:inline'>a</i>b<span hidden style='display:inline'>c</span>": "bc",
    "<span style='display:block'>a</span><span style='display:block'>b</span>": "a\nb",
}


@pytest.mark.parametrize("html", CASES)
def test_rendering(html):
    assert H.to_text(html) == CASES[html]


def test_hostile_markup_ends():
    assert H.to_text("<div>" * 20000 + "x") == "x"
    assert "y" in H.to_text("<a '" * 200 + "> y")
    assert H.to_text("<script>never closed") == ""
    assert H.to_text("<!-- never closed") == ""
    assert H.to_text(None) is None


def test_table_of_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (3, "v", ""), (1, "u", "<p>a")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["text"]) for r in H.extract(df).collect()), key=str)
    assert got == [(1, "a"), (1, "a"), (2, None), (3, "")]
    assert H.extract(df.limit(0)).count() == 0


def test_wide_columns_are_aligned_and_blanks_stay_in_proportion():
    lines = H.to_text("<table><tr><td>" + "x" * 90 + "<td>b<tr><td>y<td>c</table>").split("\n")
    assert lines[0].index("b") == lines[1].index("c") == 92
    out = H.to_text("<table><tr><td>" + "x" * 100_000 + "<td>b" + "<tr><td>y<td>c" * 5000 + "</table>")
    assert out.count("y") == 5000 and len(out) < 20 * 110_000


def test_long_page_and_clashing_columns(spark):
    html = "<p>word " + "<b>x</b> y " * 50_000
    df = spark.createDataFrame([(2**60 + 1, "u", html, "z"), (None, "u", "<p>a", "z")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert set(got) == {2**60 + 1, None} and got[None] == "a" and got[2**60 + 1].split() == ["word"] + ["x", "y"] * 50_000


BLOCKS, INLINE, NOT_SHOWN = ["p", "div", "section", "h2", "blockquote", "ul", "li", "dl", "dd"], ["b", "i", "span", "a", "math", "custom-tag"], ["<script>{}</script>", "<style>.{} {{color:red}}</style>", "<template>{}</template>", "<div hidden>{}</div>", "<span style='display:none'>{}</span>", "<b class=off>{}</b>", "<!-- {} -->", "<i style='visibility:hidden'>{}</i>"]


def make_page(rng, words, depth=0):
    """Markup, and the words of it that are seen, in order."""
    html, seen = "", []
    for _ in range(rng.randint(1, 4)):
        k = rng.random()
        if depth > 4 or k < 0.4:
            word = next(words)
            html, seen = html + f" {word} ", [*seen, word]
        elif k < 0.55:
            html += rng.choice(NOT_SHOWN).format(next(words))
        elif k < 0.65:
            rows = [[make_page(rng, words, 5) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
            html += "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c, _ in r) for r in rows) + "</table>"
            seen += [w for r in rows for _, s in r for w in s]
        else:
            tag = rng.choice(BLOCKS if k < 0.85 else INLINE)
            inner, more = make_page(rng, words, depth + 1)
            html, seen = html + f"<{tag}>{inner}</{tag}>", seen + more
    return html, seen


@pytest.mark.parametrize("seed", range(60))
def test_all_visible_words_come_out_in_order(seed):
    words = (f"w{i}" for i in range(10**6))
    html, seen = make_page(random.Random(seed), words)
    assert re.findall(r"w\d+", H.to_text("<style>.off{display:none}</style>" + html)) == seen


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a<!-->b<p>rest", "ab\n\nrest"),
        ("a<!--->b", "ab"),
        ("a<!-- c --!>b", "ab"),
        ("a<!-- > -> c -->b", "ab"),
        ("a<!---->b", "ab"),
        ("a<!-- open <p>b", "a"),
        ('<p title="a>b" x=\'>\'>c</p>', "c"),
        ('<a b"c>d</a>', "d"),
        ("<a href=\"x'y\">e</a>", "e"),
        ('f<a title="never>g', "fg"),
        ("1 < 2 <3", "1 < 2 <3"),
        ("h<b", "h<b"),
    ],
)
def test_comments_and_quotes_end_as_browsers_end_them(html, want):
    assert H.to_text(html) == want


def test_selectors_of_many_ancestors():
    """Chains and descendants against a search of all choices, and in time that doesn't grow with the choices."""
    def plain(steps, node, above):
        def rest(i, k):
            if i == len(steps):
                return True
            if steps[i - 1][0] == ">":
                return k > 0 and H.Selector.fits(steps[i][1], above[k - 1]) and rest(i + 1, k - 1)
            return any(H.Selector.fits(steps[i][1], above[j]) and rest(i + 1, j) for j in range(k))

        return H.Selector.fits(steps[0][1], node) and rest(1, len(above))

    rng = random.Random(5)
    for _ in range(3000):
        s = H.Selector("".join(rng.choice("ab*") + rng.choice([" ", " > ", ">"]) for _ in range(rng.randint(0, 5))) + rng.choice("ab"))
        path = [H.Node(rng.choice("abc"), {}) for _ in range(rng.randint(1, 7))]
        assert s.matches(path[-1], path[:-1]) == plain(s.steps, path[-1], path[:-1])
    began = time.time()
    H.to_text("<style>.nope div div div div div div div p{display:none}</style>" + "<div>" * 200 + "<p>x" * 100)
    assert time.time() - began < 5


@pytest.mark.parametrize("part", ["<a ", "<a x='", '<a x="', "<!--", "<", "</", "<b>", "<a =", "<td>", "<a x=\"'", "&", "<p x=>", "<!-- --!"])
def test_hostile_pages_take_linear_time(part):
    def seconds(n):
        began = time.time()
        H.to_text(part * (n // len(part)))
        return time.time() - began

    seconds(20_000)
    assert seconds(400_000) < 6


def test_cells_keep_their_lines():
    page = "<table><tr><td><p>one</p><p>two</p><ul><li>x<li>y</ul></td><td>side<br>by</td></tr><tr><td>short</td><td>end</td></tr></table>after"
    assert H.to_text(page).split("\n") == ["one    side", "       by", "two", "", "- x", "- y", "short  end", "", "after"]
    layout = "<table><tr><td><h1>Title</h1><p>First paragraph.</p><pre>a\n  b</pre><table><tr><td>k</td><td>v</td></tr><tr><td>long key</td><td>w</td></tr></table></td></tr></table>"
    text = H.to_text(layout)
    assert "First paragraph." in text.split("\n") and "  b" in text.split("\n") and "k         v" in text.split("\n") and "long key  w" in text.split("\n")
