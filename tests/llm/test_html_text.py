import time

from tarnlake.llm.html_text import extract, main_text

P = "This is a sentence of the article, long enough to count, with commas. " * 3


def test_article_without_surroundings():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, of course, and you must accept them all.</div>
    <div class="page with-sidebar"><article><header><h1>Head &amp; line</h1><p>By someone</p></header><p><b>{P}<br>more<p>2 &lt; 3 &eacute;&#x41;&nbsp; x</p>
    <div class="advert">Buy now, buy cheap, buy more of this and that.</div><!-- no <p>x</p> --><blockquote>Quoted words</blockquote></article>
    <aside>{P}</aside><form><label>Mail</label><input><button>Go</button></form></div>
    <div id="comments"><article class="comment"><p>{P}</p></article></div><footer>&copy; 2024 {P}</footer></body></html>"""
    assert main_text(html) == "\n\n".join(["Head & line", " ".join(P.split()) + " more", "2 < 3 éA x", "Quoted words"])


def test_no_article_element():
    html = f"<body><div id=menu><a href=a>A</a></div><h1>Head</h1><div class=story><p>{P}</p><p>{P}</p><ul><li><a>x y</a><li><a>z w</a></ul></div><div class=foot><a>Imprint</a></div>"
    assert main_text(html) == "\n\n".join(["Head", P.strip(), P.strip()])


def test_whole_main_and_own_links():
    long, links = " ".join((P * 2).split()), "<ul><li><a href=x>A source of this article</a><li><a href=y>Another source</a></ul>"
    section = "<section>" + f"<p>{long}</p>" * 10 + "</section>"
    html = f"<body><nav>Menu</nav><main>{section}<section><h2>Sub</h2><p>{long}</p></section><h2>End</h2><p>Short one.</p><div class=related>{links}</div></main><div><a>Imprint</a></div>"
    assert main_text(html) == "\n\n".join([long] * 10 + ["Sub", long, "End", "Short one."])
    sources = ["Sources", "A source of this article", "Another source"]
    for tag in ("article", "main"):
        assert main_text(f"<body><{tag}><p>{long}</p><h2>Sources</h2>{links}<nav>{links}</nav></{tag}>") == "\n\n".join([long, *sources])
    # articles in one container that has no name
    assert main_text(f"<body><div><article><p>{long}</p><h2>Sources</h2>{links}</article></div>") == "\n\n".join([long, *sources])


def test_odd_input():
    assert main_text(None) == main_text("") == main_text("<p></p><script>x") == ""
    assert main_text("just text &am") == "just text &am"
    assert main_text("<p>a < b <a href='x") == "a < b"
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 3) == "deep"
    assert main_text("<form><p>" + P + "</p></form>") == P.strip()
    assert main_text("<table><tr><td>one<td>two<tr><td>three</table>") == "one\n\ntwo\n\nthree"


def test_time_grows_with_the_page():
    """Pages whose open tags were once searched over and over."""
    for make in (lambda n: "<i><div>" + "<b>" * n + "x" + "</i>" * n, lambda n: "<p>" + "<b>" * n + "<div>y</div>" * n, lambda n: "<table>" + "<b>" * n + "<tr><td>z" * n, lambda n: "<ul>" + "<i>" * n + "<li>w" * n):
        began = time.perf_counter()
        assert main_text(make(40_000))
        assert time.perf_counter() - began < 5


def test_frame(spark):
    rows = [(1, "u", "<p>a  b</p>", 3), (None, None, None, 4), (1, "u", "<p>a  b</p>", 3), (2, "u", "<p>" + "x " * 300_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(df).select("row.page_id", "row.text", "text", "n_chars").collect()
    assert [(r[0], r[1], r[3]) for r in sorted(got, key=lambda r: (r[3], r[0] or 0))] == [(None, 4, 0), (1, 3, 3), (1, 3, 3), (2, 1, 599_999)]
    assert extract(df.limit(0)).count() == 0
