import html
import re
from collections import Counter

from trialnum.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="nav-open"><nav><ul><li>Home</ul></nav><div class="top-banner">Buy <div>now</div></div><!-- <p>no</p> -->
<article class="post"><h1>A &amp; B</h1><p><b>One<br>two&nbsp;three <i>fo</i>ur<p>Five <a href="x>y">six</a>
<aside>Side</aside><form>Mail <input name=a> me</form><span class='ad'>Ad <span>in</span> text</span><p class="notice">Note<p>Seven</p><noscript>js</noscript>
<div id="comments"><article>Reader</article></div></article><footer>&copy; us</footer>tail"""


def text_of(page):
    return " ".join(" ".join(w) for region, w in html_text.blocks(page) if region == "main")


def test_structure():
    assert text_of(PAGE) == "A & B One two three four Five six Seven"
    assert html_text.blocks(None) == [] and html_text.blocks("a < b") == [("open", ["a", "<", "b"])]
    assert [w for _, w in html_text.blocks("<p title='open>x</p><p>y")] == [["x"], ["y"]]


def test_pages_of_the_tables(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    rows = {r.id: r for r in html_text.main_texts(df).collect()}
    for r in df.collect():
        body = r.html[r.html.index("<article>") : r.html.find("</article>")]
        blocks = re.split(r"</?(?:article|p|h1|br)>", body)
        want = " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks if re.sub(r"<[^>]*>", "", b).strip())
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want)


def test_repeated_runs_leave_pages_without_an_article(spark):
    foot = "all about our little site and its many friends of old"
    pages = [(i, "https://u@A.org:80/p", f"<div>{foot}</div><p>mine{i} words{i} of page{i}</p><p>{foot} more{i}") for i in range(4)]
    pages += [(9, "https://b.org/", f"<p>{foot}</p>"), (10, None, None), (10, None, None), (11, "x", "<article></article>"), (12, "//a.org", "long " * 100_000)]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, text string, row int")
    rows = html_text.main_texts(df).collect()
    got = Counter((r.id, r.text) for r in rows)
    want = Counter((i, f"mine{i} words{i} of page{i} more{i}") for i in range(4))
    want += Counter({(9, foot): 1, (10, ""): 2, (11, ""): 1, (12, ("long " * 100_000).strip()): 1})
    assert got == want and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.main_texts(df.where("false")).count() == 0


def test_runs_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    streams = [(i, rng.choice("ab"), i, [rng.choice("xyz") for _ in range(rng.randrange(30))]) for i in range(30)]
    got = {(r.row, r.start) for r in html_text.repeated_runs(spark.createDataFrame(streams, "row long, host string, page long, words array<string>"), 3, 3).collect()}
    seen = {}
    for row, host, page, w in streams:
        for s in range(len(w) - 2):
            seen.setdefault((host, *w[s : s + 3]), set()).add(page)
    assert got == {(row, s) for row, host, _, w in streams for s in range(len(w) - 2) if len(seen[(host, *w[s : s + 3])]) >= 3}


def test_class_of_a_wrapper_does_not_empty_the_page():
    for mark in ("class='layout with-sidebar'", "class='no-sidebar'", "class=has-header", "id='page-header-content'", "class='sidebar'", "id=header"):
        assert text_of(f"<div {mark}><article>Kept <b>text</b></article>rest</div>") == "Kept text"
    assert text_of("<article class='comments-open'>Kept</article>") == "Kept"
    assert text_of("<div class='comments'><article>Reader</article></div><article class='comment'>Too</article>") == ""
    assert html_text.blocks("<div class='sidebar'>a<p class=ad>b</p>c</div>d") == [("chrome", ["a"]), ("chrome", ["b"]), ("chrome", ["c"]), ("open", ["d"])]


def test_blocks_that_most_articles_of_a_host_repeat_go(spark):
    note = "<p>Sign up today to get all of our best stories by mail</p>"
    links = "".join(f"<li>Link {k}</li>" for k in range(5))  # ten words in five blocks
    quote = "<p>to be or not to be that is the question he said</p>"
    story = lambda i: "".join(f"<p>{' '.join(f'w{i}x{k}y{j}' for j in range(20))}</p>" for k in range(3))
    pages = [(i, "http://a/p", f"<article>{note}{story(i)}{links}{quote * (i < 3)}</article>") for i in range(12)]
    pages += [(20, "http://b/p", f"<article>{note}{story(20)}</article>")]  # another host repeats nothing
    copies = "".join(f"<p>{' '.join(f'c{k}y{j}' for j in range(20))}</p>" for k in range(4))
    pages += [(30 + i, "http://c/p", f"<article>{copies}<p>near copy {i}</p></article>") for i in range(12)]
    pages += [(50 + i, "http://d/p", f"<article>{note}{story(9)}</article>") for i in range(12)]  # equal articles are one
    pages += [(70 + i, "http://e/p", f"<article>{note}{story(i)}</article>") for i in range(5)]  # a small host may share a line
    rows = {r.id: r for r in html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, page in pages:
        want = page if i >= 20 else page.replace(note, "").replace(links, "")
        assert rows[i].text == " ".join(re.sub(r"<[^>]*>", " ", want).split()) and rows[i].n_chars == len(rows[i].text), i


def test_runs_of_whole_blocks():
    parts = [["a"], ["b", "c"], ["d", "e", "f"], ["g"]]
    assert [r[:2] for r in html_text.block_runs("h", parts, 3)] == [(0, 2), (1, 3), (2, 3)]
    assert html_text.block_runs("h", parts, 8) == [] and html_text.block_runs("h", [], 3) == []
    keys = [html_text.block_runs(h, p, 2)[0][2] for h, p in (("h", [["a", "b"]]), ("g", [["a", "b"]]), ("h", [["a"], ["b"]]), ("h", [["a", "b"]]))]
    assert keys[0] == keys[3] and len(set(keys)) == 3
