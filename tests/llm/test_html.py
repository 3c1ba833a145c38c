import random

from helpers import by_id

from hunkledger.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad top">Buy</div><header>Site</header><aside>Side</aside>
<article><h1>Head &amp; more</h1><p><b>First   line<br>goes
on<p>Second<div class="comments"><p>A reader</p></div><form>Send</form><!-- <p>no</p> --><pre>a  b</pre>tail &eacute;</article>
<footer>&copy; x</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article(spark):
    cut = PAGE[: PAGE.index("Second") + 3]
    rows = [(1, "http://h/x/1", PAGE), (2, "http://h/x/2", PAGE), (3, None, PAGE), (4, "http://h/x/3", None), (5, "odd", ""), (6, "http://h/x/9", cut), (6, "http://h/x/9", cut), (None, "http://h/x/9", "<p>a < b &am")]
    out = html.extract(pages(spark, rows))
    got = by_id(out, "text", "n_chars", key="page_id")
    whole = "Head & more\n\nFirst line goes on\n\nSecond\n\na b\n\ntail é"
    assert got[1] == got[2] == got[3] == (whole, len(whole))
    assert got[4] == got[5] == ("", 0)
    assert got[6][0] == "Head & more\n\nFirst line goes on\n\nSec"
    assert got[None][0] == "a < b &am"
    assert out.count() == len(rows)
    assert html.extract(pages(spark, [])).count() == 0


def test_template_lines_go_without_an_article(spark):
    page = "<body><div>Menu line</div><div>{}</div><div>All about us</div></body>"
    rows = [(i, f"http://h/p/{i}", page.format(f"own text {i}")) for i in range(5)] + [(9, "http://other/p", page.format("alone"))]
    got = by_id(html.extract(pages(spark, rows)), "text", key="page_id")
    assert got == {**{i: (f"own text {i}",) for i in range(5)}, 9: ("Menu line\n\nalone\n\nAll about us",)}


def test_many_ranges_and_extra_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://hot/p/{i:04d}", f"<article><p>t{i}</p></article>") for i in range(300)]
    df = pages(spark, rows).withColumn("text", F.lit("old")).withColumn("extra", F.array(F.lit(1)))
    out = html.extract(df, range_pages=40)
    assert by_id(out, "text", "n_chars", key="page_id") == {i: (f"t{i}", len(f"t{i}")) for i in range(300)}
    assert [r["extra"] for r in out.limit(1).collect()] == [[1]]


def test_longest_common_subsequence():
    chance = random.Random(1)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        return row[-1]

    for _ in range(200):
        a, b = ([chance.randrange(4) for _ in range(chance.randrange(9))] for _ in range(2))
        kept = html.shared(a, b)
        assert len(kept) == length(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in sorted(kept)))


def kept(page):
    return html.main_text(html.lines(page), set())


def test_only_whole_class_names_are_boilerplate():
    for tag in ("body class='single has-sidebar'", "div class='content no-sidebar'", "div id=page class='with-ads'", "div class='header-large post'", "div class='share-price'", "div data-id='nav'", "body class='sidebar'", "div title='class=ad'"):
        assert kept(f"<{tag}><p>main</p></{tag.split()[0]}>") == "main", tag
    for tag in ("div class='sidebar'", "form id=f", "div class='ads'"):
        assert kept(f"<{tag}><main><p>main</p></main></{tag.split()[0]}>") == "main", tag
    assert kept("<div class='Sidebar x'><article><p>main</p></article></div><p>x") == "main"
    assert kept("<div class='x ads'>Buy</div><p>main</p>") == "main"


def test_compound_names_go_by_what_they_are_about():
    for name in ("comment-list", "user-comments", "comments_area", "cookie-banner", "site-footer", "ad-slot", "sidebar-left", "related-posts", "top-nav", "newsletter-signup"):
        assert kept(f"<div class='{name}'>x</div><p>main</p>") == "main", name
        assert kept(f"<article><p>main</p><div id={name}>x</div></article>") == "main", name
    for name in ("no-sidebar", "has-sidebar", "with-ads", "share-price", "header-large", "ad-free", "search-results", "entry-header", "blog-posts", "content", "comment-count", "list", "-", "_"):
        assert kept(f"<div class='{name}'>x</div><p>main</p>") == "x\n\nmain", name


def test_pages_of_very_many_equal_lines():
    own = ["same"] * 100_000
    assert len(html.shared(own, own[:-1])) == 99_999


def test_template_lines_go_inside_an_article(spark):
    page = "<article><h1>Title {0}</h1><p>By the editors</p><p>{1}</p><p>Read more on our site</p></article>"
    own = ["a long text of one page about the sea and its many ships " * 2, "some other words on mountains, valleys and the snow up there " * 2]
    rows = [(i, f"http://h/p/{i}", page.format(i, own[i % 2] + str(i))) for i in range(4)]
    rows += [(10 + i, f"http://copy/p/{i}", page.format(9, own[0])) for i in range(2)]
    rows += [(20, "http://copy/p/2", page.format(9, own[0]).replace("editors", "publishers"))]
    got = by_id(html.extract(pages(spark, rows)), "text", key="page_id")
    assert [got[i][0] for i in range(4)] == [f"Title {i}\n\n{own[i % 2]}{i}" for i in range(4)]
    assert got[10] == got[11] == (f"Title 9\n\nBy the editors\n\n{own[0].strip()}\n\nRead more on our site",)


def test_articles_that_are_only_teasers():
    for begin, end in (("<aside>", "</aside>"), ("<div class='related'>", "</div>"), ("<div class='comments'>", "</div>")):
        assert kept(f"<div><p>real text</p></div>{begin}<article>teaser</article>{end}") == "real text"


def test_rows_of_one_url_are_spread(spark):
    from pyspark.sql import functions as F

    df = pages(spark, [(i, None, "<p>same</p>" if i % 2 else f"<p>t{i}</p>") for i in range(2000)])
    keyed = df.select(html.spread(df, F.concat(html.host(F.col("url")), html.path(F.col("url"))), "html").alias("place"))
    cuts = html.bounds(keyed, 100)
    sizes = keyed.groupBy(F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("place"))).alias("r")).count().collect()
    assert 10 <= len(cuts) <= 35 and max(r["count"] for r in sizes) < 400


def test_ranges_and_copies_hide_no_neighbour(spark):
    page = "<div>Menu of {}</div><div>{}</div>"
    rows, want = [], {}
    for i in range(600):
        host, copies = f"h{i // 200}", i % 200 < 120
        text = "a recrawled text" if copies else f"own text {i}"
        rows.append((i, f"http://{host}/p?page={i:04d}", page.format(host, text)))
        want[i] = (text,)
    rows += [(1000 + i, f"http://h0/p?page={i:04d}x", "") for i in range(100, 140)]
    rows += [(2000 + i, None, "<p>nobody's</p>") for i in range(100)]
    want |= {1000 + i: ("",) for i in range(100, 140)} | {2000 + i: ("nobody's",) for i in range(100)}
    for size in (40, 90, 2000):
        assert by_id(html.extract(pages(spark, rows), range_pages=size), "text", key="page_id") == want


def test_what_is_carried_over_cuts():
    ends = lambda r, *pages: [(r, role, h, s) for role, (h, s) in zip(("first0", "last0", "first1", "last1"), pages)]
    a, b, c = ("h", b"a"), ("h", b"b"), ("g", b"c")
    # b | a ... a | a | a b | c
    rows = ends(0, b, a, a, b) + ends(1, a, a) + ends(2, a, b, b, a) + ends(4, c, c)
    assert sorted(html.carries(rows)) == [(0, 1, 2, "first1"), (1, 0, 0, "last1"), (1, 1, 2, "first1"), (2, 0, 0, "last1")]
