import random

from tarnwick.llm import html_text
from tarnwick.llm.html_lines import ARTICLE, lines, longest_common


def text_of(page):
    return "\n".join(html_text._chosen(lines(page), set())[0])


def test_marks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head>
    <body><header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="ad">Buy</div><!-- no --><article><header><h1>Head&nbsp;line &lt;1&gt;</h1></header><p><b>One<br>two</b>
    three <p>Four &eacute;&#233; five<div class="share">share</div><aside>see also</aside><form><input><p>mail</p></form>
    <section id="comments"><p>nice!</p></section><p>six</p><footer>filed</footer></article><div class="sidebar"><p>side</p></div>
    <footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "Head line <1>\nOne two three\nFour éé five\nsix"


def test_cut_off_and_empty():
    assert text_of("<body><nav>m</nav><article><p>One</p><p>Two &am") == "One\nTwo &am"
    assert text_of("<article><p>a</p><p>b</p><div cla") == "a\nb"
    assert text_of(None) == text_of("") == text_of("<nav>x</nav>") == ""
    assert text_of("plain words\n only") == "plain words only"
    assert text_of("<div class=ad>x<article><p>kept</p></article>") == "kept"
    assert text_of('<div class="page has-sidebar no-ads"><p>kept</p><div class="left-sidebar">gone</div></div>') == "kept"
    assert text_of('<div id="x"><div class="post-content"><p>in</p></div>out</div>') == "in"
    assert lines("<article>a<main>b</main></article>")[1][0] == ARTICLE


def test_longest_common_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = longest_common(a, b)
        assert len(found) == best[-1][-1] and found == sorted(set(found))
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def page(*blocks):
    return "<body>" + "".join(f"<div>{x}</div>" for x in blocks) + "</body>"


def test_differencing(spark):
    rows = [
        (1, "http://a.example.org/x/1", page("Home", "Unique one", "More one", "More than one", "Imprint")),
        (2, "http://a.example.org/x/2?q=1", page("Home", "Unique two", "More two", "More than two", "Imprint")),
        (3, "http://a.example.org/y", page("Home", "Unique three", "Third", "Imprint")),
        (4, "http://b.example.org/", page("Home", "Alone")),
        (5, "http://c.example.org/p", page("Same", "copy")),
        (6, "http://c.example.org/p#x", page("Same", "copy")),
        (7, "http://d.example.org/1", "<article><p>Quoted</p><p>d1</p></article>"),
        (8, "http://d.example.org/2", "<article><p>Quoted</p><p>d2</p></article>"),
        (12, "http://d.example.org/3", "<main><p>Quoted</p><p>d3</p></main>"),
        (9, None, page("no url")),
        (10, "not an url", page("odd")),
        (11, "http://e.example.org/", None),
        (1, "http://a.example.org/x/1", page("Home", "Unique one", "More one", "More than one", "Imprint")),
        (None, "http://f.example.org/", "<p>" + "long " * 50_000),
    ]
    want = {1: "Unique one\nMore one\nMore than one", 2: "Unique two\nMore two\nMore than two", 3: "Unique three\nThird", 4: "Home\nAlone", 5: "Same\ncopy", 6: "Same\ncopy", 7: "Quoted\nd1", 8: "Quoted\nd2", 12: "Quoted\nd3", 9: "no url", 10: "odd", 11: "", None: " ".join(["long"] * 50_000)}
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key int, text string")
    found = html_text.main_text(frame.repartition(3)).collect()
    assert len(found) == len(rows)
    assert {r.page_id: r.text for r in found} == want
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_articles_under_a_common_menu_are_no_copies(spark):
    """Ten common lines and two of their own: the menu goes from all, copies keep their article."""
    menu = [f"Entry {i}" for i in range(10)]
    rows = [(i, f"http://a.org/{i:02d}", page(*menu, f"Headline {i}", f"Story {i}")) for i in range(6)]
    rows += [(7, "http://a.org/05b", page(*menu, "Headline 5", "Story 5", "Seen twice"))]
    found = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in found.items()} == {i: f"Headline {i}\nStory {i}" for i in range(6)} | {7: "Headline 5\nStory 5\nSeen twice"}
    assert all(r.n_shared == 10 and r.n_marked == 0 for r in found.values())


def test_a_line_of_most_articles_is_the_template(spark):
    """Inside articles a line goes that more than half of the host's pages hold; a passage that two neighbours quote stays."""
    quoted = {12, 13}
    rows = [(i, f"http://a.org/{i}", f"<nav>menu {i}</nav><article><p>Read more on our site</p><p>a{i}</p>{'<p>Quoted</p>' if i in quoted else ''}</article>") for i in range(10, 22)]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: f"a{i}" + ("\nQuoted" if i in quoted else "") for i in range(10, 22)}
    assert all(r.n_shared == 1 and r.n_marked == 1 for r in found)


def test_whole_query_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        host = f"h{rng.randrange(5) if i % 3 else 0}.org"
        menu = [f"m{j} of {host}" for j in range(6) if rng.random() < 0.9]
        body = [rng.choice([f"line {rng.randrange(12)}", f"own {i} {j}", "everywhere"]) for j in range(rng.randrange(6))]
        blocks = "".join(f"<p>{x}</p>" for x in body)
        html = [page(*menu, *body), f"<nav>{'<p>'.join(menu)}</nav><article>{blocks}</article><footer>f {i}</footer>", f"<div class=content>{blocks}</div>" + page(*menu)][rng.randrange(3)]
        rows.append((i, f"https://{host}/{rng.choice('abc')}/{i}", html if i % 40 else None))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)]
    want = html_text.brute_force([(u, h) for _, u, h in rows])
    for parts in (1, 5):
        got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
        assert {r.page_id: r.text for r in got} == {i: want[u, h] for i, u, h in rows}
        assert sum(r.n_shared for r in got) > 300
