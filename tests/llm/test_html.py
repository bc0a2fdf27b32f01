import re
from html import unescape

from calibra.llm.html import Page, align, extract, fold, items_of, main_paths, op3_wrappers

SCHEMA = "page_id long, url string, html string, host string, main string"


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title} &amp; more</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_fold_and_align():
    assert fold("p p p".split()) == ["p+"] and fold("h2 p h2 p x".split()) == ["(h2 p)+", "x"]
    assert align(["h1", "p+"], ["h1", "h2", "p"]) == ["h1", "h2?", "p+"]
    assert items_of("a (b c)+ d?") == ["a", "(b c)+", "d?"]


def test_blocks_and_white_space():
    blocks = Page("<p>One<br>two &amp;\n three<p>four <b>fi</b>ve<ul><li>a<li>b</ul>tail<!-- <p>no --> end").blocks
    assert [t for _, t, _ in blocks] == ["One two & three", "four five", "a", "b", "tail end"]


def test_wrappers_without_article_elements(spark):
    rows = []
    for i in range(6):
        story = "".join(f"<p>Story {i} line {k} tells of thing {i * k}.</p>" for k in range(2 + i))
        body = f"<div class='top-menu'><a href='/'>Home {i}</a></div><div id='cookie-notice'>We use cookies {i}</div><div class='c1'><h1>Head {i}</h1>{story}<div class='comments'><p>Nice {i}!</p></div></div><div class='c2'><p>Same on all pages</p></div><aside><p>Side {i}</p></aside><form>Ask {i}</form><footer>End {i}</footer>"
        rows.append((i, f"http://a.example/{i}", page(body), "h", "m"))
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(6):
        want = "\n".join([f"Head {i}", *(f"Story {i} line {k} tells of thing {i * k}." for k in range(2 + i))])
        assert got[i].text == want and got[i].n_chars == len(want)


def test_edges(spark):
    rows = [(1, None, page("<article><p>Alone &eacute;</p></article>"), "", ""), (2, "not a url", None, "", ""), (3, "http://b.example/x", "", "", ""), (3, "http://b.example/x", "", "", ""), (4, "http://c.example", "<div>" * 5000 + "deep text", "", ""), (None, "http://d.example", "<p>unclosed <a href='x>y", "", "")]
    got = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 6 and by[1] == "Alone é" and by[2] == by[3] == "" and by[4] == "deep text"
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_pages(spark):
    from calibra.llm.common import table

    got = {r.page_id: r.text for r in op3_wrappers(spark, "/root/testdata/sf0.01").collect()}
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        lines = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert got[r.page_id] == "\n".join(x for x in lines if x)


def test_links_are_no_article():
    slots = [{"path": "/body/div", "chars": 100, "links": 90, "pages": 5, "low": 1, "high": 2}, {"path": "/body/td", "chars": 50, "links": 0, "pages": 5, "low": 1, "high": 2}]
    assert main_paths(slots) == ["/body/td"]
