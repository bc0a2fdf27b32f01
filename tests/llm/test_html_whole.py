import pytest

from calibra.llm.html import extract

SCHEMA = "page_id long, url string, html string"


def texts(spark, bodies):
    rows = [(i, f"http://a.example/{i}", f"<html>{b}</html>") for i, b in enumerate(bodies)]
    return [r.text for r in sorted(extract(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.page_id)]


STORIES = [f"Story {i} tells of thing {i * i} at some length." for i in range(4)]


@pytest.mark.parametrize(
    "shell",
    [
        "<body class='right-sidebar'><article><p>{}</p></article><div>Copyright</div></body>",
        "<body><div id='content-sidebar-wrap'><article><p>{}</p></article></div><div>Made here</div></body>",
        "<body><article class='post comments-open'><p>{}</p></article></body>",
        "<body><div class='share'><div><p>{}</p></div></div></body>",
        "<body><div class='top-menu'>Home</div>" + "<div>" * 40 + "<article><p>{}</p><div class='comments'>Nice</div></article></body>",
    ],
)
def test_no_page_is_lost(spark, shell):
    assert texts(spark, [shell.format(x) for x in STORIES]) == STORIES


def test_templates_of_one_host(spark):
    plain = "<body><div class='top-menu'>Home</div><div class='c'><p>{}</p></div></body>"
    bodies = ["<body><article><p>{}</p></article></body>", "<body><main><p>{}</p></main></body>", plain, plain]
    assert texts(spark, [b.format(x) for b, x in zip(bodies, STORIES, strict=True)]) == STORIES


def test_same_slot_on_every_page_of_an_article(spark):
    body = "<body><article><div class='x1'>Read us daily</div><p>{}</p><div class='x2'>{}</div></article></body>"
    assert texts(spark, [body.format(x, i % 2) for i, x in enumerate(STORIES)]) == [f"{x}\n{i % 2}" for i, x in enumerate(STORIES)]
    assert texts(spark, ["<body><article><p>One</p></article></body>"] * 4) == ["One"] * 4


@pytest.mark.parametrize("name", ["share-price", "login-guide", "searchEngineReview", "banner_history"])
def test_names_that_only_hold_a_marking_word(spark, name):
    body = "<body><article><h1>Head {}</h1><section class='" + name + "'><p>{}</p></section></article></body>"
    assert texts(spark, [body.format(i, x) for i, x in enumerate(STORIES)]) == [f"Head {i}\n{x}" for i, x in enumerate(STORIES)]


@pytest.mark.parametrize("name", ["share-box", "ad", "top-banner", "relatedPosts", "cookie-notice", "newsletter signup"])
def test_marked_blocks_go(spark, name):
    body = "<body><article><p>{}</p><section class='" + name + "'><p>Other {}</p></section></article></body>"
    assert texts(spark, [body.format(x, i) for i, x in enumerate(STORIES)]) == STORIES


def test_a_heading_that_all_pages_have_stays(spark):
    body = "<body><article><h2>Summary</h2><p>{}</p></article></body>"
    assert texts(spark, [body.format(x) for x in STORIES]) == [f"Summary\n{x}" for x in STORIES]


def test_adverts_inside_lines_and_elements_of_the_pages_own(spark):
    body = "<body><article><p>{} <span class='advert'>Buy <span>now</span></span>Then <x-name class='big'>on</x-name>.</p><ad-slot class='ad'><p>Buy</p> this</ad-slot><p>End<span class='ad'> of all</p><p>Last {}</p></article></body>"
    assert texts(spark, [body.format(x, i) for i, x in enumerate(STORIES)]) == [f"{x} Then on.\nEnd\nLast {i}" for i, x in enumerate(STORIES)]


def test_tags_that_close_far_below(spark):
    body = "<body><article><p>{}</p>" + "<div>" * 80 + "<p>Deep {}</p></article><footer>Foot {}</footer><div>End {}</div></body>"
    assert texts(spark, [body.format(x, i, i, i) for i, x in enumerate(STORIES)]) == [f"{x}\nDeep {i}" for i, x in enumerate(STORIES)]


def test_a_long_page_of_a_host_of_many(spark):
    long = "".join(f"<p>Line {k} of a long story about {k * 7}.</p>" for k in range(20_000))
    bodies = [f"<body><nav>Menu {i}</nav><article><p>{x}</p></article></body>" for i, x in enumerate(STORIES * 200)] + [f"<body><nav>Menu</nav><article>{long}</article></body>"]
    got = texts(spark, bodies)
    assert got[:800] == STORIES * 200 and got[800].count("\n") == 19_999
