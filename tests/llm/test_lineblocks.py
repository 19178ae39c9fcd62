"""Main text: walls, surges and dives, references, broken markup, pages without an article, odd rows."""

import html
import re

from phrasemill.llm.lineblocks import extract_pages, lines_of, main_text
from phrasemill.llm.queries import op10_line_blocks

ARTICLE = ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><!-- ad 1 -->"
           "<div class='ad'>Buy <b>this</b> now.</div><article><h1>Head &amp; line</h1><p><b>One  two\n three.<br><p>Four&nbsp;five.</p>"
           "<aside>Side.</aside><form>Your name <input></form><p>x</p><section class=comments><p>First!</p></section></article>"
           "<script>var t='</p>';</script><footer>&copy; me</footer></body></html>")


def test_article():
    assert main_text(ARTICLE) == ["Head & line", "One two three.", "Four five.", "x"]


def test_without_article():
    page = ("<body><div id=menu><a href=/>a</a></div><p>" + "Long text here. " * 9 + "</p><p>Short.</p><div class='cookie-notice'>We use cookies.</div>"
            "<p>" + "More text there. " * 9 + "</p><ul><li><a href=x>Another page</a></li></ul></body>")
    assert main_text(page) == [("Long text here. " * 9).strip(), "Short.", ("More text there. " * 9).strip()]


def test_one_long_paragraph():
    """Without an article, short paragraphs count for themselves, however long another one is."""
    long, ends = ("Very long text here. " * 300).strip(), ["Short closing words.", "And one more?", "The “end.”"]
    page = (f"<body><h1>The title</h1><div class=ad>Buy.</div><p>{long}</p><div class='ad'>Buy this now.</div>"
            + "".join(f"<p>{t}</p>" for t in ends[:2]) + f"<div class=promo>More offers!</div><h2>Between</h2><div class=ad>x.</div><p>{ends[2]}</p>"
            "<div class=ad>Buy.</div><ul><li><a href=x>Other page.</a></li><li>Home</li></ul></body>")
    assert main_text(page) == ["The title", long, *ends[:2], "Between", ends[2]]
    assert main_text("<p>no sentence</p><div class=ad>Buy.</div><p>nor here</p>") == ["no sentence", "nor here"]


def test_links_in_an_article():
    assert main_text("<article><p>Text.</p><p><a href=x>Read the full report</a></p></article><p>after</p>") == ["Text.", "Read the full report"]
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(5))
    assert main_text(f"<article><ul>{links}</ul><p>Text.</p><ul>{links}</ul></article>") == [
        *(f"Link {i}" for i in range(5)), "Text.", *(f"Link {i}" for i in range(5))]
    assert main_text(f"<main><ul>{links}</ul></main>") == [f"Link {i}" for i in range(5)]
    assert main_text("<p>Main text.</p><article><a href=x>Card</a></article>") == ["Main text.", "Card"]


def test_labels_in_an_article():
    kept = ("<h2 id='related-work'>Related work</h2><section id='search-results'><p>Found.</p></section>"
            "<div class='notice-period'>Two weeks.</div><h3 class=comments>Comments</h3>")
    gone = "<div class='box ad'>Buy.</div><div class='cookie-notice'>Cookies.</div><div id='ad-1'>Buy.</div><section class=comments>First!</section>"
    assert main_text(f"<article><p>Text.</p>{kept}{gone}</article>") == ["Text.", "Related work", "Found.", "Two weeks.", "Comments"]


def test_labels_of_two_words():
    gone = "".join(f"<div class='{c}'><p>Gone.</p></div>" for c in (
        "comment-list", "ad-slot", "sidebar-left", "related-posts", "comments-section", "postComments", "box site_footer", "cookie-notice"))
    kept = "".join(f"<div id='{c}'><p>{c}.</p></div>" for c in ("search-results-study", "with-sidebar", "notice-period", "formula-1", "related-work"))
    want = ["Text.", "search-results-study.", "with-sidebar.", "notice-period.", "formula-1.", "related-work."]
    assert main_text(f"<article><p>Text.</p>{gone}{kept}</article>") == want == main_text(f"<body><p>Text.</p>{gone}{kept}</body>")


def test_hidden():
    shown = ["style='overflow:hidden'", "title='hidden gems'", "data-hidden=1", "aria-hidden=false", "style='display:block'", "class=hidden-gems"]
    gone = ["hidden", "hidden=''", "aria-hidden='true'", "style='color:red; display: none'", "style=display:none"]
    for page in ("<article>{}</article>", "<body>{}</body>"):
        assert main_text(page.format("".join(f"<div {a}><p>Text {i}.</p></div>" for i, a in enumerate(shown)))) == [f"Text {i}." for i in range(len(shown))]
        assert main_text(page.format("<p>A.</p>" + "".join(f"<div {a}><p>Gone.</p></div>" for a in gone) + "<p>B.</p>")) == ["A.", "B."]


def test_media():
    assert main_text("<article><p>One <svg viewBox='0'/> two.<p>Three <svg><title>no</title><text>no</text></svg>four.</p>"
                     "<video src=x><p>Five.</p><video>no player</video></article>") == ["One two.", "Three four.", "Five."]


def test_opening_and_closing_lines():
    page = ("<body><ul><li>Home</ul><p>An opening line</p><div class=ad>Buy.</div><p>The text. It goes on.</p><div class=ad>Buy.</div>"
            "<p>A closing line</p><p><a href=x>More of this</a></p><ul><li>Contact</ul></body>")
    assert main_text(page) == ["An opening line", "The text. It goes on.", "A closing line"]


def test_open_paragraphs():
    assert main_text("<article><p>One.<p class=ad>Buy.<p>Two.<p class=ad>Buy.<div>Three.</div><div><p class=ad>Buy.</div>Four.<p class=ad>Buy.") == [
        "One.", "Two.", "Three.", "Four."]


def test_walls_and_weights():
    lines = lines_of("<p>abc</p><nav>no</nav><p><a href=x>linked</a> z</p>")
    assert lines == [("abc", 3, False), ("", 0, False), ("", 0, False), ("", 0, False), ("linked z", 0, False)]


def test_broken():
    assert main_text("") == [] and main_text("plain words only") == ["plain words only"]
    assert main_text("<article><p>a < b &lt;i&gt; &amp c &#233;&#x41;") == ["a < b <i> & c éA"]
    assert main_text("<nav><article><p>kept") == ["kept"]  # a menu that never ends swallows nothing
    assert main_text("<article><div class=ad>gone</div><p>here<script>never closed <p>no") == ["here"]
    assert main_text("<article><header><h2>Title</h2>by me</header><p title='a>b'>text</p></article><p>after</p>") == ["Title", "text"]
    assert main_text("<div class='with-sidebar'><article><p>inside</p></article></div>") == ["inside"]
    assert main_text("<article><p>" + "'\"<" * 3000) != [""]


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 5, 1), (1, "u", "", 5, 1), (None, None, "<p>long " + "w " * 50_000, 5, 1)],
                               "page_id long, url string, html string, n_chars int, page int")
    got = extract_pages(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("None", 100_004)]
    assert extract_pages(df.limit(0)).count() == 0


def test_query(spark):
    """The pages' articles, cut out by the marks that this table happens to have."""
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op10_line_blocks(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))
