"""Main text of crawled pages."""

from talkweave.operators import docs as dc

LONG = "To install the licence, open the account page, choose licences and press install. " * 2


def test_page_main_text(spark):
    html = (f"<html><head><title>Install guide | Site</title><script>var x = 'hidden';</script></head><body><nav>Home</nav>"
            f"<main><h1>Install guide</h1><h2>First steps</h2><p>{LONG}</p><ul><li>one</li><li>two</li></ul></main></body></html>")
    pages = spark.createDataFrame([("https://a.example/help/install", html), ("https://a.example/help/empty", "<html></html>"), ("https://a.example/none", None)],
                                  "url string, html string")
    rows = {r.url: r for r in dc.parse_pages(pages).collect()}
    page = rows["https://a.example/help/install"]
    assert page.title == "Install guide" and page.h2 == "First steps"
    assert LONG.strip() in page.body and "hidden" not in page.body and "one" in page.body and "two" in page.body
    assert not page.body.startswith("# Install guide")
    usable = dc.usable_pages(dc.parse_pages(pages)).collect()
    assert [r.url for r in usable] == ["https://a.example/help/install"]
