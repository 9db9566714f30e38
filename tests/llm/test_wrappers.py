"""What the wrapper of a host decides that a page by itself can't."""

from corpus_fixtures import prose

from millrace.llm.html_text import blocks, extract_main_text

PAGE = "page_id long, url string, html string"


def page(k, notice="Sign up to our letter for more like this"):
    body = "".join(f"<p>{prose(100 * k + i, 12)}</p>" for i in range(k % 3 + 1))
    return f"<html><body><div class=menu><a href=/>home</a></div><div class='layout has-sidebar'><article><h1>{prose(k, 3)}</h1><div>{notice}</div>{body}<p>All rights reserved by us</p></article></div></body></html>"


def wanted(k):
    return "\n".join([prose(k, 3), *(prose(100 * k + i, 12) for i in range(k % 3 + 1))])


def texts(spark, rows):
    return {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}


def test_fixed_texts_are_template(spark):
    rows = [(k, f"http://a.example.com/{k}", page(k)) for k in range(12)]
    alone = [(50, "http://b.example.com/1", page(50))]
    copies = [(60 + k, f"http://c.example.com/{k}", page(60)) for k in range(9)]
    got = texts(spark, rows + alone + copies)
    assert all(got[k] == wanted(k) for k in range(12))
    whole = lambda k: "\n".join([prose(k, 3), "Sign up to our letter for more like this", *wanted(k).split("\n")[1:], "All rights reserved by us"])
    assert got[50] == whole(50) and all(got[60 + k] == whole(60) for k in range(9))


def test_pages_of_fixed_text_only_keep_it(spark):
    rows = [(k, f"http://a.example.com/{k}", f"<article><p>the same notice</p></article><footer>{prose(k, 9)}</footer>") for k in range(8)]
    assert set(texts(spark, rows).values()) == {"the same notice"}


def test_attributes_with_stray_quotes():
    assert [t for _, t in blocks("<p title=it's>one</p><p title=\"a>b\">two</p><p title='>'>three</p><p data-x=\">four</p>")] == ["one", "two", "three", "four"]
