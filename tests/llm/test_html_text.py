import random
import time

import duckdb
import pytest

from sparkloom.llm import html_text as ht

LONG = "This is a sentence of the article, long enough to surge well above the bound by itself, as the contents of pages mostly do."


def brute_regions(lengths):
    out, i, n = [], 0, len(lengths)
    while i < n:
        if lengths[i] and sum(lengths[i : i + ht.WINDOW]) > ht.SURGE:
            end = next((k for k in range(i, n) if not any(lengths[k : k + ht.GAP])), n)
            out.append((i, end))
            i = end
        i += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_regions_against_brute_force(seed):
    import numpy as np

    rng = random.Random(seed)
    lengths = [rng.choice([0, 0, 0, 5, 30, 60, 120]) for _ in range(rng.randrange(0, 80))]
    assert ht.regions(np.array(lengths, np.int64)) == brute_regions(lengths)


def test_article_between_boilerplate():
    page = f"<html><head><title>T</title><style>p {{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li>About</li></ul></nav><div class=ad>Buy now</div><article><h1>Head</h1><p>{LONG} A &amp; B &lt;3 &eacute;&#233;</p><!-- <p>{LONG}</p> --><p>Short end.</p></article><script>var a = '<p>{LONG}</p>';</script><footer>&copy; me</footer></body></html>"
    text, n = ht.extract(page)
    assert n == 1
    assert text.split("\n") == ["Head", LONG + " A & B <3 éé", "Short end."]


@pytest.mark.parametrize("page, want", [("", ""), ("plain", ""), (LONG, LONG), ("<p>" + LONG, LONG), ("<!-- " + LONG, ""), ("<script>" + LONG, ""), (f"<b>{LONG}</B >", LONG), (f"a < b {LONG}", f"a < b {LONG}")])
def test_broken_markup(page, want):
    assert ht.extract(page)[0] == want


@pytest.mark.parametrize("opened", ["<head><title>T</title><meta x>", "<head><title>T<body>", "<head><style>p {}</style><body>", "<body><select><option>a<option>b<div>", "<textarea>x<p>", "<iframe src=a><p>", "<noscript><p>", "<svg><path d=1><p>", "<title>T<p>", "<head><script>'<p>'</script>"])
def test_elements_without_their_ends_hide_no_article(opened):
    assert ht.extract(f"<html>{opened}<p>{LONG}</p><p>{LONG}</p>")[0].split("\n")[-2:] == [LONG, LONG]


def brute_visible(page):
    """The same sign by sign, without memory of what was looked for."""
    out, i, low = [], 0, page.lower()
    starts = lambda t, k: low.startswith("<" + t, k) and k + len(t) + 1 < len(low) and low[k + len(t) + 1] in " \t\n\r\f\v/>"
    while i < len(page):
        tag = next((t for t in ht._ELEMENTS if starts(t, i)), None)
        if low.startswith("<!--", i):
            end = low.find("-->", i + 4)
            i = end + 3 if end >= 0 else len(page)
        elif tag:
            close = next((k for k in range(i + len(tag) + 1, len(low)) if low.startswith("</" + tag, k) and low[k + len(tag) + 2 :].lstrip()[:1] == ">"), None)
            if close is not None:
                i = low.index(">", close) + 1
            elif tag in ("script", "style"):
                i = len(page)
            else:
                block = next((k for k in range(i + len(tag) + 1, len(low)) if ht._BREAK.match(page, k)), None)
                i = i + len(tag) + 1 if block is None else block
        else:
            out.append(page[i])
            i += 1
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_visible_text_against_brute_force(seed):
    rng = random.Random(seed)
    bits = [f"<{t}>" for t in ht._ELEMENTS] + [f"</{t}>" for t in ht._ELEMENTS] + ["<!--", "-->", "<p>", "</p>", "<div class=a>", "x", " text ", "<b>", "<titles>", "<script ", "<SELECT>", "</Style >"]
    page = "".join(rng.choices(bits, k=rng.randrange(1, 25)))
    assert ht.visible(page) == brute_visible(page)
    import html

    plain = ht._TAG.sub("", ht._BREAK.sub("\n", brute_visible(page)))
    assert ht.lines_of(page) == [" ".join(html.unescape(x).split(" ")).strip() if "  " not in x else ht._BLANK.sub(" ", html.unescape(x)).strip() for x in plain.split("\n")]


def test_time_is_linear_in_hostile_pages():
    for page in ("<!-- " * 200_000, "<script " * 150_000, "<" * 1_000_000, "<p" * 500_000, "<a href='" * 200_000, "&#" * 400_000, "<script>x</script>" * 60_000, "<title>" * 150_000, "<select>" * 100_000 + "<p>", "<svg><title>" * 80_000):
        began = time.time()
        ht.extract(page)
        assert time.time() - began < 8


def test_articles_of_the_pages_are_found(spark, sf):
    rows = duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in ht.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    right = wrong = size = 0
    for i, page in rows:
        body = {x for x in ht.lines_of(page[page.find("<article>") : page.find("</article>")]) if x}
        found = {x for x in got[i].split("\n") if x}
        size += sum(map(len, body))
        right += sum(map(len, body & found))
        wrong += sum(map(len, found - body))
    assert right > 0.97 * size and wrong < 0.03 * size


def test_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", LONG), (2, "u", LONG), (3, "v", f"<p>{LONG}</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id as text", "url as regions")
    out = ht.extract_text(pages).collect()
    assert next(r for r in out if r.page_id == 1).text is None
    assert next(r for r in out if r.page_id == 3).n_chars == 20_000 * (len(LONG) + 1) - 1
    assert [r.text for r in out if r.page_id == 2] == [LONG, LONG]
    assert ht.extract_text(pages.limit(0)).count() == 0
