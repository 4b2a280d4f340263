"""Article text in containers with names of controls, pages of very many open tags, texts of very many lines."""

import time

from test_operators import SCHEMA, cut_lines

from vigilake.llm import html_extract, line_dedup

PROSE = "This is a long paragraph of prose that tells the reader something about the matter. " * 5


def test_controls_with_prose_are_article_text():
    page = f"""<html><body><nav><a href="/">menu</a></nav><div class="search">{PROSE} outside</div><article><h1>Title</h1><p>{PROSE}</p><div class="search"><p>{PROSE} search</p></div><section id="form"><p>{PROSE} form</p></section>
<div class="share"><a href="#">Share</a> <a href="#">Post</a></div><ul class="nav"><li><a href="a">Up</a></li><li><a href="b">Down</a></li></ul><p>x = <math><mi>y</mi></math></p><ol><li><a href="a">First reference</a></li><li><a href="b">Second reference</a></li></ol><div class="comments"><p>{PROSE} comment</p></div></article><footer>foot</footer></body></html>"""
    lines = html_extract.main_text(page).split("\n")
    assert lines == ["Title", *((PROSE.strip() + end) for end in ("", " search", " form")), "x = y", "First reference", "Second reference"]


def test_open_and_stray_tags_take_linear_time():
    begun = time.process_time()
    assert html_extract.main_text("<div>" * 200_000 + "</p>" * 200_000 + PROSE) == PROSE.strip()
    assert html_extract.main_text("<p>" + PROSE + "</section></b></div>" * 100_000) == PROSE.strip()
    assert time.process_time() - begun < 30


def test_a_text_of_very_many_lines_by_join(spark):
    """More boilerplate than a task may hold: a text's lines are gone through once."""
    shared, n = [f"shared {i}" for i in range(20_000)], 40_000
    texts = [(k, "\n".join(x for i in range(n // 2) for x in (shared[i], f"own {k} {i}")), f"s{k}", "en") for k in range(4)]
    df = spark.createDataFrame(texts, SCHEMA)
    begun = time.time()
    got = [(r.doc_id, r.text, r["__lines"], r["__removed"]) for r in line_dedup.dedup_lines(df, 4, 0, 0).collect()]
    assert time.time() - begun < 60
    assert sorted(got) == sorted(cut_lines(texts, 4)) and all(x[3] == n // 2 for x in got)
