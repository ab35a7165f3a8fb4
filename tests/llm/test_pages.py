"""Main text: what an article may lose and what not, hostile markup in linear time, columns of pages."""

import re
import time

import pytest
from pyspark.sql import functions as F

from catalogops.llm import htmlmain

P = "<p>The river rose in the night, and by morning the lower fields were under water, as they had been before.</p>"
TEXT = re.sub("<.*?>", "", P)


@pytest.fixture(scope="module")
def model():
    return htmlmain.train([])


def extract(model, page):
    nodes = htmlmain.parse(page)
    return htmlmain.main_text(nodes, htmlmain.decode(nodes, model.log_odds(htmlmain.features(nodes))))


def page(inner, tag):
    nav = "<nav><a href=/>Home</a> <a href=/b>News</a></nav>"
    return f"<html><body>{nav}<{tag}><h1>Flood</h1>{P * 3}{inner}{P * 2}</{tag.split()[0]}><footer>(c) us</footer></body></html>"


@pytest.mark.parametrize("tag", ["article", "div class=content"])
@pytest.mark.parametrize(("inner", "kept"), [
    ("<p>Let <math>x=2</math> hold.</p>", "Let x=2 hold."),
    ("<div hidden><p>A collapsed section of the article.</p></div>", "A collapsed section of the article."),
    ("<p style='display:none'>Hidden words of the text.</p>", "Hidden words of the text."),
    ("<video>No video here</video>", "No video here"),
    ("<p title=\"foo>Unclosed words", "Unclosed words"),
    ("<aside>Read our other pieces here.</aside>", ""),
    ("<aside><p>Some sidebar words, of no use at all.</p></aside>", ""),
    ("<aside class=related><p>See also that.</p></aside>", ""),
    ("<form><label>Your mail</label><input><button>Go</button></form>", ""),
])
def test_parts_of_an_article(model, tag, inner, kept):
    assert extract(model, page(inner, tag)) == "\n".join(["Flood", *[TEXT] * 3, *[kept] * bool(kept), *[TEXT] * 2])


@pytest.mark.parametrize("part", ["<a ", '<a x="1>" ', "</b>", "<b>", "<p><button><b><hr>", "<!-- ", '<p title="foo>', "<p title='it's>", "<script>", "<", "<p ="])
def test_hostile_megabyte(part):
    began = time.process_time()
    htmlmain.parse(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 15  # quadratic work would take hours


def test_tags_with_quotes():
    def texts(markup):
        return ["".join(p for p in n.parts if isinstance(p, str)) for n in htmlmain.parse(markup)]

    assert texts('a<p title="x > y">b</p>c') == ["ac", "b"]
    assert texts("1 < 2 and <b it's>3</b> > 2") == ["1 < 2 and  > 2", "3"]
    assert texts("x <b") == ["x <b"]
    assert texts("x<!-- <p> -->y<?php z ?>w<!doctype html>v") == ["xywv"]


def test_other_columns_stay(spark):
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") > 0, page("", "article")).alias("html"), F.lit("t").alias("text"), F.array(F.lit(1)).alias("more"))
    got = htmlmain.main_texts(pages)
    assert got.columns == ["page_id", "url", "more", "text", "n_chars"]
    assert {(r.page_id, r.n_chars, tuple(r.more)) for r in got.collect()} == {(0, 0, (1,)), *((k, len("\n".join(["Flood", *[TEXT] * 5])), (1,)) for k in (1, 2))}
    assert htmlmain.main_texts(pages.limit(0)).count() == 0
