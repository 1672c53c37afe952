"""Markup told apart by states: values written by hand from the rules of HTML, not from a pattern."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markup

TEXTS = {
    '<a title="x > y">link</a>!': "link!",
    "<a title='it\"s > \"'>one</a><p>two": "one two",
    '<img alt="a>b" src=c/>after': "after",
    "<p don't>shown</p>": "shown",
    "<a =\"x\">shown</a>": "shown",
    "<a href = 'u' >shown</a >": "shown",
    "a < b and c > d": "a < b and c > d",
    "1<2, <3, a<b": "1<2, <3, a",  # "<b" begins a tag that never ends
    "before<!-- <p>gone</p>": "before",
    "x<!-->y<!--->z<!-- a --!>w<!-- b -- > -->v": "xyzwv",
    "x<!doctype html>y<?php echo 1 ?>z</>w</ 3>v": "xyzwv",
    "kept<p title=\"never closed>lost</p>": "kept",
    "kept<p class=x": "kept",
    "<script>if (a<b && '</p>') {}</script>shown": "shown",
    "<script>var s = '</scripture>';</SCRIPT >shown": "shown",
    "kept<script>never closed": "kept",
    "<style>p > a { content: '<!--' }</style>shown": "shown",
    "<head><title>t</title><meta x></head>shown": "shown",
    "<head><title>t</title><body>shown": "shown",
    "<head><script>1</script><p>shown": "shown",
    "<header>top</header><span>a</span>b": "top ab",
    "<p-custom>a</p-custom>b": "ab",
    "one<BR/>two&nbsp;&lt;b&gt; &amp;lt;": "one two <b> &lt;",
    "": "",
    "<": "<",
    "</": "",
    None: None,
}

CLEAN = {
    "<p onclick=\"a>b\">x</p>": "<p>x</p>",
    "<a id=q href='u'>l</a><A HREF=v title=\"href\">m</A><a>n</a>": '<a href="u">l</a><A href="v">m</A><a>n</a>',
    "<a href='say \"hi\" <b>'>l</a>": '<a href="say &quot;hi&quot; &lt;b&gt;">l</a>',
    "<a data-href=\"x\">l</a>": "<a>l</a>",
    "a < b<!-- <p> -->c": "a &lt; bc",
    "<object><p>in</p><object>deep</object>in</object>out": "out",
    "x<iframe><p>in</p></iframe>y": "xy",
    "<p-custom>a</p-custom><img src=x><br/>": "a<br>",
    "<p title=\"open>lost</p>": "",
    None: None,
    "": "",
}


@pytest.mark.parametrize("rule, golden", [(markup.visible_text, TEXTS), (markup.allowed_markup, CLEAN)])
def test_golden(spark, rule, golden):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(golden)], "i int, html string")
    got = {r.i: r.v for r in df.select("i", rule(F.col("html")).alias("v")).collect()}
    for i, (html, want) in enumerate(golden.items()):
        assert got[i] == want, html


@pytest.mark.parametrize("piece", ["<", "<a ", "<!--", "<a href=\"", "<a '", "</", "<script>", "<head>", "<object>", "<p>x", "= ", "<a =", "-->"])
def test_linear_in_broken_markup(piece):
    for rule in (markup._flat, markup._allowed):
        rule(piece * 1000)
        began = time.process_time()
        rule(piece * 300_000)
        assert time.process_time() - began < 10


def test_batches_of_long_pages_are_bounded_in_bytes(spark):
    from pyspark.sql import functions as F

    @F.pandas_udf("long")
    def held(html):
        return html.map(lambda _: int(html.map(len).sum()))

    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("<p>text</p>"), 20_000).alias("html"))
    assert rows.select(held("html").alias("n")).agg(F.max("n")).first()[0] < 24 << 20
