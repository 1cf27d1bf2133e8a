import random

from lodestone.sources import files


def test_plain_tags_read_as_the_parser_reads_them():
    def parsed(page):
        parser = files._Article()
        parser.feed(page)
        return parser.found

    draw = random.Random(1)
    bits = ["<p>", "</p>", "<h1>", "</h1 >", "</h1>", '<div id="a">', "</div>", "<b>", "</b>", "<br/>", "&amp;", "&#x27;", "&am", "x <", "a", "\n", "<title>", "</title>", "<script>", "</script>", "<!--", "-->", '<P class="x y">', '"', "<!DOCTYPE html>", "<p a=b>", "<plaintext>", ">"]
    plain = 0
    for _ in range(5000):
        page = "".join(draw.choice(bits) for _ in range(draw.randrange(10)))
        plain += files.plain_tags(page) is not None
        assert files.article(page).found == parsed(page), page
    assert plain > 500


def test_escaping_is_an_expression(spark):
    rows = [("a & b < c > \"d\" 'e' &amp;",), (None,), ("",)]
    found = spark.createDataFrame(rows, "x string").select(files.escaped("x").alias("y"))
    assert [r.y for r in found.collect()] == ["a &amp; b &lt; c &gt; &quot;d&quot; &#x27;e&#x27; &amp;amp;", "", ""]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
