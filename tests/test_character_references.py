"""Character references against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from corpusgraph.functions import text as T


def _decoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    return [r["x"] for r in df.select("i", T.character_references(F.col("t")).alias("x")).orderBy("i").collect()]


def test_generated_texts(spark):
    rng = random.Random(1)
    names = sorted(html5)
    pieces = [lambda: rng.choice(names), lambda: "&" + rng.choice(names), lambda: "&" + rng.choice(names)[:-1], lambda: f"&#{rng.randrange(0x120000)}" + rng.choice([";", "", " "]), lambda: f"&#x{rng.randrange(0x120000):x};", lambda: f"&#X{rng.randrange(300):X}", lambda: rng.choice("&;# xaé日<\n\t"), lambda: "&" + "".join(rng.choice("abcgmlt") for _ in range(rng.randrange(40))), lambda: "&amp" + rng.choice(names)]
    texts = ["".join(rng.choice(pieces)() for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert _decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_every_name_and_every_odd_number(spark):
    texts = [f"&{n}" for n in html5] + [f"&#{n};" for n in [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**30]] + ["&#;", "&#x;", "&#xg;", "&", "", "&&amp;&", "&#00000000000065;", "&#x000041"]
    assert _decoded(spark, texts) == [html.unescape(t) for t in texts]
    assert _decoded(spark, [None]) == [None]


def test_closed_references_alone(spark):
    """The query of pages leaves what was cut before its semicolon; `&amp` at a text's end is none there."""
    texts = ["a &amp", "b&&amp c", "&ampx;", "&lt;&#39;&#39&notit;", "&copy;&copy &nosuch; &eacute;", "&amp;lt;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["x"] for r in df.select("i", T.character_references(F.col("t"), closed=True).alias("x")).orderBy("i").collect()]
    assert got == ["a &amp", "b&&amp c", "&ampx;", "<'&#39&notit;", "©&copy &nosuch; é", "&lt;"]
