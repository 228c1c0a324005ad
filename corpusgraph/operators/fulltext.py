"""Full texts: sections of HTML articles, and quotes that must stand in them word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .search import substring_matches


def html_plain_text(pages: DataFrame, closed: bool = False) -> DataFrame:
    """(page_id, plain) of pages(page_id, html); `closed` leaves character references without a semicolon as they stand."""
    return pages.select("page_id", T.plain_text(T.strip_elements(F.coalesce("html", F.lit(""))), closed).alias("plain"))


def sections(pages: DataFrame, heading_class: str = "ltx_title", paragraph_class: str = "ltx_p") -> DataFrame:
    """(id, pos, kind, heading, text, claim_bearing) of pages(id, html).

    Headings and paragraphs come in document order; paragraphs gather under the heading above
    them, and headings without text are dropped.  "" as a class takes any element of its kind.
    """
    cls = lambda c: rf'[^>]*class="[^"]*{c}[^"]*"[^>]*' if c else "[^>]*"
    html = T.strip_elements(F.coalesce("html", F.lit("")))
    body = F.split(html, r'(?i)<(?:section|div)[^>]*class="[^"]*ltx_(?:bibliography|appendix)', 2)[0]
    pattern = rf"(?is)<h[1-6]{cls(heading_class)}>.*?</h[1-6]>|<p(?:\s{cls(paragraph_class)})?>.*?</p>" if not paragraph_class else rf"(?is)<h[1-6]{cls(heading_class)}>.*?</h[1-6]>|<p{cls(paragraph_class)}>.*?</p>"
    found = pages.select("id", F.posexplode(F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias("pos", "raw"))
    blocks = found.select("id", "pos", F.lower(F.substring("raw", 2, 1)).eqNullSafe("h").alias("is_heading"), T.plain_text(F.col("raw")).alias("text")).where("text <> ''")
    # running heading inside each article, as one sorted array a page
    listed = blocks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "is_heading", "text"))).alias("b"))
    heads = listed.select("id", "b", F.filter("b", lambda x: x["is_heading"]).alias("h"))
    each = heads.select("id", "h", F.explode(F.filter("b", lambda x: ~x["is_heading"])).alias("p"))
    above = F.element_at(F.filter("h", lambda x: x["pos"] < F.col("p.pos")), -1)
    parts = each.select("id", F.col("p.pos").alias("pos"), F.col("p.text").alias("text"), F.when(F.exists("h", lambda x: x["pos"] < F.col("p.pos")), above).alias("over"))
    grouped = parts.groupBy("id", "over").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    kind = T.heading_kind(F.coalesce("over.text", F.lit("")))
    return grouped.select("id", "pos", kind.alias("kind"), F.coalesce("over.text", F.lit("—")).alias("heading"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"), kind.isin(fixed.CLAIM_BEARING).alias("claim_bearing"))


#: So many keys of quotes (8 bytes each) are broadcast at most.
BROADCAST_KEYS = 1_000_000


def verbatim(quotes: DataFrame, sources: DataFrame, words: int = 5) -> DataFrame:
    """(quote_id, source_id) where the source has the quote, white space aside; quotes(quote_id, text), sources(source_id, text).

    Both meet by hashes, an equi-join.  A quote's words but the first and the last are whole words of any source that holds
    it: a quote is looked up by `words` of them, or, if it is shorter, by the longest one.  Quotes of one or two words have no such
    word; they are looked up as signs (`search.substring_matches`).  Runs of a source that no
    quote asks for go where they arise, if the asked ones are few enough to be sent there.
    """
    q = quotes.select("quote_id", T.squeezed(F.col("text")).alias("quote")).where("quote <> ''").withColumn("w", F.split("quote", " "))
    s = sources.select("source_id", T.squeezed(F.coalesce("text", F.lit(""))).alias("source"))
    split = s.withColumn("w", F.split("source", " "))
    inner = F.slice("w", F.lit(2), F.size("w") - 2)
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    size = {r["kind"]: r["n"] for r in q.groupBy(F.when(F.size("w") >= words + 2, "runs").when(F.size("w") > 2, "words").otherwise("none").alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    out = None

    def add(found: DataFrame) -> None:
        nonlocal out
        out = found if out is None else out.unionByName(found)

    def looked_up(asked: DataFrame, keys: DataFrame, n: int) -> DataFrame:
        side = asked.select("k", "quote_id")
        met = keys.join(F.broadcast(side) if n <= BROADCAST_KEYS else side, "k").select("source_id", "quote_id").distinct()
        return met.join(asked.select("quote_id", "quote"), "quote_id").join(s, "source_id").where(F.col("source").contains(F.col("quote"))).select("quote_id", "source_id")

    if "runs" in size or not size:
        runs = split.where(F.size("w") >= words).select("source_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.slice("w", i, words)))).alias("k"))
        add(looked_up(q.where(F.size("w") >= words + 2).select("quote_id", "quote", F.xxhash64(F.slice("w", 2, words)).alias("k")), runs, size.get("runs", 0)))
    if "words" in size:
        add(looked_up(q.where((F.size("w") > 2) & (F.size("w") < words + 2)).select("quote_id", "quote", longest.alias("k")), split.select("source_id", F.explode(F.array_distinct("w")).alias("k")), size["words"]))
    if "none" in size:
        short = q.where("size(w) <= 2").select(F.col("quote_id").alias("query_id"), F.col("quote").alias("word"))
        add(substring_matches(short, s.select(F.col("source_id").alias("text_id"), F.col("source").alias("text"))).select(F.col("query_id").alias("quote_id"), F.col("text_id").alias("source_id")))
    return out


def first_section(quotes: DataFrame, parts: DataFrame) -> DataFrame:
    """(quote_id, kind): the first section of the quote's own article that has it; quotes(quote_id, id, text), parts(id, pos, kind, text)."""
    q = quotes.select("quote_id", "id", T.squeezed(F.col("text")).alias("q"))
    p = parts.select("id", "pos", "kind", T.squeezed(F.col("text")).alias("p"))
    return q.join(p, "id").where((F.col("q") != "") & F.col("p").contains(F.col("q"))).groupBy("quote_id").agg(F.min_by("kind", "pos").alias("kind"))
