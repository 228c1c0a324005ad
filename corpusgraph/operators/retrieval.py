"""BM25 classification of texts into coded topics, and the corpus searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.staging import staged
from .search import substring_matches


class TopicIndex:
    """Inverted index of topics(code, text): a row for each term of a topic, with its whole BM25 contribution.

    A query term counts once, so a topic's score is the sum of the weights of the terms it shares.  Weights are worked out once and
    counted; texts' words meet them where they arise if they are few enough to be sent there, as those of a taxonomy are.
    """

    #: Weights (some fifty bytes each) that are broadcast at most.
    BROADCAST_WEIGHTS = 500_000

    def __init__(self, topics: DataFrame) -> None:
        words = _terms(topics)
        terms = words.select("code", F.explode("t").alias("term")).groupBy("code", "term").agg(F.count(F.lit(1)).alias("tf"))
        lengths = words.select("code", F.size("t").alias("len"))
        stats = lengths.agg(F.count(F.lit(1)).alias("topics"), F.avg("len").alias("mean_len"))  # one row
        df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.ln(1 + (F.col("topics") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("len") / F.when(F.col("mean_len") == 0, F.lit(1.0)).otherwise(F.col("mean_len")))
        weights = terms.join(df, "term").join(lengths, "code").crossJoin(F.broadcast(stats)).select("code", "term", idf.alias("idf"), (idf * F.col("tf") * (fixed.BM25_K1 + 1) / norm).alias("weight"))
        weights = staged(weights, "weights")
        self.weights = F.broadcast(weights) if weights.count() <= self.BROADCAST_WEIGHTS else weights

    def score(self, texts: DataFrame, phrases: bool = True) -> DataFrame:
        """(id, code, score) of texts(id, text) for each topic that shares a term."""
        asked = _terms(texts, phrases).select("id", F.explode(F.array_distinct("t")).alias("term"))
        return asked.join(self.weights, "term").groupBy("id", "code").agg(F.round(F.sum("weight"), 6).alias("score"))

    def matched(self, texts: DataFrame, most: int = 6) -> DataFrame:
        """(id, code, matched): the rarest shared terms.

        Texts are dealt by id, which is less than all the terms that they share with topics: these are gathered in place.
        """
        asked = _terms(texts.repartition("id")).select("id", F.explode(F.array_distinct("t")).alias("term"))
        both = asked.join(self.weights, "term").groupBy("id", "code").agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("i"), "term"))).alias("m"))
        return both.select("id", "code", F.slice(F.transform("m", lambda x: x["term"]), 1, most).alias("matched"))

    def classify(self, texts: DataFrame, limit: int = 6, min_score: float = 4.0, leaves_only: bool = False) -> DataFrame:
        """(id, code, score, rank): topics above the threshold, without those that lie above another one found."""
        found = self.score(texts).where(F.col("score") >= min_score)
        if leaves_only:
            found = found.where(T.depth(F.col("code")) > 0)
        # one array an id: what lies above another code goes, the best are kept; texts are read and scored once
        # (what stands above is an aggregate of its own, so that no lambda works it out again for each code)
        one = F.struct((-F.col("score")).alias("s"), T.code_key(F.col("code")).alias("k"), "code", "score")
        listed = found.groupBy("id").agg(F.collect_list(one).alias("x"), F.collect_set(T.ancestors(F.col("code"))).alias("up"))
        kept = listed.select("id", F.slice(F.array_sort(F.filter("x", lambda c: ~F.exists("up", lambda u: F.array_contains(u, c["code"])))), 1, limit).alias("x"))
        return kept.select("id", F.posexplode("x").alias("p", "x")).select("id", "x.code", "x.score", (F.col("p") + 1).alias("rank"))


def _terms(texts: DataFrame, phrases: bool = True) -> DataFrame:
    """texts with their terms in `t`.  Words are a column of their own: phrases read them three times."""
    words = texts.withColumn("t", T.tokens(F.col("text"))).drop("text")
    return words.withColumn("t", T.with_phrases(F.col("t"))) if phrases else words


def prune_ancestors(found: DataFrame) -> DataFrame:
    """Drops a code if a code below it is found for the same id: an equi-join on exploded ancestors."""
    above = found.select("id", F.explode(T.ancestors(F.col("code"))).alias("code")).distinct()
    return found.join(above, ["id", "code"], "left_anti")


def top_k(found: DataFrame, limit: int) -> DataFrame:
    """rank by score, then by the code's numbers; `limit` for each id."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), T.code_key(F.col("code")))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def suggestion_band(ranked: DataFrame, share: float = 0.7, least: int = 2, most: int = 6) -> DataFrame:
    """(.., suggested): of rows with rank, the first two and those among six with 70 % of the best score."""
    best = F.max("score").over(Window.partitionBy("id"))
    return ranked.withColumn("suggested", (F.col("rank") <= least) | ((F.col("rank") <= most) & (F.col("score") >= share * best)))


def search_topics(topics: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """(code, title, score) of topics(code, title, subpoints, aliases) that a word names."""
    q = (term or "").strip().lower()
    if len(q) < 2:
        return topics.limit(0).select("code", "title", F.lit(0).alias("score"))
    names = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower)
    hay = F.lower(F.concat_ws(" ", F.col("title"), F.concat_ws(" ", "subpoints"), F.concat_ws(" ", "aliases")))
    n = lambda cond, k: F.when(cond, F.lit(k)).otherwise(F.lit(0))
    score = n(F.array_contains(names, q), 6) + n(F.col("code").startswith(q), 5) + n(F.lower("title").startswith(q), 3) + n(hay.contains(q), 2)
    return topics.select("code", "title", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "code").limit(limit)


def search_records(records: DataFrame, term: str, limit: int | None = 10) -> DataFrame:
    """(id, score) of records(id, title, authors, abstract, description) that hold a word."""
    q = (term or "").strip().lower()
    if len(q) < 2:
        return records.limit(0).select("id", F.lit(0).alias("score"))
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    author = F.coalesce(F.exists("authors", lambda a: F.lower(a).contains(q)), F.lit(False))
    score = F.when(has("title"), 4).otherwise(0) + F.when(author, 3).otherwise(0) + F.when(has("abstract") | has("description"), 1).otherwise(0)
    found = records.select("id", score.alias("score")).where("score > 0")
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(limit)


#: Words of a need that are this long are looked for in what the mirror says.
MIRROR_WORD = 4


def mirror_matches(need: DataFrame, mirror: DataFrame, first: int | None = None) -> DataFrame:
    """(need, entry) of need(id, text) and mirror(entry, name, description): entries whose name or description contains a word of the need.

    `first` keeps, of each word, the first entries by (pos, entry as text): the first ones of a need are among those of its words.
    Words are what stands between white space, in lower case, of MIRROR_WORD signs or more; they are found inside other words too.
    """
    words = need.select("id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))).alias("word")).where(F.length("word") >= MIRROR_WORD)
    told = mirror.select(F.col("entry").alias("text_id"), F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))).alias("text"))
    found = substring_matches(words.select(F.col("word").alias("query_id"), "word").distinct(), told)
    if first is not None:
        order = Window.partitionBy("query_id").orderBy("pos", F.col("text_id").cast("string"))
        at = mirror.select(F.col("entry").alias("text_id"), "pos").groupBy("text_id").agg(F.min("pos").alias("pos"))
        found = found.join(at, "text_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= first)
    return words.join(found, F.col("word") == F.col("query_id")).select(F.col("id").alias("need"), F.col("text_id").alias("entry")).distinct()


def tools_for(index: TopicIndex, need: DataFrame, resources: DataFrame, mirror: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """(need, kind, place, id) of need(id, text): what bears on each need, `limit` of a kind at most, in the order of the corpus.

    kind `topic`: the branches that the words point at; `tool` and `paper`: resources(id, pos, resource_type, taxonomy_topics,
    and has_tool if there is one) filed under these; `unassessed`: entries of mirror(entry, pos, name, description) that contain a word of
    the need.  A need that no branch fits gets nothing.  ids are texts.
    """
    topics = staged(index.classify(need, 4, 0.5).select(F.col("id").alias("need"), F.col("code").alias("topic"), "rank"), "topics")
    profiled = F.col("has_tool") if "has_tool" in resources.columns else F.lit(False)
    kind = F.when(F.coalesce(profiled, F.lit(False)) | F.coalesce(F.col("resource_type").isin(fixed.TOOL_TYPES), F.lit(False)), "tool").otherwise("paper")
    filed = resources.select(F.col("id").cast("string").alias("id"), "pos", kind.alias("kind"), F.explode("taxonomy_topics").alias("topic"))
    found = filed.join(topics.select("need", "topic"), "topic").select("need", "kind", "pos", "id").distinct()
    if mirror is not None:
        told = mirror_matches(need, mirror, limit).join(topics.select("need").distinct(), "need", "left_semi").join(mirror.select("entry", "pos"), "entry")
        found = found.unionByName(told.select("need", F.lit("unassessed").alias("kind"), "pos", F.col("entry").cast("string").alias("id")))
    place = F.row_number().over(Window.partitionBy("need", "kind").orderBy("pos", "id"))
    first = found.withColumn("place", place).where(F.col("place") <= limit).select("need", "kind", "place", "id")
    return topics.select("need", F.lit("topic").alias("kind"), F.col("rank").alias("place"), F.col("topic").alias("id")).unionByName(first)


def resource_text(title: Column, description: Column, abstract: Column) -> Column:
    return F.concat_ws(" ", *[F.when(c != "", c) for c in (title, description, abstract)])
