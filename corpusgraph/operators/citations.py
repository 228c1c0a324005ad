"""Citation analysis over refs(id, ref): coupling, co-citation, held citations, connectivity.

Pairs that share `min_shared` items meet by a rare item, or by two frequent ones (`sharing_pairs`): a reference that a third of all works
cite makes no candidates by itself, and what a key has many of is dealt to pairs of chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import staged

#: Members of an item that one task pairs with each other.
CHUNK = 2_000
#: Items of a set whose twos are made.
LIGHT = 64


def sharing_pairs(members: DataFrame, min_shared: int = 2, chunk: int = CHUNK, light: int = LIGHT) -> DataFrame:
    """(source, target, shared, n_source, n_target): sets of members(id, item) with source < target that share `min_shared` items or more, exactly.

    An item that few sets hold, no more than a set has items on the average, makes a pair of each two of them.  The sets of a
    frequent item meet by two frequent items that they share, so it makes no pairs of sets that share nothing else; a
    set of more than `light` items, which holds too many twos, meets the others of its frequent items one by one.  What is met is
    counted, and the count is exact: of m frequent items shared, m (m - 1) / 2 twos meet.  Only a pair that met by rare items alone may share one frequent item more;
    it is compared in full if its signatures of 64 bits overlap.  A key with more than `chunk` sets is dealt to tasks, one for each pair of its chunks.
    """
    if min_shared < 1:
        raise ValueError("min_shared must be at least 1")
    own = members.select("id", "item").where("id is not null and item is not null").distinct()
    often = own.groupBy("item").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("item").alias("often"), "k")
    # every set with its items that others hold too, rarest first, and the number of all
    known = own.join(often, F.col("item") == F.col("often"), "left")
    sets = known.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "item")))).alias("x")).where(F.size("x") >= min_shared)
    sets = staged(sets, "sets")
    size = F.size("x").cast("double")
    few = sets.where(F.size("x") <= light).agg((F.sum(size * size) / F.sum(size)).alias("mean")).head()["mean"] or 0.0
    limit = F.lit(few if min_shared > 1 else float("inf"))
    frequent = F.filter("x", lambda e: e["k"] > limit)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    sets = sets.select("id", "n", "x", frequent.alias("often"), (F.size("x") > light).alias("heavy"))
    kinds = sets.agg(F.bool_or(F.size("often") > 0).alias("often"), F.bool_or(F.size("often") < F.size("x")).alias("rare"), F.bool_or(F.col("heavy") & (F.size("often") > 0)).alias("heavy")).head()
    chunks = lambda n: F.ceil(n / chunk).cast("int")
    dealt = lambda df: df.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    met = []

    def add(pairs: DataFrame, rare: int, may) -> None:
        up = F.col("id_a") < F.col("id_b")
        met.append(pairs.select(F.when(up, F.col("id_a")).otherwise(F.col("id_b")).alias("source"), F.when(up, F.col("id_b")).otherwise(F.col("id_a")).alias("target"), F.lit(rare).alias("one"), may.alias("may")))

    def each_two(rows: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
        """Each two rows of a key, once; rows(id, *keys, chunks, *more)."""
        rows = dealt(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.select("id", *keys, *more, "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
        a, b = (rows.select(*keys, "lo", "hi", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "mine", *more)]) for s in "ab")
        # merged: rows are many times larger than the file that Spark judges their size by
        return a.join(b.hint("merge"), [*keys, "lo", "hi"]).where("mine_a = lo and mine_b = hi and (lo < hi or id_a < id_b)")

    if kinds["rare"]:
        sign = F.when(F.col("heavy"), F.lit(0).cast("long")).otherwise(F.aggregate("often", F.lit(0).cast("long"), lambda s, e: s.bitwiseOR(bit(e["item"]))))
        rows = sets.select("id", sign.alias("sign"), F.explode(F.filter("x", lambda e: e["k"] <= limit)).alias("e")).select("id", "sign", "e.item", chunks(F.col("e.k")).alias("chunks"))
        add(each_two(rows, ["item"], ["sign"]), 1, F.col("sign_a").bitwiseAND(F.col("sign_b")) != 0)
    if kinds["often"]:
        two = F.flatten(F.transform("often", lambda e, i: F.transform(F.slice("often", i + 2, F.size("often")), lambda f: F.struct(e["k"].alias("k"), e["item"].alias("item"), f["item"].alias("next")))))
        rows = sets.where("not heavy").select("id", F.explode(two).alias("e")).select("id", "e.*")
        # only a two whose rarer item has more than `chunk` sets may have so many
        many = rows.where(F.col("k") > chunk)
        hot = many.groupBy("item", "next").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > chunk)
        rows = rows.where(F.col("k") <= chunk).select("id", "item", "next", F.lit(1).alias("chunks")).unionByName(many.join(hot, ["item", "next"], "left").select("id", "item", "next", F.coalesce(chunks(F.col("c")), F.lit(1)).alias("chunks")))
        add(each_two(rows, ["item", "next"], []), 0, F.lit(False))
    if kinds["heavy"]:
        rows = dealt(sets.select("id", "heavy", F.explode("often").alias("e")).select("id", "heavy", "e.item", chunks(F.col("e.k")).alias("chunks")))
        large = rows.where("heavy").select("item", F.col("id").alias("id_a"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("mine"))
        add(large.join(rows.select("item", "mine", F.col("id").alias("id_b"), "heavy"), ["item", "mine"]).where("not heavy or id_a < id_b"), 1, F.lit(False))
    if not met:
        return sets.select(F.col("id").alias("source"), F.col("id").alias("target"), F.col("n").alias("shared"), F.col("n").alias("n_source"), F.col("n").alias("n_target")).limit(0)
    events = met[0]
    for more in met[1:]:
        events = events.unionByName(more)
    pairs = events.groupBy("source", "target").agg(F.sum("one").alias("ones"), F.count_if(F.col("one") == 0).alias("twos"), F.bool_or("may").alias("may"))
    of_twos = F.when(F.col("twos") > 0, F.round((1 + F.sqrt(1 + 8 * F.col("twos"))) / 2).cast("long")).otherwise(F.lit(0).cast("long"))
    open_ = F.col("may") & (F.col("twos") == 0)
    counted = pairs.select("source", "target", (F.col("ones") + of_twos).alias("shared"), open_.alias("open")).where((F.col("shared") >= min_shared) | (F.col("open") & (F.col("shared") >= min_shared - 1)))
    side = lambda s, *c: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(x).alias(f"{x}_{s}") for x in c])
    known = lambda df, *c: df.join(side("source", *c), "source").join(side("target", *c), "target")
    if not (kinds["rare"] and kinds["often"]):
        return known(counted).select("source", "target", "shared", "n_source", "n_target")
    counted = staged(counted, "counted")
    shared = F.col("shared") + F.size(F.array_intersect("often_source", "often_target"))
    compared = known(counted.where("open"), "often").select("source", "target", shared.alias("shared"), "n_source", "n_target").where(F.col("shared") >= min_shared)
    return known(counted.where("not open")).select("source", "target", "shared", "n_source", "n_target").unionByName(compared)


def bibliographic_coupling(refs: DataFrame, min_shared: int = 2) -> DataFrame:
    """(source, target, shared, score): pairs of works by shared references; score is Jaccard."""
    pairs = sharing_pairs(refs.select("id", F.col("ref").alias("item")), min_shared)
    return pairs.select("source", "target", "shared", (F.col("shared") / (F.col("n_source") + F.col("n_target") - F.col("shared"))).alias("score"))


def co_citation_counts(refs: DataFrame) -> DataFrame:
    return refs.select("id", "ref").where("ref is not null").distinct().groupBy("ref").agg(F.count(F.lit(1)).alias("cited_by"))


def co_cited_pairs(refs: DataFrame, min_shared: int = 2) -> DataFrame:
    """(left, right, shared, score): references cited together; score is the overlap coefficient.

    The same join the other way round: a reference is the set of the works that cite it.
    """
    pairs = sharing_pairs(refs.select(F.col("ref").alias("id"), F.col("id").alias("item")), min_shared)
    return pairs.select(F.col("source").alias("left"), F.col("target").alias("right"), "shared", (F.col("shared") / F.least("n_source", "n_target")).alias("score"))


def citation_pairs(refs: DataFrame, held: DataFrame) -> DataFrame:
    """(citing, cited) between held works; held(id, key, pos): of one key the last row owns it."""
    last = Window.partitionBy("key").orderBy(F.desc("pos"))
    owner = held.where("key is not null").withColumn("r", F.row_number().over(last)).where("r = 1").select(F.col("id").alias("cited"), F.col("key").alias("ref"))
    citing = refs.join(held.select("id").distinct(), "id", "left_semi")
    return citing.join(owner, "ref").where("id <> cited").select(F.col("id").alias("citing"), "cited").distinct()


def connectivity(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, shared, cited_by): references a candidate shares with the corpus, and corpus works citing it; candidates(id, ref), ref may be null."""
    known = refs.select("ref").distinct().withColumn("known", F.lit(1))
    shared = candidates.select("id", "ref").distinct().join(known, "ref", "left").groupBy("id").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("shared"))
    cited = co_citation_counts(refs).select(F.col("ref").alias("id"), "cited_by")
    return shared.join(cited, "id", "left").select("id", "shared", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def similarity_edges(refs: DataFrame, resolve: DataFrame | None = None, min_shared: int = 2, limit: int | None = None) -> DataFrame:
    """SIMILAR_TO edges of coupled works, by score; resolve(from_id, to_id) renames ends and drops what it doesn't hold."""
    pairs = bibliographic_coupling(refs, min_shared)
    if limit:
        pairs = pairs.orderBy(F.desc("score"), F.desc("shared"), "source", "target").limit(limit)
    if resolve is not None:
        pairs = pairs.join(resolve.toDF("source", "s"), "source").join(resolve.toDF("target", "t"), "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "shared", "score")
    return pairs.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("SIMILAR_TO").alias("relation"), F.lit("bibliographic-coupling").alias("method"), "score")


def related_records(edges: DataFrame, cites: DataFrame, record) -> DataFrame:
    """(other, kind, score) of one record: what it cites, what cites it, and what is coupled with it."""
    coupled = edges.where((F.col("source_id") == record) | (F.col("target_id") == record)).select(F.when(F.col("source_id") == record, F.col("target_id")).otherwise(F.col("source_id")).alias("other"), F.lit("coupled").alias("kind"), "score")
    out = cites.where(F.col("citing") == record).select(F.col("cited").alias("other"), F.lit("cites").alias("kind"), F.lit(None).cast("double").alias("score"))
    back = cites.where(F.col("cited") == record).select(F.col("citing").alias("other"), F.lit("cited_by").alias("kind"), F.lit(None).cast("double").alias("score"))
    return out.unionByName(back).unionByName(coupled)


def structural_candidates(refs: DataFrame, known: DataFrame, min_count: int = 2, limit: int | None = None) -> DataFrame:
    """Works that the corpus cites often and doesn't hold; known(ref)."""
    out = co_citation_counts(refs).where(F.col("cited_by") >= min_count).join(known.select("ref"), "ref", "left_anti")
    return out.orderBy(F.desc("cited_by"), "ref").limit(limit) if limit else out


def expand_neighborhood(seeds: DataFrame, links: DataFrame, works: DataFrame, known: DataFrame, min_score: int = 3, per_seed: int = 25) -> DataFrame:
    """Works one hop from the seeds, both ways, that score in scope; seeds(id, pos), links(citing, cited, pos), works(id, title, abstract, cited_by), known(id).

    Of each seed the first `per_seed` references and its most cited citers; the first way a work is found is kept.
    """
    from ..functions.text import scope_score

    back = seeds.join(links, seeds.id == links.citing).select(F.col("cited").alias("work"), seeds.id.alias("found_via"), seeds.pos.alias("seed_pos"), F.lit(0).alias("way"), links.pos.alias("p"), F.lit(0).alias("c"))
    fwd = seeds.join(links, seeds.id == links.cited).join(works.select(F.col("id").alias("w"), F.col("cited_by").alias("n")), F.col("citing") == F.col("w")).select(F.col("citing").alias("work"), seeds.id.alias("found_via"), seeds.pos.alias("seed_pos"), F.lit(1).alias("way"), links.pos.alias("p"), (-F.col("n")).alias("c"))
    near = back.unionByName(fwd).withColumn("r", F.row_number().over(Window.partitionBy("found_via", "way").orderBy("c", "p", "work"))).where(F.col("r") <= per_seed)
    first = near.withColumn("f", F.row_number().over(Window.partitionBy("work").orderBy("seed_pos", "way", "r"))).where("f = 1")
    first = first.join(known.select(F.col("id").alias("work")), "work", "left_anti").join(works.withColumnRenamed("id", "work"), "work")
    scored = first.withColumn("s", scope_score(F.col("title"), F.col("abstract"))).select("work", "title", "cited_by", "found_via", "s.score", "s.reasons")
    return scored.where(F.col("score") >= min_score)
