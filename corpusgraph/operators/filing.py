"""Filing: proposals become records, reviews become tags, verdicts and statements; every problem is reported at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.staging import staged


def link_key(url: Column) -> Column:
    """What two spellings of one address share; null for none."""
    return F.nullif(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "/+$", ""), F.lit(""))


def already_held(asked: DataFrame, resources: DataFrame) -> DataFrame:
    """(pos, held): the record that a proposal repeats; asked(pos, doi, arxiv, url), resources(id, pos, doi, arxiv_id, url, repository_url).

    Canonical identifiers are compared first, then addresses; the first record in corpus order counts.
    """
    mapped = lambda doi, arxiv: T.canonical_key(F.create_map(F.lit("doi"), doi, F.lit("arxiv"), arxiv))
    one = lambda stage, key: F.struct(F.lit(stage).alias("stage"), key.alias("key"))
    wanted = asked.select(F.col("pos").alias("ask"), F.explode(F.array(one(0, mapped(F.col("doi"), F.col("arxiv"))), one(1, link_key(F.col("url"))))).alias("k")).select("ask", "k.*").where("key is not null")
    there = resources.select("id", F.col("pos").alias("at"), F.explode(F.array(one(0, mapped(F.col("doi"), F.col("arxiv_id"))), one(1, link_key(F.col("url"))), one(1, link_key(F.col("repository_url"))))).alias("k")).select("id", "at", "k.*").where("key is not null")
    first = there.groupBy("stage", "key").agg(F.min_by("id", "at").alias("id"), F.min("at").alias("at"))
    hit = wanted.join(first, ["stage", "key"]).groupBy("ask").agg(F.min_by("id", F.struct("stage", "at")).alias("held"))
    return asked.select("pos").join(hit.withColumnRenamed("ask", "pos"), "pos", "left")


def read_topics(raw: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, codes, unknown) of raw(id, topics): codes between commas, semicolons and spaces, each once, by number; unknown ones by text."""
    split = raw.select("id", F.array_distinct(F.filter(F.split(F.coalesce("topics", F.lit("")), r"[,;\s]+"), lambda c: c != "")).alias("all"))
    each = split.select("id", F.explode("all").alias("code")).join(topics.select("code", F.lit(True).alias("known")), "code", "left")
    sort = F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct(T.code_key(F.col("code")).alias("k"), F.col("code"))))), lambda x: x["code"])
    lost = F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("code"))))
    none = F.array().cast("array<string>")
    return split.select("id").join(each.groupBy("id").agg(sort.alias("codes"), lost.alias("unknown")), "id", "left").select("id", F.coalesce("codes", none).alias("codes"), F.coalesce("unknown", none).alias("unknown"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def record_file(resource_id: Column) -> Column:
    """Name of the file that holds a record."""
    return F.concat(F.replace(F.regexp_replace(resource_id, "^resource:", ""), F.lit(":"), F.lit("-")), F.lit(".yml"))


def provenance(author: Column, issue: Column, resolved: Column, tagged: Column, described: bool = False) -> Column:
    """Where a record came from, and how far each part of it is to be trusted."""
    where, by, then, stop, end = map(F.lit, fixed.PROVENANCE_WHERE)
    how = F.lit(fixed.PROVENANCE_DESCRIBED) if described else F.when(resolved, fixed.PROVENANCE_RESOLVED).otherwise(fixed.PROVENANCE_UNRESOLVED)
    return F.concat(where, issue.cast("string"), by, author, then, how, stop, F.when(tagged, fixed.PROVENANCE_TAGGED).otherwise(fixed.PROVENANCE_UNTAGGED), end)


def paper_records(asked: DataFrame, works: DataFrame, papers: DataFrame, preprints: DataFrame, known_names: DataFrame | None = None, day: str | None = None) -> DataFrame:
    """Records of papers, from asked(pos, kind, ident, title, topics, author, issue) and three snapshots by ident.

    works(ident, title, abstract, authors, institutions, type, publication_date, and if there openalex_id, is_open_access,
    is_retracted), papers(ident, abstract, authors), preprints(ident, title, abstract, authors).  Titles: first source, the form,
    then the preprint; abstracts: first, second, preprint; a preprint's own byline counts before all.  `gaps` says what
    couldn't be filled, and whom the byline that was set aside named beside the preprint's own people (as `people.same_parts`
    tells them); `problem` is set instead of a record where no source and no form gives a title.
    Names are spelled as known_names(name, canonical) has them; `day` is when the records enter.
    """
    from . import people

    tag = lambda df, s: df.select("ident", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "ident"], F.lit(True).alias(f"{s}_found"))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    none = F.array().cast("array<string>")
    arxiv = F.col("kind") == "arxiv"
    x = lambda c: F.when(arxiv, c)  # noqa: E731  preprints speak for their own identifiers only
    second = some("w_abstract").isNull()  # the second source is asked only where the first has no abstract
    all_ = asked.join(tag(works, "w"), "ident", "left").join(tag(papers, "p"), "ident", "left").join(tag(preprints, "x"), "ident", "left")
    all_ = all_.withColumn("_indexed", F.coalesce(full("w_authors"), F.when(second, full("p_authors")), none)).withColumn("_own", x(full("x_authors")))
    all_ = all_.withColumns({"_a": people.name_parts(F.col("_indexed")), "_b": people.name_parts(F.col("_own"))}).withColumn("_wrong", F.when(F.col("_own").isNotNull(), people.unmatched(F.col("_a"), F.col("_b"))))
    if known_names is not None:
        byline = all_.select("pos", F.posexplode(F.coalesce("_own", "_indexed")).alias("_p", "name")).join(known_names, "name", "left")
        spelled = byline.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("canonical", "name").alias("n")))).alias("_s")).select("pos", F.array_distinct(F.transform("_s", lambda e: e["n"])).alias("_names"))
        all_ = all_.join(spelled, "pos", "left")
    else:
        all_ = all_.withColumn("_names", F.array_distinct(F.coalesce("_own", "_indexed")))
    title = F.coalesce(some("w_title"), some("title"), x(some("x_title")))
    abstract = F.coalesce(some("w_abstract"), some("p_abstract"), x(some("x_abstract")))
    kind = F.when(arxiv, "preprint")
    for a, b in fixed.PAPER_TYPES.items():
        kind = kind.when(F.col("w_type") == a, b)
    kind = kind.otherwise("peer-reviewed-paper")
    gap = lambda cond, text: F.when(cond, text if isinstance(text, Column) else F.lit(text))
    credited = F.concat(F.lit("first source credited "), F.array_join("_wrong", ", "), F.lit(", whom the preprint does not list"))
    gaps = F.array_compact(F.array(gap(F.col("w_found").isNull(), "first source has no such work"), gap(abstract.isNull(), "no abstract"), gap(F.size("_wrong") > 0, credited)))
    where = F.when(arxiv, F.concat(F.lit("resource:arxiv:"), "ident")).otherwise(F.concat(F.lit("resource:doi:"), slug(F.col("ident"))))
    more = lambda c, kind: (F.col(f"w_{c}") if c in works.columns else F.lit(None)).cast(kind)
    return all_.select(
        "pos", where.alias("id"), kind.alias("resource_type"), title.alias("title"), abstract.alias("abstract"), F.coalesce("_names", none).alias("authors"),
        F.coalesce("w_institutions", none).alias("organizations"), F.col("w_publication_date").alias("published_at"), F.concat(F.when(arxiv, "https://arxiv.org/abs/").otherwise("https://doi.org/"), "ident").alias("url"),
        F.when(arxiv, F.concat(F.lit("10.48550/arXiv."), "ident")).otherwise(F.col("ident")).alias("doi"), x(F.col("ident")).alias("arxiv_id"),
        F.regexp_replace(more("openalex_id", "string"), "^.*/", "").alias("openalex_id"), more("is_open_access", "boolean").alias("is_open_access"), more("is_retracted", "boolean").alias("is_retracted"),
        F.col("topics").alias("taxonomy_topics"), F.create_map(F.lit("artifact_type"), F.array(kind)).alias("facets"), F.lit("unreviewed").alias("review_status"),
        provenance(F.col("author"), F.col("issue"), F.col("w_found").isNotNull(), F.size("topics") > 0).alias("source_provenance"), F.lit(day).cast("string").alias("ingested_at"), gaps.alias("gaps"), F.when(title.isNull(), "no title").alias("problem"),
    )


def thing_records(asked: DataFrame, day: str | None = None) -> DataFrame:
    """Records of tools and platforms, from asked(pos, name, summary, url, license, agents, controls, maintainer, topics, author, issue)."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    blank = F.array_compact(F.array(*[F.when(some(c).isNull(), F.lit(c)) for c in ("agents", "controls", "maintainer")]))
    problem = F.when(some("name").isNull(), "no name").when(some("summary").isNull(), "no description")
    opened = F.when(some("license").isNull(), "unknown").otherwise("yes")
    profile = F.map_filter(F.create_map(F.lit("agent_model"), some("agents"), F.lit("human_controls"), some("controls"), F.lit("maintainer"), some("maintainer"), F.lit("open_source"), opened), lambda _, v: v.isNotNull())
    return asked.select(
        "pos", F.concat(F.lit("resource:tool:"), slug(F.col("name"))).alias("id"), F.lit("code-tool").alias("resource_type"), F.col("name").alias("title"), F.col("summary").alias("description"), "url",
        F.when(F.col("url").rlike(r"git(hub|lab)\.com"), F.col("url")).alias("repository_url"), F.nullif(F.trim(F.split(F.coalesce("license", F.lit("")), "·")[0]), F.lit("")).alias("license"),
        opened.alias("open_source"), F.col("topics").alias("taxonomy_topics"), F.create_map(F.lit("artifact_type"), F.array(F.lit("code-tool"))).alias("facets"), profile.alias("tool"), F.lit("unreviewed").alias("review_status"),
        provenance(F.col("author"), F.col("issue"), F.lit(False), F.size("topics") > 0, described=True).alias("source_provenance"), F.lit(day).cast("string").alias("ingested_at"), blank.alias("gaps"), problem.alias("problem"),
    )


def first_wins(asked: DataFrame) -> DataFrame:
    """(pos, winner) of asked(pos, key), several keys a pos: whom each would find held if all were taken in order of pos.

    The first of all its keys is taken (its winner is itself); what shares a key with it finds it held, by the first such one;
    the rest is settled likewise, round by round.  A key that very many share settles all of them in one round.
    """
    asked = staged(asked.where("key is not null").select("pos", "key").distinct(), "asked")
    left, taken = asked, asked.select("key", F.col("pos").alias("winner")).limit(0)
    while left.limit(1).count():
        first = left.groupBy("key").agg(F.min("pos").alias("first"))
        wins = left.join(first, "key").groupBy("pos").agg(F.bool_and(F.col("first") == F.col("pos")).alias("wins")).where("wins").select(F.col("pos").alias("winner"))
        keys = staged(left.join(wins, F.col("pos") == F.col("winner")).select("key", "winner"), "taken")
        taken = taken.unionByName(keys)
        held = left.join(keys, "key").select("pos").distinct()
        left = staged(left.join(held, "pos", "left_anti"), "asked")
    return asked.join(taken, "key").groupBy("pos").agg(F.min("winner").alias("winner"))


def process(proposals: DataFrame, resources: DataFrame, topics: DataFrame, works: DataFrame, papers: DataFrame, preprints: DataFrame, known_names: DataFrame | None = None, day: str | None = None) -> DataFrame:
    """(pos, outcome, id, detail, record) of proposals(pos, identifier, name, title, summary, topics, author, issue, and if there license, agents, controls, maintainer): added, held, or refused.

    A form without an identifier and a name, an identifier that is none, an unknown topic, and a record without a title are
    refused.  A batch gives what its proposals would give one at a time, in order of pos: of two that make one record the
    first adds it, the second finds it held.  `record` is the whole record of what is added, null elsewhere.
    """
    none = F.lit(None).cast("string")
    read = proposals.withColumn("i", T.identify(F.col("identifier")))
    void = (F.coalesce("identifier", F.lit("")) == "") & (F.coalesce("name", F.lit("")) == "")
    bad = read.select("pos", F.when(void, "nothing to add").when(F.col("i.kind") == "error", "not an identifier").alias("why")).where("why is not null")
    good = read.join(bad.select("pos"), "pos", "left_anti").withColumns({"kind": F.col("i.kind"), "ident": F.col("i.id")})
    asks = good.select("pos", F.when(F.col("kind") == "doi", F.col("ident")).otherwise(none).alias("doi"), F.when(F.col("kind") == "arxiv", F.col("ident")).otherwise(none).alias("arxiv"), F.when(F.col("kind") == "url", F.col("ident")).otherwise(none).alias("url"))
    state = already_held(asks, resources).join(read_topics(good.select(F.col("pos").alias("id"), "topics"), topics).withColumnRenamed("id", "pos"), "pos")
    good = staged(good.drop("topics", "i").join(state, "pos"), "proposals")
    open_ = good.where("held is null and size(unknown) = 0").withColumnRenamed("codes", "topics")
    made = paper_records(open_.where("kind <> 'url'").select("pos", "kind", "ident", "title", "topics", "author", "issue"), works, papers, preprints, known_names, day)
    given = {c: F.col(c) if c in proposals.columns else none for c in ("license", "agents", "controls", "maintainer")}
    things = open_.where("kind = 'url'").withColumns(given).select("pos", F.coalesce(F.nullif("name", F.lit("")), "title").alias("name"), "summary", F.col("ident").alias("url"), *given, "topics", "author", "issue")
    whole = made.unionByName(thing_records(things, day), allowMissingColumns=True)
    fields = [c for c in whole.columns if c not in ("pos", "problem")]
    made = staged(whole.select("pos", "id", "problem", F.struct(*fields).alias("record")).join(resources.select("id", F.lit(True).alias("there")).distinct(), "id", "left"), "made")
    fresh = made.where("problem is null and there is null")
    keys = F.explode(F.array_compact(F.array_distinct(F.array(F.concat(F.lit("id "), "id"), F.concat(F.lit("url "), link_key(F.col("record.url"))), F.concat(F.lit("url "), link_key(F.col("record.repository_url")))))))
    order = first_wins(fresh.select("pos", keys.alias("key")))
    owner = order.join(made.select(F.col("pos").alias("winner"), F.col("id").alias("owner")), "winner").select("pos", "winner", "owner")
    told = made.join(owner, "pos", "left")
    adds = F.coalesce(F.col("winner") == F.col("pos"), F.lit(False))
    out = told.select("pos", F.when(F.col("problem").isNotNull(), "refused").when(adds, "added").otherwise("held").alias("outcome"), F.when(F.col("problem").isNull(), F.coalesce("owner", "id")).alias("id"), F.col("problem").alias("detail"), F.when(adds, F.col("record")).alias("record"))
    nothing = F.lit(None).cast(dict(made.dtypes)["record"])
    shut = good.where("held is not null or size(unknown) > 0").select("pos", F.when(F.col("held").isNotNull(), "held").otherwise("refused").alias("outcome"), F.col("held").alias("id"), F.when(F.col("held").isNull(), F.concat(F.lit("not taxonomy codes: "), F.array_join("unknown", ", "))).alias("detail"), nothing.alias("record"))
    return out.unionByName(shut).unionByName(bad.select("pos", F.lit("refused").alias("outcome"), none.alias("id"), F.col("why").alias("detail"), nothing.alias("record")))


def seed_records(papers: DataFrame, dois: DataFrame, platforms: DataFrame) -> DataFrame:
    """Seeds in three shapes as records: papers(arxiv, title), dois(doi, title), platforms(id, title, url); each may have topics, date, note, borrowed, and platforms a type."""
    optional = {"topics": "array<string>", "date": "string", "note": "string", "borrowed": "boolean", "type": "string"}
    get = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast(optional[c])

    def shape(df: DataFrame, ident: Column, kind: Column, url: Column, doi: Column, arxiv: Column) -> DataFrame:
        return df.select(
            ident.alias("id"), kind.alias("resource_type"), "title", url.alias("url"), doi.alias("doi"), arxiv.alias("arxiv_id"), get(df, "date").alias("published_at"), F.nullif(F.trim(get(df, "note")), F.lit("")).alias("description"),
            F.coalesce(get(df, "topics"), F.array().cast("array<string>")).alias("taxonomy_topics"), F.create_map(F.lit("artifact_type"), F.array(kind)).alias("facets"), F.coalesce(get(df, "borrowed"), F.lit(False)).alias("is_borrowed_background"), F.lit("unreviewed").alias("review_status"),
        )

    none = F.lit(None).cast("string")
    a = shape(papers, F.concat(F.lit("resource:arxiv:"), "arxiv"), F.lit("preprint"), F.concat(F.lit("https://arxiv.org/abs/"), "arxiv"), F.concat(F.lit("10.48550/arXiv."), "arxiv"), F.col("arxiv"))
    b = shape(dois, F.concat(F.lit("resource:doi:"), F.lower(F.translate("doi", "/.", "--"))), F.lit("peer-reviewed-paper"), F.concat(F.lit("https://doi.org/"), "doi"), F.col("doi"), none)
    c = shape(platforms, F.concat(F.lit("resource:platform:"), "id"), F.coalesce(get(platforms, "type"), F.lit("code-tool")), F.col("url"), none, none)
    return a.unionByName(b).unionByName(c)


def unknown_tags(records: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, unknown) of records(id, taxonomy_topics) filed under what is no topic, held ones too: a run that finds any has failed."""
    lost = records.select("id", F.posexplode("taxonomy_topics").alias("p", "code")).join(topics.select("code"), "code", "left_anti")
    return lost.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "code"))), lambda x: x["code"]).alias("unknown"))


def expand_seeds(papers: DataFrame, dois: DataFrame, platforms: DataFrame, held: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """The records of seeds that the corpus doesn't hold.  With topics(code), seeds under unknown ones stop it, all named at once."""
    every = seed_records(papers, dois, platforms)
    if topics is not None and (bad := unknown_tags(every, topics).orderBy("id").limit(20).collect()):  # twenty rows at most
        raise ValueError("tags not in the taxonomy: " + "; ".join(f"{r['id']}: {', '.join(r['unknown'])}" for r in bad))
    return every.join(held.select("id"), "id", "left_anti")


def filing_problems(filed: DataFrame, records: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, problem) of filed(id, topics, numbers, and verdict if there): all at once, the first of each entry; `numbers` are codes read as numbers, unquoted.

    With a column `issue` the problems carry it.
    """
    own = ["issue"] if "issue" in filed.columns else []
    codes = filed.select(*own, "id", F.posexplode("topics").alias("p", "code")).join(topics.select("code"), "code", "left_anti")
    named = codes.groupBy(*own, "id").agg(F.array_sort(F.collect_list(F.struct("p", "code"))).alias("x")).select(*[F.col(c).alias(f"_{c}") for c in own], F.col("id").alias("_id"), F.array_join(F.transform("x", lambda c: c["code"]), ", ").alias("_codes"))
    same = F.col("id") == F.col("_id")
    for c in own:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = filed.join(records.select("id", F.lit(True).alias("there")).distinct(), "id", "left").join(named, same, "left")
    verdict = F.col("verdict") if "verdict" in filed.columns else F.lit(None).cast("string")
    strange = verdict.isNotNull() & ~verdict.isin("filed", *fixed.RECORD_VERDICTS)
    what = (
        F.when(F.col("there").isNull(), F.lit("not a record in this corpus"))
        .when(F.size("numbers") > 0, F.concat(F.lit("topic codes must be quoted: "), F.array_join("numbers", ", ")))
        .when(F.col("_codes").isNotNull(), F.concat(F.lit("not taxonomy codes: "), "_codes"))
        .when(strange, F.concat(F.lit("unknown verdict "), verdict))
    )
    return known.select(*own, "id", what.alias("problem")).where("problem is not null")


def standing(entries: DataFrame, problems: DataFrame, by: tuple[str, ...] = ("issue",)) -> DataFrame:
    """entries without those of a group that has a problem: one problem voids all entries of its part of its issue."""
    bad = problems.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    same = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    return entries.join(bad, same, "left_anti")


def filed_records(filed: DataFrame) -> DataFrame:
    """(.., id, topics, verdict, unsure, note, reviewed_on) of checked filed(id, topics, verdict, unsure, note, reviewed_on): what is kept of each.

    Codes once, by number; `filed` is the common case and isn't stored; a note without the blanks around it.
    """
    ranked = F.array_sort(F.transform(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))), lambda c: F.struct(T.code_key(c).alias("k"), c.alias("c"))))
    kept = {
        "topics": F.transform(ranked, lambda x: x["c"]),
        "verdict": F.when(F.col("verdict").isin(*fixed.RECORD_VERDICTS), F.col("verdict")),
        "unsure": F.when(F.coalesce(F.col("unsure").cast("boolean"), F.lit(False)), F.lit(True)),
        "note": F.nullif(F.trim("note"), F.lit("")),
    }
    return filed.withColumns(kept)


def flagged(kept: DataFrame) -> DataFrame:
    """(flag, id, note) of kept(id, verdict, note): records that reviewers put aside, and all notes."""
    aside = kept.where(F.col("verdict").isin(*fixed.RECORD_VERDICTS)).select(F.col("verdict").alias("flag"), "id", F.lit(None).cast("string").alias("note"))
    return aside.unionByName(kept.where("note is not null").select(F.lit("note").alias("flag"), "id", "note"))


def flagged_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts (id, verdict) that speak against how a claim was extracted."""
    return verdicts.where(F.col("verdict").isin(*fixed.FLAGGED_VERDICTS)).select("id", "verdict")


def verdict_problems(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, problem) of verdicts(id, verdict)."""
    held = verdicts.join(claims.select("id", F.lit(True).alias("there")), "id", "left")
    what = F.when(F.col("there").isNull(), F.lit("not a claim in this corpus")).when(~F.coalesce(F.col("verdict").isin(fixed.CLAIM_VERDICTS), F.lit(False)), F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit("none"))))
    return held.select("id", what.alias("problem")).where("problem is not null")


def merge_verdicts(gold: DataFrame, new: DataFrame) -> DataFrame:
    """(id, verdict, change): new(id, verdict) replaces gold(id, verdict); what isn't judged anew stays."""
    both = gold.withColumnRenamed("verdict", "old").join(new, "id", "full_outer")
    change = F.when(F.col("verdict").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("verdict"), "unchanged").otherwise("changed")
    return both.select("id", F.coalesce("verdict", "old").alias("verdict"), change.alias("change"))


def new_statements(statements: DataFrame, claims: DataFrame, parts: DataFrame, records: DataFrame) -> DataFrame:
    """(id, issue, resource_id, text, quote, type, read_from, extraction_method, problem, voided) of statements(issue, author, resource_id, pos, text, quote, type).

    Statements on what is none of records(id), texts under ten and quotes under fifteen signs, unknown types (none is a finding),
    and quotes that the record's full text, where parts(id, pos, kind, text) has it, doesn't hold are problems; one voids
    all statements of its issue.  Those that stand are numbered after the record's claims, in order of issue and pos.
    """
    from .fulltext import first_section

    own = ["issue", "resource_id", "pos"]
    s = statements.withColumns({"text": F.trim(F.coalesce("text", F.lit(""))), "quote": F.trim(F.coalesce("quote", F.lit(""))), "type": F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("finding"))})
    s = s.withColumn("q", F.to_json(F.struct(*own)))
    found = first_section(s.select(F.col("q").alias("quote_id"), F.col("resource_id").alias("id"), F.col("quote").alias("text")), parts).toDF("q", "kind")
    read = s.join(found, "q", "left").join(parts.select(F.col("id").alias("resource_id"), F.lit(True).alias("full")).distinct(), "resource_id", "left").join(records.select(F.col("id").alias("resource_id"), F.lit(True).alias("there")).distinct(), "resource_id", "left")
    problem = (
        F.when(F.col("there").isNull(), "not a record in this corpus").when(F.length("text") < 10, "text too short").when(F.length("quote") < 15, "quote too short")
        .when(~F.col("type").isin(fixed.CLAIM_TYPES), "unknown type").when(F.col("full") & F.col("kind").isNull(), "quote is not in the paper")
    )
    judged = staged(read.withColumn("problem", problem), "statements")
    stand = standing(judged, judged.where("problem is not null"))
    count = claims.groupBy("resource_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("resource_id").orderBy("issue", "pos"))
    ident = F.concat(F.lit("claim:"), F.regexp_replace(F.col("resource_id"), "^resource:", ""), F.lit(":"), (F.coalesce("n", F.lit(0)) + F.col("place")).cast("string"))
    numbered = stand.withColumn("place", place).join(count, "resource_id", "left").select("q", ident.alias("id"))
    method = F.concat(F.lit("written by @"), "author", F.coalesce(F.concat(F.lit(" in issue #"), F.nullif("issue", F.lit(0)).cast("string")), F.lit("")))
    return judged.join(numbered, "q", "left").select("id", "issue", "resource_id", "text", "quote", "type", F.coalesce("kind", F.lit("by hand")).alias("read_from"), method.alias("extraction_method"), "problem", F.col("id").isNull().alias("voided"))
