"""Sources: Markdown taxonomies and tables, YAML records, JSON snapshots, Atom feeds, lists, forms.

Every reader takes a path that Spark can open (or text) and gives a DataFrame with a fixed schema;
small documents with running state (headings, fences) are parsed one file a row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

TOPIC = "code string, title string, taxonomy_version string, usage_mode string, status string, subpoints array<string>, pos int"
RESOURCE = (
    "id string, resource_type string, title string, description string, abstract string, authors array<string>, organizations array<string>, "
    "published_at string, updated_at string, url string, doi string, arxiv_id string, openalex_id string, semantic_scholar_id string, "
    "repository_url string, license string, is_open_access boolean, is_retracted boolean, taxonomy_topics array<string>, facets map<string,array<string>>, "
    "is_borrowed_background boolean, review_status string, reviewed_by string, source_provenance string, ingested_at string"
)
CLAIM = "id string, resource_id string, text string, quote string, standalone string, claim_type string, entity_ids array<string>, topic_codes array<string>, confidence_class string, extracted_from string, extraction_method string, review_status string, reviewed_by string, verdict string, note string"
REFS = "resource_id string, key string, source string, cited_by_count int, referenced_works array<string>"
WORK = (
    "id string, title string, doi string, publication_date string, cited_by_count int, type string, is_retracted boolean, open_access struct<is_oa:boolean>, "
    "authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>, referenced_works array<string>, abstract_inverted_index map<string,array<int>>"
)
FILED = "issue string, part string, id string, pos int, topics array<string>, numbers array<string>, verdict string, unsure boolean, note string, reviewed_on string, text string, quote string, type string, problem string"
PAPER = "paperId string, title string, abstract string, publicationDate string, citationCount int, externalIds map<string,string>, authors array<struct<name:string>>, references array<struct<externalIds:map<string,string>,title:string>>"

def _title(c: Column) -> Column:
    """Without bold marks, a link at the end, and closing punctuation."""
    bare = F.regexp_replace(F.regexp_replace(c, fixed.TAXONOMY_BOLD, "$1"), fixed.TAXONOMY_LINK, "")
    return F.trim(F.regexp_replace(F.trim(bare), "[:;,]+$", ""))


def taxonomy_topics(lines: DataFrame, version: str = "v3") -> DataFrame:
    """Rows of TOPIC, with `doc`, from lines(doc, pos, line) of Markdown.

    Numbered lines outside code fences are topics; of one code the first title counts.  Indented bullets are subpoints of
    the topic last named, each once.  The first heading without a number after a topic ends the taxonomy.
    """
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    open_ = lines.withColumn("fences", F.sum(flag(F.col("line").rlike(fixed.TAXONOMY_FENCE))).over(upto)).where(~F.col("line").rlike(fixed.TAXONOMY_FENCE) & (F.col("fences") % 2 == 0))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.rtrim("line"), fixed.TAXONOMY_BOLD, "$1"), fixed.TAXONOMY_DECORATION, ""))
    read = open_.withColumn("bare", bare).withColumn("numbered", F.col("bare").rlike(fixed.TAXONOMY_TOPIC))
    named = F.when(F.col("numbered"), F.nullif(_title(F.regexp_extract("bare", fixed.TAXONOMY_TOPIC, 2)), F.lit("")))
    read = read.withColumn("title", named).withColumn("code", F.when(F.col("title").isNotNull(), F.regexp_extract("bare", fixed.TAXONOMY_TOPIC, 1)))
    ends = ~F.col("numbered") & F.col("line").rlike(fixed.TAXONOMY_HEADING) & (F.count("code").over(before) > 0)
    inside = read.withColumn("ends", flag(ends)).withColumn("over", F.max("ends").over(upto)).where("over = 0").withColumn("own", F.last("code", ignorenulls=True).over(upto))
    topics = inside.where("code is not null").groupBy("doc", "code").agg(F.min_by("title", "pos").alias("title"))
    point = F.nullif(_title(F.regexp_extract("line", fixed.TAXONOMY_BULLET, 1)), F.lit(""))
    points = inside.where(~F.col("numbered") & F.col("own").isNotNull() & F.col("line").rlike(fixed.TAXONOMY_BULLET)).select("doc", F.col("own").alias("code"), "pos", point.alias("point")).where("point is not null")
    points = points.groupBy("doc", "code", "point").agg(F.min("pos").alias("pos")).groupBy("doc", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "point"))), lambda x: x["point"]).alias("subpoints"))
    out = topics.join(points, ["doc", "code"], "left")
    mode = F.when(T.section(F.col("code")) == fixed.CODING_SCHEME_SECTION, "coding-scheme").otherwise("navigation")
    place = F.row_number().over(Window.partitionBy("doc").orderBy(T.code_key(F.col("code")))) - 1
    return out.select("doc", "code", "title", F.lit(version).alias("taxonomy_version"), mode.alias("usage_mode"), F.lit("active").alias("status"), F.coalesce("subpoints", F.array().cast("array<string>")).alias("subpoints"), place.alias("pos"))


def read_taxonomy(spark: SparkSession, path: str, version: str = "v3") -> DataFrame:
    """Topics of Markdown files, each a taxonomy of its own."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "line"))
    return taxonomy_topics(files, version).drop("doc")


def absent_is_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """What `read` gives, or no rows of `schema` where the path isn't there, which is normal for overlays and verdicts."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def taxonomy_problems(topics: DataFrame, strict_sections: bool = True) -> DataFrame:
    """(rule, code) of topics(code, and usage_mode if there): parents that are missing, sections that are missing or too many, topics browsed that are to be coded by or the other way round; `no topics` if there are none."""
    none = topics.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no topics").alias("rule"), F.lit(None).cast("string").alias("code"))
    lost = topics.select(T.parent_code(F.col("code")).alias("code")).where("code is not null").distinct().join(topics.select("code"), "code", "left_anti").select(F.lit("parent missing").alias("rule"), "code")
    out = lost.unionByName(none)
    if "usage_mode" in topics.columns:
        mode = F.when(T.section(F.col("code")) == fixed.CODING_SCHEME_SECTION, "coding-scheme").otherwise("navigation")
        out = out.unionByName(topics.where(~F.col("usage_mode").eqNullSafe(mode)).select(F.lit("usage mode").alias("rule"), "code"))
    if not strict_sections:
        return out
    want = topics.sparkSession.range(1, fixed.SECTION_COUNT + 1).select(F.col("id").cast("string").alias("code"))
    have = topics.where(T.depth(F.col("code")) == 0).select("code").distinct()
    some = topics.limit(1).select(F.lit(1).alias("_"))
    absent = want.exceptAll(have).crossJoin(F.broadcast(some)).select(F.lit("section missing").alias("rule"), "code")  # one row
    return out.unionByName(absent).unionByName(have.exceptAll(want).select(F.lit("section unknown").alias("rule"), "code"))


def read_yaml(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Records of YAML files, parsed on the executors; dates stay strings.  `key`: a list inside each file."""
    import pandas as pd
    from pyspark.sql.types import StructType

    names = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fieldNames()

    def parse(batches):
        import yaml

        class Loader(yaml.SafeLoader):
            pass

        Loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        for batch in batches:
            rows = []
            for text in batch["value"]:
                loaded = yaml.load(text, Loader) or {}  # noqa: S506  (a SafeLoader)
                for record in loaded.get(key, []) if key else [loaded]:
                    if unknown := set(record) - set(names):
                        raise ValueError(f"unknown fields {sorted(unknown)} in {record.get('id')}")
                    rows.append({n: record.get(n) for n in names})
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return absent_is_empty(spark, lambda: spark.read.text(path, wholetext=True).mapInPandas(parse, schema), schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Reference store: rows without an id are dropped, and the last line of an id counts, files in order of their paths.

    A line's place is its file, where its split begins there, and its place in the split: however Spark cuts and deals files, the order is theirs.
    """
    lines = spark.read.text(path).select(F.from_json("value", REFS).alias("r"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")).alias("at"))
    return lines.where("r.resource_id is not null and r.resource_id <> ''").groupBy("r.resource_id").agg(F.max_by("r", "at").alias("r")).select("r.*")


def parse_works(json: DataFrame) -> DataFrame:
    """Flat works of json(value)."""
    w = json.select(F.from_json("value", WORK).alias("w")).select("w.*")
    doi = F.lower(F.regexp_replace("doi", "^https://doi.org/", ""))
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    places = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("authorships", lambda a: F.transform(a["institutions"], lambda i: i["display_name"]))), lambda n: n.isNotNull())))
    tail = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    return w.select(
        tail(F.col("id")).alias("openalex_id"), "title", doi.alias("doi"), F.when(doi.startswith("10.48550/arxiv."), F.substring(doi, 16, 100)).alias("arxiv_id"), "publication_date",
        names.alias("authors"), places.alias("institutions"), T.inverted_abstract(F.col("abstract_inverted_index")).alias("abstract"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.col("open_access.is_oa").alias("is_open_access"), "is_retracted", F.transform("referenced_works", tail).alias("referenced_works"), "type",
    )


def parse_papers(json: DataFrame) -> DataFrame:
    """Papers of a second source of json(value), with canonical reference keys."""
    p = json.select(F.from_json("value", PAPER).alias("p")).select("p.*")
    refs = F.filter(F.transform("references", lambda r: T.canonical_key(r["externalIds"])), lambda k: k.isNotNull())
    return p.select(T.canonical_key(F.coalesce("externalIds", F.create_map().cast("map<string,string>"))).alias("key"), F.coalesce("title", F.lit("")).alias("title"), "abstract", F.col("publicationDate").alias("publication_date"), F.coalesce("citationCount", F.lit(0)).alias("citation_count"), F.coalesce(F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n != ""), F.array().cast("array<string>")).alias("authors"), F.col("paperId").alias("semantic_scholar_id"), F.array_sort(F.array_distinct(refs)).alias("referenced_keys"))


def parse_atom(feeds: DataFrame) -> DataFrame:
    """(arxiv_id, title, authors, abstract, published) of the entries in feeds(value)."""
    e = feeds.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    tag = lambda t: T.plain_text(F.regexp_extract("e", f"(?s)<{t}[^>]*>(.*?)</{t}>", 1))
    ident = F.regexp_replace(F.regexp_extract(tag("id"), r"abs/(.+)$", 1), r"v\d+$", "")
    return e.select(ident.alias("arxiv_id"), tag("title").alias("title"), F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), lambda x: T.plain_text(x)).alias("authors"), tag("summary").alias("abstract"), F.substring(tag("published"), 1, 10).alias("published"))


def parse_tool_tables(lines: DataFrame) -> DataFrame:
    """(name, url, section, subsection, description, stars) of Markdown lines(doc, pos, line): tables under headings."""
    run = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    h2, h3 = F.col("line").startswith("## "), F.col("line").startswith("### ")
    head = F.when(h2, F.struct("pos", F.trim(F.substring("line", 4, 10_000)).alias("name")))
    sub = F.when(h3, F.struct("pos", F.trim(F.substring("line", 5, 10_000)).alias("name")))
    placed = lines.withColumn("h", F.last(head, ignorenulls=True).over(run)).withColumn("s", F.last(sub, ignorenulls=True).over(run))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = placed.where(F.col("line").startswith("|") & ~F.col("line").contains("---") & F.col("h").isNotNull()).withColumn("c", cells)
    link = r"^\[([^\]]+)\]\(([^)]+)\)"
    count = F.get("c", F.lit(2))
    return rows.where(F.col("c")[0].rlike(link)).select(F.trim(F.regexp_extract(F.col("c")[0], link, 1)).alias("name"), F.trim(F.regexp_extract(F.col("c")[0], link, 2)).alias("url"), F.col("h.name").alias("section"), F.when(F.col("s.pos") > F.col("h.pos"), F.col("s.name")).alias("subsection"), F.coalesce(F.get("c", F.lit(1)), F.lit("")).alias("description"), F.when(count.rlike(r"\d") & ~F.contains(count, F.lit("/")), count).alias("stars"))


def parse_list(lines: DataFrame) -> DataFrame:
    """(pos, token, topics) of lines(pos, line): the surest identifier in each, and trailing [codes]."""
    bare = lines.select("pos", F.trim("line").alias("line")).where((F.col("line") != "") & ~F.col("line").rlike(r"^(#|//)"))
    bare = bare.withColumn("line", F.regexp_replace(F.regexp_replace("line", r"^[-*+]\s+", ""), r"^\d+[.)]\s+", ""))
    bare = bare.withColumn("topics", F.regexp_extract("line", r"\[([0-9.,\s]+)\]\s*$", 1)).withColumn("line", F.trim(F.regexp_replace("line", r"\[[0-9.,\s]+\]\s*$", "")))
    clean = lambda c: F.regexp_replace(c, "[.,;]+$", "")
    parts = F.transform(F.split("line", r"\s+"), clean)
    first = lambda test: F.get(F.filter(parts, test), F.lit(0))
    token = F.coalesce(first(lambda p: F.lower(p).startswith("http")), first(lambda p: p.rlike(r"^10\.\d{4,9}/\S+$")), first(lambda p: p.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$")), first(lambda p: p.contains("/")), clean(F.col("line")))
    return bare.select("pos", token.alias("token"), "topics")


def parse_forms(issues: DataFrame) -> DataFrame:
    """(id, key, value) of issues(id, body) in any of the shapes that forms have: one row for each question that is answered.

    A line `**Label:** value` answers by itself and closes what was open; a heading or a bold line opens a block up to the next
    label.  Labels are known by FORM_FIELDS, whatever their case and signs; what stands under others is dropped.  Answers to one
    question are put together, in order; what means nothing (FORM_BLANKS) is none.
    """
    lines = issues.select("id", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|[\r\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).alias("pos", "line"))
    names = F.create_map(*[F.lit(x) for pair in fixed.FORM_FIELDS.items() for x in pair])
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))
    label = lambda pattern: names[plain(F.regexp_extract("line", pattern, 1))]
    labelled, section, heading = (F.col("line").rlike(p) for p in (fixed.FORM_LABELLED, fixed.FORM_SECTION, fixed.FORM_HEADING))
    opens = F.when(labelled, F.struct(F.lit(False).alias("block"), F.lit(None).cast("string").alias("key"))).when(section, F.struct(F.lit(True).alias("block"), label(fixed.FORM_SECTION).alias("key"))).when(heading, F.struct(F.lit(True).alias("block"), label(fixed.FORM_HEADING).alias("key")))
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    read = lines.withColumn("opens", opens).withColumn("under", F.last("opens", ignorenulls=True).over(upto))
    answers = read.select("id", "pos", F.when(labelled, label(fixed.FORM_LABELLED)).when(F.col("opens").isNull() & F.col("under.block"), F.col("under.key")).alias("key"), F.when(labelled, F.trim(F.regexp_extract("line", fixed.FORM_LABELLED, 2))).otherwise(F.col("line")).alias("text")).where("key is not null")
    joined = answers.groupBy("id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("value"))
    bare = joined.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", ""))
    return bare.where(~F.lower("value").isin(fixed.FORM_BLANKS))


def parse_filings(issues: DataFrame) -> DataFrame:
    """One row an entry of the filings in issues(id, body), with the columns of FILED.

    Every fenced block of an issue, and its body as the last, is judged by itself, a row each: it is a filing if it is YAML
    with a map under `records`, `claims` or `new_statements`.  The first one counts.  `numbers` are topic codes that YAML
    read as something else than text; a statement has its place (from 1) in `pos` and "finding" where it names no type.  What
    can't be read is a row whose `problem` says so: an issue without a filing (also a null or empty body), a part that is no
    map, an entry of the wrong form.  Issues of one id and one body are one.
    """
    import pandas as pd
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(FILED).fieldNames()
    texts = F.concat(F.regexp_extract_all("body", F.lit(fixed.FILING_FENCE), F.lit(1)), F.array("body"))
    blocks = issues.select(F.col("id").cast("string").alias("issue"), F.xxhash64("body").alias("version"), F.posexplode(F.coalesce(texts, F.array(F.lit("")))).alias("place", "text"))

    def judged(batches):
        for batch in batches:
            yield pd.DataFrame({"issue": batch["issue"], "version": batch["version"], "place": batch["place"], "filing": [_as_filing(t) for t in batch["text"]]})

    def entries(batches):
        for batch in batches:
            rows = [{"issue": issue} | row for issue, filing in zip(batch["issue"], batch["filing"], strict=True) for row in _entries(filing)]
            if rows:
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names).astype({"pos": "Int32"})

    told = blocks.mapInPandas(judged, "issue string, version long, place int, filing string")
    first = told.groupBy("issue", "version").agg(F.min_by("filing", F.when(F.col("filing").isNotNull(), F.col("place"))).alias("filing"))
    return first.select("issue", "filing").mapInPandas(entries, FILED)


def _as_filing(text: str | None) -> str | None:
    """A text as JSON if it is the YAML of a filing; dates become strings."""
    import json

    import yaml

    try:
        read = yaml.safe_load(text or "")
    except (yaml.YAMLError, ValueError):  # a date such as 2026-13-45 is a ValueError
        return None
    parts = {p: read[p] for p in fixed.FILING_PARTS if read.get(p)} if isinstance(read, dict) else {}
    if not any(isinstance(x, dict) for x in parts.values()):
        return None
    return json.dumps({p: list(x.items()) if isinstance(x, dict) else None for p, x in parts.items()}, default=str)


def _entries(filing: str | None) -> list[dict]:
    """Rows of a filing; its parts are lists of (key, entry), or null where a part is no map."""
    import json

    if filing is None:
        return [{"problem": "no filing found"}]
    rows = []
    for part, pairs in json.loads(filing).items():
        if pairs is None:
            rows.append({"part": part, "problem": "not a map"})
        for key, entry in pairs or []:
            rows += [{"part": part, "id": str(key)} | row for row in _READ[part](entry)]
    return rows


_WRONG = {"problem": "wrong form"}


def _stripped(x) -> str | None:
    return None if x is None else str(x).strip()


def _record_entry(entry) -> list[dict]:
    if not isinstance(entry, dict):
        return [_WRONG]
    given = entry.get("topics") or []
    codes = {str: lambda: given.split(","), list: lambda: given}.get(type(given), lambda: [given])()
    texts = [c.strip() for c in codes if isinstance(c, str)]
    said = {k: _stripped(entry.get(k)) or None for k in ("verdict", "note", "reviewed_on")}
    return [{"topics": [c for c in texts if c], "numbers": [str(c) for c in codes if not isinstance(c, str)], "unsure": True if entry.get("unsure") else None} | said]


def _claim_entry(entry) -> list[dict]:
    if isinstance(entry, str):
        return [{"verdict": entry.strip()}]
    return [{k: _stripped(entry.get(k)) or None for k in ("verdict", "note", "reviewed_on")} if isinstance(entry, dict) else _WRONG]


def _statement_entries(entry) -> list[dict]:
    if not isinstance(entry, list):
        return [_WRONG]
    read = lambda said: {k: _stripped(said.get(k)) for k in ("text", "quote")} | {"type": _stripped(said.get("type")) or "finding"}
    return [{"pos": pos} | (read(said) if isinstance(said, dict) else _WRONG) for pos, said in enumerate(entry, 1)]


_READ = {"records": _record_entry, "claims": _claim_entry, "new_statements": _statement_entries}
