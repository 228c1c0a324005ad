"""Text functions as Column expressions, so that they stay in generated code and optimise with the plan."""

from __future__ import annotations

import functools
import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def stem(word: Column) -> Column:
    """Takes off the first suffix (in order) that leaves four letters."""
    return F.regexp_replace(word, f"^(.{{4,}}?)(?:{'|'.join(fixed.SUFFIXES)})$", "$1")


def tokens(text: Column) -> Column:
    """Stemmed words of three and more ASCII letters or digits, without stop words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(fixed.STOP_WORDS)), stem)


def with_phrases(terms: Column) -> Column:
    """Terms, then each two neighbours joined by an underscore."""
    n = F.greatest(F.size(terms) - 1, F.lit(0))
    return F.concat(terms, F.zip_with(F.slice(terms, F.lit(1), n), F.slice(terms, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b)))


def parent_code(code: Column) -> Column:
    return F.when(F.instr(code, ".") > 0, F.regexp_replace(code, r"\.[^.]+$", ""))


def depth(code: Column) -> Column:
    return F.size(F.split(code, r"\.")) - 1


def section(code: Column) -> Column:
    return F.split(code, r"\.")[0]


def code_key(code: Column) -> Column:
    """Sort key of dotted codes: their numbers."""
    return F.transform(F.split(code, r"\."), lambda x: x.try_cast("int"))


def ancestors(code: Column) -> Column:
    """Codes above this one, the topmost first."""
    parts = F.split(code, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def fold_name(name: Column) -> Column:
    """Key that spellings of one name share: letters without marks, no punctuation, single spaces, lower case.

    Marks of Latin letters are taken off by a table made from Unicode's own decompositions.
    """
    source, target = _latin_marks()
    bare = F.translate(F.regexp_replace(F.coalesce(name, F.lit("")), "ß", "ss"), source, target)
    bare = F.regexp_replace(bare, "[\\u0300-\\u036F]", "")
    bare = F.regexp_replace(bare, "[.'`\\-\\u2010\\u2011\\u2019]", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def _latin_marks() -> tuple[str, str]:
    import unicodedata

    pairs = []
    for i in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(i):
            pairs.append((chr(i), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def richness(name: Column) -> Column:
    """Completeness of a spelling: accents, punctuation, length."""
    source, _ = _latin_marks()
    marks = F.length(name) - F.length(F.translate(name, source, ""))
    signs = F.length(name) - F.length(F.regexp_replace(name, "[.'`\\-\\u2010\\u2011\\u2019]", ""))
    return F.struct(marks.alias("marks"), signs.alias("signs"), F.length(name).alias("chars"))


def heading_kind(heading: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(heading, F.lit("")), r"^\s*(\d+(\.\d+)*|[IVX]+)[.)]?\s+", "")))
    out = F.lit("other")
    for kind, needles in reversed(fixed.SECTION_KINDS):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | plain.contains(needle)
        out = F.when(hit, kind).otherwise(out)
    return out


def strip_elements(html: Column) -> Column:
    """HTML without the elements whose text is no prose, one kind after another."""
    for tag in fixed.STRIPPED_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return html


#: Buckets of the table of named character references (a map is searched from its start).
NAME_BUCKETS = 1024


@functools.cache
def _named_references() -> tuple[str, str]:
    """The standard library's named references as buckets by CRC-32 (JSON), and a pattern of those that need no semicolon, longest first."""
    buckets: list[dict[str, str]] = [{} for _ in range(NAME_BUCKETS)]
    for name, signs in html5.items():
        buckets[zlib.crc32(name.encode()) % NAME_BUCKETS][name] = signs
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(buckets), f"^(?:{'|'.join(bare)})"


def _code_point(number: Column) -> Column:
    """The sign of a numeric reference's digits (x and hex, or decimal), as HTML reads it.

    C1 controls are what Windows-1252 has there; no character, surrogates and too large ones are U+FFFD; other controls and
    noncharacters are nothing.
    """
    is_hex = F.lower(number).startswith("x")
    digits = F.regexp_replace(number, "^[xX]?0*", "")
    point = F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).otherwise(F.coalesce(F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0).cast("long")))
    windows = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))
    none = point.between(1, 8) | (point == 11) | point.between(14, 31) | (point == 127) | point.between(0xFDD0, 0xFDEF) | (point.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)
    sign = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return (
        F.when((point == 0) | point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), F.lit("\ufffd"))
        .when(point.between(0x80, 0x9F), F.substring(F.lit(windows), (point - 0x7F).cast("int"), F.lit(1))).when(none, F.lit("")).otherwise(sign)
    )


def character_references(text: Column, closed: bool = False) -> Column:
    """Text with all character references decoded in one pass, named and numeric, with and without a semicolon, as HTML does.

    A name that is none is read by its longest beginning that is one without a semicolon; what decodes to & opens no new reference.
    `closed` leaves those without a semicolon as they stand, such as `&amp` at the end of a text that was cut.
    """
    buckets, bare = _named_references()
    table = F.from_json(F.lit(buckets), "array<map<string,string>>")
    look = lambda name: F.get(table, (F.crc32(name) % NAME_BUCKETS).cast("int"))[name]
    end = ";" if closed else ";?"
    parsed = lambda p: F.struct(p.alias("p"), F.regexp_extract(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+)" + end, 0).alias("number"), F.regexp_extract(p, "^[^\\t\\n\\f <&#;]{1,32}" + end, 0).alias("name"))
    found = lambda x: F.struct(x["p"].alias("p"), x["number"].alias("number"), x["name"].alias("name"), look(x["name"]).alias("signs"), (F.lit("") if closed else F.regexp_extract(x["name"], bare, 0)).alias("bare"))
    after = lambda p, used: F.substring(p, F.length(used) + 1, F.length(p))

    def read(x: Column) -> Column:
        return (
            F.when(x["number"] != "", F.concat(_code_point(F.regexp_extract(x["number"], "[0-9a-fA-FxX]+", 0)), after(x["p"], x["number"])))
            .when(x["signs"].isNotNull(), F.concat(x["signs"], after(x["p"], x["name"])))
            .when(x["bare"] != "", F.concat(look(x["bare"]), after(x["p"], x["bare"])))
            .otherwise(F.concat(F.lit("&"), x["p"]))
        )

    def decoded(t: Column) -> Column:
        parts = F.split(t, "&")
        rest = F.transform(F.transform(F.transform(F.slice(parts, 2, F.size(parts)), parsed), found), read)
        return F.when(t.contains("&"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(t)

    return F.transform(F.array(text), decoded)[0]  # the text is a variable here, worked out once


def plain_text(fragment: Column, closed: bool = False) -> Column:
    """Text of an HTML fragment, with tidy spaces and no empty brackets; `closed` as in character_references."""
    text = character_references(F.regexp_replace(fragment, "<[^>]+>", " "), closed)
    text = F.trim(F.regexp_replace(text, r"[\s\x1C-\x1F\x85\p{Z}]+", " "))
    text = F.regexp_replace(text, r"\s+([,.;:)\]])", "$1")
    text = F.regexp_replace(text, r"([(\[])\s+", "$1")
    return F.trim(F.regexp_replace(text, r"\(\s*\)|\[\s*\]", ""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_key(ids: Column) -> Column:
    """One namespaced identifier of a map: DOI (arXiv's own DOIs as arXiv), arXiv, OpenAlex, Semantic Scholar."""
    entries = F.filter(F.map_entries(ids), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    # names count without case; of two spellings of one name the last
    get = lambda k: F.trim(F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), F.lit(-1))["value"])
    some = lambda c: F.when(c != "", c)
    doi = F.lower(F.regexp_replace(F.regexp_replace(get("doi"), "^https://doi.org/", ""), "^doi:", ""))
    arxiv = F.coalesce(some(get("arxiv")), some(get("arxivid")))
    return (
        F.when(some(get("doi")).isNotNull() & doi.startswith("10.48550/arxiv."), F.concat(F.lit("arxiv:"), F.substring(doi, 16, 1000)))
        .when(some(get("doi")).isNotNull(), F.concat(F.lit("doi:"), doi))
        .when(arxiv.isNotNull(), F.concat(F.lit("arxiv:"), F.regexp_replace(F.lower(arxiv), "^arxiv:", "")))
        .when(some(get("openalex")).isNotNull(), F.concat(F.lit("openalex:"), F.regexp_extract(F.regexp_replace(get("openalex"), "/+$", ""), "([^/]*)$", 1)))
        .when(F.coalesce(some(get("semanticscholar")), some(get("paperid")), some(get("corpusid"))).isNotNull(), F.concat(F.lit("semanticscholar:"), F.coalesce(some(get("semanticscholar")), some(get("paperid")), some(get("corpusid")))))
    )


def identify(raw: Column) -> Column:
    """struct(kind, id): arxiv, doi or url of a typed identifier; kind `error` if it is none."""
    value = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), fixed.ID_DOI_ADDRESS, "")
    link = F.lower(F.regexp_extract(value, fixed.ID_ARXIV_ADDRESS, 1))
    inner = F.lower(F.regexp_extract(value, fixed.ID_DOI_INSIDE, 1))
    made = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("id"))
    return (
        F.when(value == "", made("error", F.lit(None).cast("string")))
        .when(link != "", made("arxiv", link))
        .when(value.rlike(fixed.ID_ARXIV), made("arxiv", F.regexp_replace(value, "v.*$", "")))
        .when(value.rlike(fixed.ID_DOI), made("doi", F.lower(value)))
        .when(inner != "", made("doi", inner))
        .when(value.rlike(r"(?i)^(https?://|www\.)") | value.rlike(r"^[\w-]+\.[\w.-]+"), made("url", F.when(F.lower(value).startswith("http"), value).otherwise(F.concat(F.lit("https://"), value))))
        .otherwise(made("error", F.lit(None).cast("string")))
    )


def scope_score(title: Column, abstract: Column) -> Column:
    """struct(score, reasons): relevance of a work by fixed terms."""
    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))
    found = lambda terms: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, t))
    org = F.regexp_extract(hay, fixed.SCOPE_ORGANIZATIONAL, 0)
    both = hay.rlike(fixed.SCOPE_AGENT) & (org != "")
    groups = [(fixed.SCOPE_STRONG, 3, "+3 "), (fixed.SCOPE_SUPPORTING, 1, "+1 "), (fixed.SCOPE_AGAINST, -4, "-4 "), (fixed.SCOPE_DOMAIN, 0, "?? domain application: ")]
    score = F.when(both, F.lit(3)).otherwise(F.lit(0)) + sum((F.size(found(t)) * n for t, n, _ in groups), F.lit(0))
    reasons = F.concat(F.when(both, F.array(F.concat(F.lit("+3 agent × "), org))).otherwise(F.array().cast("array<string>")), *[F.transform(found(t), lambda x, p=p: F.concat(F.lit(p), x)) for t, _, p in groups])
    return F.struct(score.alias("score"), reasons.alias("reasons"))


def inverted_abstract(index: Column) -> Column:
    """Text of an index word -> positions; of two words at one place the later word of the map stands."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda x: x["w"]), " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lookup_url(identifier: Column) -> Column:
    """Where the first source keeps a work: by its own id, arXiv id (without version) or DOI; null for anything else."""
    i = F.trim(identifier)
    base = "https://api.openalex.org/works/"
    return (
        F.when(i.startswith("W"), F.concat(F.lit(base), i))
        .when(i.rlike(fixed.ID_ARXIV), F.concat(F.lit(base + "https://doi.org/10.48550/arXiv."), F.regexp_replace(i, "v.*$", "")))
        .when(i.startswith("10."), F.concat(F.lit(base + "https://doi.org/"), i))
    )


def paper_url(identifier: Column) -> Column:
    """Where the second source keeps a work: by DOI, arXiv id (without version) or its own id; null for the first source's ids and for nothing."""
    i = F.trim(identifier)
    base, asked = F.lit(fixed.SECOND_SOURCE), F.lit("?fields=" + ",".join(fixed.SECOND_SOURCE_FIELDS))
    own = F.when(F.lower(i).startswith("10."), F.concat(F.lit("DOI:"), i)).when(i.startswith("W") | (i == ""), F.lit(None))
    own = own.when(i.rlike(r"^\d{4}") & i.contains("."), F.concat(F.lit("arXiv:"), F.substring_index(i, "v", 1))).otherwise(i)
    return F.concat(base, own, asked)


def short_id(url: Column) -> Column:
    """The last part of an address."""
    return F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1)


def truncated(text: Column, most: int) -> Column:
    """Cut at a word's end, with an ellipsis, if longer than `most`."""
    cut = F.regexp_replace(F.substring(text, 1, most), " [^ ]*$", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)
