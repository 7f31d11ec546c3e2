"""Indexed-style search: filter, count, rank, facet, and project hits of a documents table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN, fold, split_words
from ..plans import query as q
from ..plans.compile import APPROXIMATE_ONLY, CONTAINS_BOOST, FUZZY_BOOST, NAME_BOOST, Compiled, Options, Source, compile_query, count_in
from .filters import NamePattern, has_attributes, in_folder, in_range, one_of
from .matching import match_spans, snippet_column

K1, B = 1.2, 0.75
#: Limits by default: of a search, of a live scan.
LIMIT, SCAN_LIMIT = 200, 1000

DOCUMENTS = T.StructType(
    [
        T.StructField("site_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("file", T.StringType()), T.StructField("inner", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("name_raw", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("size", T.LongType()),
        T.StructField("modified", T.LongType()), T.StructField("created", T.LongType()), T.StructField("body", T.StringType()),
    ]
)


def documents_of(raw: DataFrame) -> DataFrame:
    """The documents table from (doc_id, text, lang, source, n_chars); other languages are ``und``."""
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return raw.select(
        F.col("source").alias("site_id"), path.alias("path"), path.alias("file"), F.lit(None).cast("string").alias("inner"), path.alias("name"), F.array(path).alias("name_raw"), F.lit("text").alias("kind"),
        F.when(F.col("lang").isin("en", "fr", "es", "ar"), F.col("lang")).otherwise("und").alias("lang"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("modified"), F.lit(0).cast("long").alias("created"),
        F.col("text").alias("body"), "doc_id",
    )


@dataclass
class SearchRequest:
    """What a search asks for; everything has a default."""

    query: str = ""
    regex: bool = False
    fuzzy: bool = False
    case_sensitive: bool = False
    whole_word: bool = True
    name_only: bool = False
    kinds: list[str] = field(default_factory=list)
    langs: list[str] = field(default_factory=list)
    sites: list[str] = field(default_factory=list)
    size: tuple[int | None, int | None] = (None, None)
    dates: tuple[int | None, int | None] = (None, None)
    date_field: str = "modified"
    attributes: list[str] = field(default_factory=list)
    names: str = ""
    folder: str = ""
    detectors: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    all_terms: bool = False
    limit: int = LIMIT

    def parsed(self) -> q.Query:
        """The query with its term list and detectors as further groups."""
        query = q.with_terms(q.parse(self.query, self.regex), self.terms, self.all_terms)
        if self.detectors:
            query.must.append([q.Detect(tuple(self.detectors))])
        return query

    @property
    def options(self) -> Options:
        return Options(self.fuzzy, self.case_sensitive, self.whole_word)

    def filters(self) -> dict[str, Column]:
        """Predicates by the facet they belong to; ``other`` belongs to none."""
        other = in_range("size", *self.size) & in_range(self.date_field, *self.dates)
        if self.folder:
            other = other & in_folder("path", self.folder)
        if self.attributes:
            other = other & has_attributes("attributes", self.attributes)
        pattern = NamePattern.parse(self.names)
        if pattern:
            other = other & pattern.matches(F.col("name_raw"))
        return {"kind": one_of("kind", self.kinds), "lang": one_of("lang", self.langs), "site": one_of("site_id", self.sites), "other": other}

    def compiled(self, body: str = "body") -> Compiled:
        query = self.parsed()
        source = Source.of(F.col("name") if self.name_only else F.col(body), None if self.name_only else F.col("name"), query.lines)
        if not query and self.names.strip():
            return Compiled(F.lit(True), F.lit(0), F.lit(0))  # a name alone is a criterion
        return compile_query(query, source, self.options)


def matching(docs: DataFrame, request: SearchRequest) -> DataFrame:
    """Documents that pass filters and query, with ``exact`` and ``matches`` counts."""
    filters, compiled = request.filters(), request.compiled()
    kept = docs.where(filters["site"] & filters["kind"] & filters["lang"] & filters["other"]).where(compiled.predicate)
    return kept.withColumns({"exact": compiled.exact, "matches": compiled.matches})


def search(docs: DataFrame, request: SearchRequest) -> DataFrame:
    """Ranked hits: BM25 by site, boosted by the name, penalised without an exact occurrence."""
    found = score_bm25(docs, matching(docs, request), _query_words(request.parsed()), options=request.options)
    penalty = F.when((F.col("exact") == 0) & (F.col("matches") > 0), F.lit(APPROXIMATE_ONLY)).otherwise(F.lit(1.0))
    return found.withColumn("score", F.col("score") * penalty).orderBy(F.desc("score"), "path").limit(request.limit)


def _query_words(query: q.Query) -> list[str]:
    words = [w for group in query.must for c in group if isinstance(c, (q.Word, q.Phrase, q.Like, q.Exact)) for w in split_words(c.text)]
    return list(dict.fromkeys(words))


def _measures(words: list[str], text: Column, folded: Column, options: Options) -> list[tuple[Column, float]]:
    """(occurrences, weight) of each word: as it is, as a part of others, and with typos."""
    plain = Options(whole_word=True)
    out = []
    for w in words:
        exact = count_in(q.Word(w), text, folded, plain).exact
        out.append((exact, 1.0))
        if not options.whole_word:
            out.append((count_in(q.Word(w), text, folded, Options(whole_word=False)).exact - exact, CONTAINS_BOOST))
        if options.fuzzy and (approximate := count_in(q.Word(w), text, folded, Options(fuzzy=True)).fuzzy) is not None:
            out.append((approximate, FUZZY_BOOST))
    return out


def score_bm25(docs: DataFrame, found: DataFrame, words: list[str], body: str = "body", site: str = "site_id", options: Options = Options()) -> DataFrame:
    """``found`` with a BM25 ``score`` of these words; statistics are those of each site.

    One aggregate over the lengths and word counts of all documents gives the statistics, combined before
    its shuffle; it has one row for each site.  Partial and approximate occurrences weigh less.
    """
    if not words:
        return found.withColumn("score", F.lit(0.0))
    text = F.coalesce(F.col(body), F.lit(""))
    measures = _measures(words, text, fold(text), options)
    columns = {"_len": F.regexp_count(fold(text), F.lit(TOKEN))} | {f"_tf{i}": c for i, (c, _) in enumerate(measures)}
    measured = docs.select(F.col(site).alias("_site"), *[c.alias(k) for k, c in columns.items()])
    stats = measured.groupBy("_site").agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(measures))])
    rows = found.withColumns(columns).join(stats, F.col(site).eqNullSafe(F.col("_site")), "left")
    score = F.lit(0.0)
    for i, (_, weight) in enumerate(measures):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        own = F.col(f"_tf{i}")
        score = score + weight * idf * own * (K1 + 1) / (own + K1 * (1 - B + B * F.col("_len") / F.greatest(F.col("_avg"), F.lit(1e-9))))
    if "name" in found.columns:
        for w in words:
            score = score + F.when(count_in(q.Word(w), F.col("name"), fold(F.col("name")), Options()).exact > 0, F.lit(NAME_BOOST)).otherwise(0.0)
    return rows.withColumn("score", score).drop("_site", "_n", "_avg", *columns, *[f"_df{i}" for i in range(len(measures))])


def hits(docs: DataFrame, request: SearchRequest, most_snippets: int = 2) -> DataFrame:
    """The hits of a search with spans and snippets, which are made for the listed rows only."""
    return with_snippets(search(docs, request), request, most_snippets)


def with_snippets(listed: DataFrame, request: SearchRequest, most_snippets: int = 2) -> DataFrame:
    """Listed documents with ``body``, as result rows with spans and snippets."""
    spans = match_spans(F.col("body"), request.parsed(), request.options, F.col("lang"))
    return listed.withColumn("spans", spans).withColumn("snippets", snippet_column(F.col("body"), F.col("spans"), most_snippets)).select(
        "site_id", "path", "file", "inner", "name", "kind", "lang", "size", "modified", "score", "exact", "matches", "spans", "snippets"
    )


def live_scan(docs: DataFrame, request: SearchRequest, limit: int = SCAN_LIMIT) -> DataFrame:
    """The same documents as a search, scored by their counts alone."""
    return matching(docs, request).withColumn("score", F.col("exact") + 0.1 * F.col("matches")).limit(limit)


def sorted_hits(found: DataFrame, key: str = "relevance") -> DataFrame:
    order = {"relevance": F.desc("score"), "matches": F.desc("matches"), "modified": F.desc("modified"), "name": F.asc("name")}[key]
    return found.orderBy(order, "path")


def facets(docs: DataFrame, request: SearchRequest) -> DataFrame:
    """(facet, key, n): counts by kind, language, year and site, each without its own filter.

    One pass: every document that the query matches gives one row for each facet whose other filters it
    passes, and the counts are combined before the shuffle.
    """
    filters, compiled = request.filters(), request.compiled()
    rows = docs.where(compiled.predicate & filters["other"])
    flags = {k: f for k, f in filters.items() if k != "other"}
    others = lambda own: F.forall(F.array(F.lit(True), *[f for k, f in flags.items() if k != own]), lambda x: x)
    keys = {"kind": F.col("kind"), "lang": F.col("lang"), "year": F.year(F.timestamp_seconds(F.col("modified"))).cast("string"), "site": F.col("site_id")}
    each = F.array(*[F.struct(F.lit(name).alias("facet"), key.alias("key"), others(name).alias("ok")) for name, key in keys.items()])
    return rows.select(F.explode(each).alias("f")).where("f.ok").groupBy("f.facet", "f.key").agg(F.count("*").alias("n"))


def detection_totals(docs: DataFrame, kinds: tuple[str, ...], body: str = "body") -> DataFrame:
    """(kind, files, matches) of detections."""
    from ..functions.detectors import count_detections

    each = docs.select(F.explode(count_detections(F.col(body), kinds)).alias("kind", "n"))
    return each.groupBy("kind").agg(F.count("*").alias("files"), F.sum("n").alias("matches"))


def keyword_report(docs: DataFrame, terms: list[str], body: str = "body") -> DataFrame:
    """(term, files, matches): how many documents hold each term, and how often."""
    source = Source.of(F.coalesce(F.col(body), F.lit("")))
    labels = list(dict.fromkeys(terms))
    found = [(t, count_in(q.term_clause(t, len(labels)), source.body, source.folded, Options())) for t in labels]
    each = F.array(*[F.struct(F.lit(t).alias("term"), f.total.alias("n")) for t, f in found if f is not None])
    rows = docs.select(F.explode(each).alias("t"))
    return rows.groupBy("t.term").agg(F.count_if(F.col("t.n") > 0).alias("files"), F.sum("t.n").alias("matches"))


def point_lookup(docs: DataFrame, path: str) -> DataFrame:
    return docs.where(F.col("path") == path).limit(1)


def all_folders(docs: DataFrame, path: str = "path") -> DataFrame:
    """Every folder between a root and a file, once."""
    parts = F.split(F.translate(F.col(path), "\\", "/"), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return docs.where(F.size(parts) > 1).select(F.explode(ancestors).alias("folder")).where("folder <> ''").distinct()


def folder_search(docs: DataFrame, names: str, limit: int = LIMIT, path: str = "path") -> DataFrame:
    """Folders whose own name passes a name pattern, by path."""
    pattern = NamePattern.parse(names)
    rows = all_folders(docs, path)
    return (rows.where(pattern.matches(F.array(F.substring_index("folder", "/", -1)))) if pattern else rows.limit(0)).orderBy("folder").limit(limit)
