"""The registered queries of the search engine's operators, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import detectors, text
from .operators import dupes, filters, intervals, matching, meaning, search
from .operators.search import SearchRequest
from .plans import query as q
from .plans.compile import Options, Source, compile_query
from .session import delete_path, materialize, new_path, ship_package
from .sources import folders, incremental, kinds
from .store.index import SearchIndex, _asked, build_index
from .streaming import alerts, changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.documents_of(table(spark, sf_dir, "documents"))


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def indexed(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The word index of a folder's documents, built in the shared folder when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(documents(spark, sf_dir), new_path(spark, "index"))
    return _INDEXES[key]


def found(spark: SparkSession, sf_dir: str, text_query: str, **options) -> DataFrame:
    """(doc_id, matches) of a query over bodies: by the index, or from the texts what it cannot say."""
    parsed = q.parse(text_query, options.pop("regex", False))
    index = indexed(spark, sf_dir)
    if index.supports(parsed, Options(**options)):
        return index.matches(parsed, Options(**options)).select("doc_id", "matches")
    compiled = compile_query(parsed, Source.of(F.coalesce(F.col("text"), F.lit("")), lines=parsed.lines), Options(**options))
    return table(spark, sf_dir, "documents").where(compiled.predicate).select("doc_id", compiled.matches.cast("long").alias("matches"))


_T = r"t AS (SELECT *, strip_accents(lower(coalesce(text, ''))) AS f, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}_]+') AS toks FROM documents)"


def _n(word: str) -> str:
    return f"len(list_filter(toks, lambda x: x = '{word}'))"


@query(f"WITH {_T} SELECT doc_id, {_n('the')} AS matches FROM t WHERE matches > 0")
def word_search(spark, d):
    return found(spark, d, "the")


@query(f"WITH {_T} SELECT doc_id, {_n('the')} + {_n('that')} AS matches FROM t WHERE {_n('the')} > 0 AND {_n('that')} > 0")
def multi_word_and(spark, d):
    return found(spark, d, "the AND that")


@query(f"WITH {_T} SELECT doc_id, {_n('und')} + {_n('les')} AS matches FROM t WHERE matches > 0")
def or_group(spark, d):
    return found(spark, d, "und OR les")


@query(f"WITH {_T} SELECT doc_id, {_n('in')} AS matches FROM t WHERE matches > 0 AND {_n('the')} = 0")
def not_word(spark, d):
    return found(spark, d, "in -the")


@query(f"WITH {_T} SELECT doc_id, 0 AS matches FROM t WHERE {_n('the')} = 0")
def not_only(spark, d):
    return found(spark, d, "NOT the")


@query(f"WITH {_T} SELECT doc_id, {_n('etre')} AS matches FROM t WHERE matches > 0")
def accent_fold_search(spark, d):
    return found(spark, d, "Étre")


@query(
    rf"WITH {_T}, p AS (SELECT doc_id, toks, unnest(range(len(toks))) AS i FROM t) SELECT doc_id, count(*) AS matches FROM p WHERE toks[i + 1] = 'of' AND toks[i + 2] = 'the' GROUP BY doc_id"
)
def phrase_search(spark, d):
    return found(spark, d, '"of the"')


@query(f"WITH {_T} SELECT doc_id, len(list_filter(toks, lambda x: contains(x, 'tion'))) AS matches FROM t WHERE matches > 0")
def partial_word(spark, d):
    return found(spark, d, "tion", whole_word=False)


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: x = 'The')) AS matches FROM documents WHERE matches > 0")
def case_sensitive_word(spark, d):
    return found(spark, d, "The", case_sensitive=True)


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)[a-z]+ing [a-z]+tion')) AS matches FROM documents WHERE matches > 0")
def regex_search(spark, d):
    return found(spark, d, "/[a-z]+ing [a-z]+tion/")


@query(f"WITH {_T} SELECT doc_id, len(list_filter(toks, lambda x: strlen(x) < 64 AND x <> 'therein' AND length(x) BETWEEN 6 AND 8 AND levenshtein(x, 'therein') <= 1)) + {_n('therein')} AS matches FROM t WHERE matches > 0")
def fuzzy_word(spark, d):
    return found(spark, d, "therein", fuzzy=True)


@query(f"WITH {_T} SELECT doc_id, len(list_filter(toks, lambda x: strlen(x) < 64 AND x <> 'that' AND length(x) BETWEEN 3 AND 5 AND levenshtein(x, 'that') <= 1)) + {_n('that')} AS matches FROM t WHERE matches > 0")
def like_word(spark, d):
    return found(spark, d, "LIKE that")


def _near(terms: list[str], chars: int) -> str:
    """Occurrences of each term that have one of every other term within so many characters of the folded text."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return (
        rf"WITH {_T}, g AS (SELECT doc_id, toks, regexp_split_to_array(f, '[\p{{L}}\p{{N}}_]+') AS gaps FROM t WHERE len(toks) > 0), u AS (SELECT doc_id, unnest(toks) AS w, unnest(gaps[1:len(toks)]) AS gap, unnest(range(len(toks))) AS i FROM g), "
        "o AS (SELECT doc_id, w, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u), s AS (SELECT doc_id, w, e - length(w) AS s, e FROM o "
        f"WHERE w IN ({listed})), m AS (SELECT DISTINCT a.doc_id, a.w, a.s, b.w AS other FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.w <> b.w AND greatest(b.s - a.e, a.s - b.e) <= {chars}) "
        f"SELECT doc_id, count(*) AS matches FROM (SELECT doc_id, w, s FROM m GROUP BY ALL HAVING count(*) = {len(terms) - 1}) GROUP BY doc_id"
    )


@query(_near(["with", "from"], 60))
def near_words(spark, d):
    return found(spark, d, "with NEAR:60 from")


@query(_near(["with", "from", "that"], 200))
def near_chain(spark, d):
    return found(spark, d, "with NEAR:200 from NEAR:250 that")


@query(
    rf"WITH {_T}, l AS (SELECT doc_id, unnest(string_split(f, chr(10))) AS line, unnest(range(len(string_split(f, chr(10))))) AS n FROM t) "
    r"SELECT doc_id, n AS line, len(list_filter(regexp_extract_all(line, '[\p{L}\p{N}_]+'), lambda x: x = 'the')) AS spans FROM l WHERE spans > 0"
)
def line_hits(spark, d):
    """The lines of each text, as boxes, with the number of spans of a word that lie in them: an overlap join by places."""
    index = indexed(spark, d)
    spans = index.occurrences([_asked(q.Word("the"), Options(), False)])
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(text.fold(F.col("text")), "\n", -1)).alias("line", "t"))
    end = F.sum(F.length("t") + 1).over(Window.partitionBy("doc_id").orderBy("line")) - 1
    boxes = lines.select("doc_id", "line", (end - F.length("t")).alias("start"), end.alias("end"))
    return intervals.near_pairs(boxes, spans.select("doc_id", "start", "end"), ["doc_id"], overlap=True).groupBy("doc_id", F.col("l_line").cast("long").alias("line")).agg(F.count("*").alias("spans"))


@query(
    r"WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(array_to_string(string_split(coalesce(text, ''), chr(10))[2:3], chr(10)))), '[\p{L}\p{N}_]+') AS toks FROM documents) "
    f"SELECT doc_id, {_n('the')} AS matches FROM t WHERE matches > 0"
)
def lines_range(spark, d):
    return found(spark, d, "LINES:2-3 the")


_TERMS = ["the", "und", "les", "para"]


@query(f"WITH {_T} SELECT doc_id, {' + '.join(map(_n, _TERMS))} AS matches FROM t WHERE matches > 0")
def term_list_any(spark, d):
    return indexed(spark, d).any_term(_TERMS)


#: As many terms as a list may have, of words that occur, phrases, and words that do not.
_LONG_LIST = ["the", "of the", "und", "with"] + [f"absent{i}" for i in range(4996)]


@query(
    f"WITH {_T}, p AS (SELECT doc_id, toks, unnest(range(len(toks))) AS i FROM t), w AS (SELECT doc_id, toks[i + 1] AS a, toks[i + 2] AS b FROM p) "
    "SELECT doc_id, count(*) FILTER (a IN ('the', 'und', 'with')) + count(*) FILTER (a = 'of' AND b = 'the') AS matches FROM w GROUP BY doc_id HAVING matches > 0"
)
def term_list_5000(spark, d):
    return indexed(spark, d).any_term(_LONG_LIST)


@query(f"WITH {_T} SELECT doc_id, {_n('the')} + {_n('a')} AS matches FROM t WHERE {_n('the')} > 0 AND {_n('a')} > 0")
def term_list_all(spark, d):
    return indexed(spark, d).matches(q.with_terms(q.Query(), ["the", "a"], True)).select("doc_id", "matches")


@query("SELECT page_id, url FROM pages WHERE lower(url) LIKE 'https://www.%' AND (lower(url) = 'https://www.ththen.example.com/en' OR starts_with(lower(url), 'https://www.ththen.example.com/en/'))")
def in_folder_prefix(spark, d):
    return table(spark, d, "pages").where(filters.in_folder("url", "https://www.ththen.example.com/en/")).select("page_id", "url")


def _placed_pages(spark, d) -> tuple[DataFrame, DataFrame]:
    """Pages as files of their hosts' folders: the tree of these, and the pages by the numbers of their folders."""
    pages = table(spark, d, "pages").select("page_id", F.array_join(F.slice(F.split(F.regexp_replace("url", "[?#].*$", ""), "/", -1), 3, 2**30), "/").alias("path"))
    tree = materialize(folders.folder_tree(pages), "folder-tree")
    return tree, materialize(folders.place_documents(pages, tree), "placed-pages")


_PATHS = "p AS (SELECT page_id, array_to_string(string_split(regexp_replace(url, '[?#].*$', ''), '/')[3:], '/') AS path FROM pages), "


@query(f"WITH {_PATHS} q AS (SELECT page_id, path, array_to_string(string_split(path, '/')[1:2], '/') AS top FROM p), m AS (SELECT min(lower(top)) AS top FROM q WHERE length(path) > length(top)) SELECT page_id, path FROM q WHERE starts_with(lower(path), (SELECT top FROM m) || '/')")
def in_folder_tree(spark, d):
    """All pages under the first second-level folder, by a range of folder numbers; the folder is asked for in other case."""
    tree, placed = _placed_pages(spark, d)
    first = tree.where("length(folder) - length(replace(folder, '/', '')) = 1").agg(F.min("key").alias("k")).first()["k"]
    return folders.full_paths(placed.where(folders.within(tree, (first or "none").upper())), tree)


@query(f"WITH {_PATHS} h AS (SELECT max(string_split(path, '/')[1]) AS host FROM p) SELECT page_id, CASE WHEN lower(string_split(path, '/')[1]) = lower((SELECT host FROM h)) AND contains(path, '/') THEN 'archive/old' || path[length((SELECT host FROM h)) + 1:] ELSE path END AS path FROM p")
def folder_remap(spark, d):
    """All pages with their paths after the last host's folder moved: the tree is rewritten, the pages are not."""
    tree, placed = _placed_pages(spark, d)
    host = table(spark, d, "pages").select(F.max(F.get(F.split(F.regexp_replace("url", "[?#].*$", ""), "/", -1), F.lit(2))).alias("h")).first()["h"]
    return folders.full_paths(placed, folders.moved(tree, host, "archive/old"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def within_results_semi(spark, d):
    return filters.within(table(spark, d, "documents"), table(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(strip_accents(lower(p_name)), '^(red.*t|.*ring)$') AND NOT contains(strip_accents(lower(p_name)), 'widget')")
def name_glob(spark, d):
    pattern = filters.NamePattern.parse("Red*T; *ring, !widget")
    return table(spark, d, "part").where(pattern.matches(F.array("p_name"))).select("p_partkey", "p_name")


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(url), '^https') AND NOT regexp_matches(lower(url), '/de/')")
def name_regex_exclude(spark, d):
    include, exclude = filters.NamePattern.parse("/^https/"), filters.NamePattern.parse("!/\\/de\\//")
    return table(spark, d, "pages").where(include.matches(F.array("url")) & exclude.matches(F.array("url"))).select("page_id")


def orders_as_files(spark: SparkSession, d: str) -> DataFrame:
    """The only table with dates, as files: status is kind, priority language, price size."""
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("lang"), F.floor("o_totalprice").alias("size"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("modified"),
        (F.col("o_custkey") % 5).cast("string").alias("site_id"), (F.col("o_custkey") % 8).cast("int").alias("attributes"),
    )


_O = "o AS (SELECT o_orderkey, o_orderstatus AS kind, o_orderpriority AS lang, floor(o_totalprice)::BIGINT AS size, epoch(o_orderdate)::BIGINT AS modified, (o_custkey % 5)::VARCHAR AS site_id, (o_custkey % 8)::INTEGER AS attributes FROM orders)"


@query(f"WITH {_O} SELECT o_orderkey, size, modified FROM o WHERE size >= 51200 AND size < 204800 AND modified >= epoch(TIMESTAMP '1995-01-01') AND modified < epoch(TIMESTAMP '1997-01-01')")
def size_date_range(spark, d):
    rows = orders_as_files(spark, d).where(filters.in_range("size", filters.parse_size("50K"), filters.parse_size("200 KB")))
    return rows.where(filters.in_range("modified", filters.parse_date("1995-01-01"), filters.until_date("1996-12-31"))).select("o_orderkey", "size", "modified")


@query(f"WITH {_O} SELECT o_orderkey, attributes FROM o WHERE attributes & 3 = 3")
def attribute_mask(spark, d):
    return orders_as_files(spark, d).where(filters.has_attributes("attributes", ["readOnly", "hidden"])).select("o_orderkey", "attributes")


@query("SELECT doc_id FROM documents WHERE md5(text) = (SELECT md5(text) FROM documents WHERE doc_id = 0)")
def digest_match(spark, d):
    docs = table(spark, d, "documents")
    digest = docs.where("doc_id = 0").select(F.md5("text").alias("m")).first()["m"]
    return docs.where(filters.digest_matches(F.col("text"), digest)).select("doc_id")


_BM25 = (
    r"WITH t AS (SELECT *, source AS site, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}_]+') AS toks FROM documents), "
    f"m AS (SELECT doc_id, site, len(toks) AS dl, {_n('with')} AS a, {_n('from')} AS b FROM t), "
    "s AS (SELECT site, count(*) AS n, avg(dl) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM m GROUP BY site), "
    "r AS (SELECT doc_id, a, b, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)) AS score FROM m JOIN s USING (site)) "
)


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score FROM r WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(spark, d):
    index = indexed(spark, d)
    scored = index.matches(q.parse("with from")).join(index.scores(["with", "from"]), "doc_id")
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score, a + b AS exact, a + b AS matches FROM r WHERE a > 0 AND b > 0 ORDER BY r.score DESC, 'doc-' || doc_id || '.txt' LIMIT 50")
def search_hits(spark, d):
    listed = indexed(spark, d).search(SearchRequest("with from", limit=50), stems=False)
    return listed.select("doc_id", F.round("score", 6).alias("score"), "exact", "matches")


@query()
def inflected_word(spark, d):
    return indexed(spark, d).matches(q.parse("ering"), stems=True)


@query(
    f"WITH {_T}, c AS (SELECT doc_id, {_n('therein')} AS e, len(list_filter(toks, lambda x: strlen(x) < 64 AND x <> 'therein' AND length(x) BETWEEN 6 AND 8 AND levenshtein(x, 'therein') <= 1)) AS z FROM t) "
    "SELECT doc_id, round(CASE WHEN e = 0 THEN (e + z) * 0.2 ELSE e + z END, 6) AS score FROM c WHERE e + z > 0"
)
def approx_penalty_rank(spark, d):
    rows = indexed(spark, d).matches(q.parse("therein"), Options(fuzzy=True))
    return rows.select("doc_id", F.round(F.when(F.col("exact") == 0, F.col("matches") * F.lit(0.2)).otherwise(F.col("matches").cast("double")), 6).alias("score"))


@query(f"WITH {_T} SELECT doc_id, {_n('the')} AS matches, row_number() OVER (ORDER BY {_n('the')} DESC, 'doc-' || doc_id || '.txt') AS place FROM t WHERE matches > 0 ORDER BY place LIMIT 100")
def sort_keys(spark, d):
    rows = search.sorted_hits(search.live_scan(documents(spark, d), SearchRequest("the"), limit=2**31 - 1), "matches").limit(100)
    place = F.row_number().over(Window.orderBy(F.desc("matches"), "path"))  # of the hundred listed rows
    return rows.select("doc_id", F.col("matches").cast("long").alias("matches"), place.cast("long").alias("place"))


_FACETS = (
    f"WITH {_T}, h AS (SELECT source AS site_id, 'text' AS kind, CASE WHEN lang IN ('en', 'fr', 'es', 'ar') THEN lang ELSE 'und' END AS lang FROM t WHERE {_n('the')} > 0 OR {_n('que')} > 0) "
    "SELECT 'lang' AS facet, lang AS key, count(*) AS n FROM h WHERE site_id IN ('src0', 'src1', 'src2') GROUP BY lang "
    "UNION ALL SELECT 'site', site_id, count(*) FROM h WHERE lang = 'en' GROUP BY site_id "
    "UNION ALL SELECT 'kind', kind, count(*) FROM h WHERE lang = 'en' AND site_id IN ('src0', 'src1', 'src2') GROUP BY kind "
    "UNION ALL SELECT 'year', '1970', count(*) FROM h WHERE lang = 'en' AND site_id IN ('src0', 'src1', 'src2') HAVING count(*) > 0"
)


@query(_FACETS)
def facets_without_own_filter(spark, d):
    return indexed(spark, d).facets(SearchRequest("the OR que", langs=["en"], sites=["src0", "src1", "src2"]))


@query(
    f"WITH {_T}, h AS (SELECT source AS site_id, lang FROM t WHERE ({_n('the')} > 0 OR {_n('que')} > 0) AND lang = 'en' AND source IN ('src0', 'src1', 'src2')) "
    "SELECT 'lang' AS facet, lang AS key, count(*) AS n FROM h GROUP BY lang UNION ALL SELECT 'site', site_id, count(*) FROM h GROUP BY site_id "
    "UNION ALL SELECT 'kind', 'text', count(*) FROM h HAVING count(*) > 0 UNION ALL SELECT 'year', '1970', count(*) FROM h HAVING count(*) > 0"
)
def facets_with_all_filters(spark, d):
    return indexed(spark, d).facets(SearchRequest("the OR que", langs=["en"], sites=["src0", "src1", "src2"]), own=True)


@query(
    f"WITH {_O} SELECT 'kind' AS facet, kind AS key, count(*) AS n FROM o WHERE site_id IN ('1', '2') GROUP BY kind UNION ALL SELECT 'lang', lang, count(*) FROM o WHERE kind = 'F' AND site_id IN ('1', '2') GROUP BY lang "
    "UNION ALL SELECT 'year', year(make_timestamp(modified * 1000000))::VARCHAR, count(*) FROM o WHERE kind = 'F' AND site_id IN ('1', '2') GROUP BY ALL UNION ALL SELECT 'site', site_id, count(*) FROM o WHERE kind = 'F' GROUP BY site_id"
)
def facets_with_dates(spark, d):
    rows = orders_as_files(spark, d).withColumns({"name": F.lit("x"), "body": F.lit("x"), "name_raw": F.array(F.lit("x"))})
    return search.facets(rows, SearchRequest(names="x", kinds=["F"], sites=["1", "2"]))


@query("SELECT source AS site_id, count(*) AS n FROM documents GROUP BY source")
def facet_site_all(spark, d):
    return indexed(spark, d).sites.select("site_id", "n")


_MAIL = detectors.PATTERNS["email"]


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_MAIL}')) AS n FROM documents WHERE n > 0")
def detect_email(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(detectors.emails(F.col("text"))).cast("long").alias("n")).where("n > 0")


_IP = detectors.PATTERNS["ip"]


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '{_IP}'), lambda x: len(list_filter(string_split(x, '.'), lambda p: p::INTEGER > 255)) = 0)) AS n FROM documents WHERE n > 0")
def detect_ip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(detectors.ips(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query(
    r"WITH f AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b(?:[0-9][ \-]?){12,18}[0-9]\b')), '[ -]', '', 'g') AS c FROM documents), "
    "l AS (SELECT *, list_sum(list_transform(range(length(c)), lambda i: CASE WHEN i % 2 = 0 THEN c[length(c) - i]::INTEGER ELSE (c[length(c) - i]::INTEGER * 2) // 10 + (c[length(c) - i]::INTEGER * 2) % 10 END)) AS s FROM f) "
    r"SELECT doc_id, count(*) AS n FROM l WHERE s % 10 = 0 AND regexp_matches(c, '^(4(\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|(222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|35\d{14,17}|3[068]\d{12}|(6011|65\d\d|62\d\d|64[4-9]\d)\d{12,15})$') GROUP BY doc_id"
)
def detect_card(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(detectors.cards(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query()
def detect_totals(spark, d):
    return search.detection_totals(table(spark, d, "documents"), detectors.KINDS, "text")


@query()
def pii_audit(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(detectors.detections(F.col("text"))).alias("d"))
    return each.select("doc_id", "d.kind", "d.start", "d.end", text.mask_sensitive(F.col("d.value")).alias("masked"))


@query()
def mask_sensitive(spark, d):
    values = detectors.sensitive_values(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.transform(values, text.mask_sensitive).alias("masked")).where(F.size("masked") > 0)


_REPORT = ["the", "of the", "und", "les"]


@query(
    f"WITH {_T}, p AS (SELECT doc_id, toks, unnest(range(len(toks))) AS i FROM t), w AS (SELECT doc_id, toks[i + 1] AS a, toks[i + 2] AS b FROM p), "
    "x AS (SELECT 'the' AS term, doc_id FROM w WHERE a = 'the' UNION ALL SELECT 'of the', doc_id FROM w WHERE a = 'of' AND b = 'the' UNION ALL SELECT 'und', doc_id FROM w WHERE a = 'und' UNION ALL SELECT 'les', doc_id FROM w WHERE a = 'les') "
    "SELECT term, count(DISTINCT doc_id) AS files, count(*) AS matches FROM x GROUP BY term"
)
def keyword_report(spark, d):
    return indexed(spark, d).keyword_report(_REPORT)


@query(
    "SELECT digest, size, count(*) AS copies, size * (count(*) - 1) AS wasted, string_agg(path, ',' ORDER BY path) AS paths FROM "
    "(SELECT 'doc-' || doc_id || '.txt' AS path, n_chars AS size, sha256(text) AS digest FROM documents WHERE n_chars > 0) GROUP BY digest, size HAVING count(*) > 1"
)
def exact_dups(spark, d):
    return dupes.exact_duplicates(documents(spark, d)).withColumn("paths", F.array_join("paths", ","))


@query("SELECT 'doc-' || doc_id || '.txt' AS path FROM documents WHERE text = (SELECT text FROM documents WHERE doc_id = 1)")
def copies_of(spark, d):
    return dupes.copies_of(documents(spark, d), "doc-1.txt")


#: All pairs of different texts by the shingles that they share, and copies of a text with the first of them.
_PAIRS = (
    r"d AS (SELECT 'doc-' || doc_id || '.txt' AS path, lower(text) AS t FROM documents WHERE regexp_matches(text, '\S')), c AS (SELECT t, min(path) AS path FROM d GROUP BY t), "
    r"w AS (SELECT path, list_filter(string_split_regex(t, '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS w FROM c), "
    "s AS (SELECT DISTINCT path, sh FROM (SELECT path, unnest(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w)), "
    "n AS (SELECT path, count(*) AS n FROM s GROUP BY path), j AS (SELECT x.path AS a, y.path AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.path < y.path GROUP BY ALL), "
    "p AS (SELECT a, b, k / (x.n + y.n - k) AS similarity FROM j JOIN n x ON a = x.path JOIN n y ON b = y.path WHERE similarity >= 0.8 - 1e-9 UNION ALL SELECT c.path, d.path, 1.0 FROM d JOIN c USING (t) WHERE d.path <> c.path)"
)


@query(f"WITH {_PAIRS} SELECT a, b, similarity FROM p")
def near_dup_pairs(spark, d):
    return dupes.similar_pairs(dupes.signatures(documents(spark, d)))


@query(
    f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), g AS (SELECT node, min(other) AS root FROM r GROUP BY node), "
    "m AS (SELECT root, min(similarity) AS similarity FROM p JOIN g ON a = node GROUP BY root) SELECT root, string_agg(node, ',' ORDER BY node) AS paths, similarity FROM g JOIN m USING (root) GROUP BY ALL"
)
def near_dup_groups(spark, d):
    groups = dupes.similar_groups(dupes.similar_pairs(dupes.signatures(documents(spark, d))))
    return groups.withColumn("paths", F.array_join("paths", ","))


#: Every vector whose id is divisible by 100 is a question, asked of all vectors.
_KNN = (
    "s AS (SELECT q.vec_id AS question, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS place FROM s)"
)


def _nearest(spark, d, k: int) -> DataFrame:
    """(question, vec_id, label, score, place) of the nearest vectors of every question."""
    vectors = table(spark, d, "embeddings")
    found = meaning.nearest_to_all(vectors, vectors.where("vec_id % 100 = 0"), k)
    return found.join(vectors.select("vec_id", "label"), "vec_id")


@query(f"WITH {_KNN} SELECT question, vec_id, label, score FROM k WHERE place <= 40")
def knn_passages(spark, d):
    return _nearest(spark, d, 40).select("question", "vec_id", "label", "score")


@query(f"WITH {_KNN} SELECT question, vec_id, score, place FROM k WHERE place <= 10")
def knn_all_questions(spark, d):
    vectors = table(spark, d, "embeddings")
    return meaning.nearest_to_all(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query(f"WITH {_KNN} SELECT question, label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question, label ORDER BY score DESC, vec_id) AS first FROM k WHERE place <= 200) WHERE first = 1")
def best_passage_per_doc(spark, d):
    return meaning.best_passage(_nearest(spark, d, 200), ["question", "label"], "vec_id").select("question", "label", "vec_id", "score")


@query(f"WITH {_KNN} SELECT question, vec_id, label, score FROM (SELECT *, max(score) OVER (PARTITION BY question) AS top FROM k WHERE place <= 200) WHERE score >= greatest(top - 0.7, 0.2)")
def meaning_cut(spark, d):
    return meaning.relative_cut(_nearest(spark, d, 200), 0.7, 0.2, by="question").select("question", "vec_id", "label", "score")


@query(
    f"WITH {_KNN}, m AS (SELECT question, vec_id AS id, place AS m FROM k WHERE place <= 60), {_T}, "
    f"l AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS w FROM (SELECT doc_id AS id, {_n('the')} AS n FROM t WHERE n > 0 ORDER BY n DESC, id LIMIT 200)), w AS (SELECT question, id, w FROM l, (SELECT DISTINCT question FROM m)) "
    "SELECT coalesce(w.question, m.question) AS question, coalesce(w.id, m.id) AS id, round(coalesce(1 / (60 + w), 0) + coalesce(1 / (60 + m), 0), 9) AS score, w.id IS NULL AS only_meaning FROM w FULL JOIN m ON w.id = m.id AND w.question = m.question"
)
def rrf_fusion(spark, d):
    words = found(spark, d, "the").select(F.col("doc_id").alias("id"), F.col("matches").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(200)
    near = _nearest(spark, d, meaning.DOCUMENTS).select("question", F.col("vec_id").alias("id"), "score")
    return meaning.fuse(words, near, "id", by="question").select("question", "id", F.round("score", 9).alias("score"), "only_meaning")


@query(
    "WITH f AS (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 1000), "
    "s AS (SELECT q.vec_id AS question, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 WHERE v.vec_id IN (FROM f)), "
    f"m AS (SELECT * FROM (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS m FROM s) WHERE m <= 60), {_T}, "
    f"l AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS w FROM (SELECT doc_id AS id, {_n('with')} + {_n('from')} AS n FROM t WHERE {_n('with')} > 0 AND {_n('from')} > 0 AND doc_id IN (FROM f) ORDER BY n DESC, id LIMIT 200)), w AS (SELECT question, id, w FROM l, (SELECT DISTINCT question FROM m)) "
    "SELECT coalesce(w.question, m.question) AS question, coalesce(w.id, m.id) AS doc_id, round(coalesce(1 / (60 + w), 0) + coalesce(1 / (60 + m), 0), 9) AS score, w.id IS NULL AS only_meaning FROM w FULL JOIN m ON w.id = m.id AND w.question = m.question"
)
def composed_search(spark, d):
    """English documents of some length by words and by the vectors of the same numbers, for every question."""
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    kept = indexed(spark, d).documents.where("lang = 'en' and size >= 1000").select("doc_id")
    words = found(spark, d, "with from").join(kept, "doc_id", "left_semi").select("doc_id", F.col("matches").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(200)
    fused = meaning.composed_search(words, vectors, vectors.where("doc_id % 100 = 0"), kept, "doc_id")
    return fused.select("question", "doc_id", F.round("score", 9).alias("score"), "only_meaning")


def _crawl_and_manifest(spark, d) -> tuple[DataFrame, DataFrame]:
    """A crawl that sees the labelled documents, and a manifest of all documents whose toxic ones have changed since."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("site_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("modified"))
    crawl = docs.join(table(spark, d, "labels"), "doc_id").select("site_id", "path", (F.col("size") + F.col("toxic")).alias("size"), "modified")
    return crawl, docs.select("site_id", "path", "size", "modified")


@query("SELECT source AS site_id, 'doc-' || doc_id AS path, n_chars + toxic AS size FROM documents JOIN labels USING (doc_id) WHERE toxic <> 0")
def manifest_changed(spark, d):
    crawl, manifest = _crawl_and_manifest(spark, d)
    return incremental.changed(crawl, manifest).select("site_id", "path", "size")


@query("SELECT source AS site_id, 'doc-' || doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source <> 'src3'")
def manifest_removed(spark, d):
    crawl, manifest = _crawl_and_manifest(spark, d)
    return incremental.removed(crawl, manifest, missing_sites=["src3"]).select("site_id", "path")


@query("SELECT source AS site_id, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def manifest_rollup(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("site_id"), F.col("n_chars").alias("size"), F.lit(1).alias("docs"), F.lit(None).cast("string").alias("skipped"))
    return incremental.rollup(rows).select("site_id", "files", "bytes")


@query(
    "WITH p AS (SELECT DISTINCT string_split(url, '/') AS s FROM pages), f AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS folder FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p)) "
    "SELECT folder FROM f WHERE folder <> '' AND contains(lower(string_split(folder, '/')[-1]), 'www.') ORDER BY folder"
)
def folder_search(spark, d):
    return search.folder_search(table(spark, d, "pages"), "www.", limit=2**31 - 1, path="url")


@query(
    "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.html$') THEN 'text' END AS kind FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)"
)
def kind_classify(spark, d):
    return table(spark, d, "pages").select("page_id", kinds.kind_of(F.regexp_replace("url", "[?#].*$", "")).alias("kind"))


@query("SELECT conv_id, turn, 'conv-' || conv_id AS file, turn::VARCHAR AS \"inner\" FROM conversations")
def path_split(spark, d):
    path = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(" › "), F.col("turn").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.file_of(path).alias("file"), text.inner_of(path).alias("inner"))


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM e) "
    "SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first_s, count(*) AS n FROM s GROUP BY user_id, k"
)
def debounce_sessions(spark, d):
    return alerts.debounce(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "3600.000001 seconds").select("user_id", F.unix_seconds("first").alias("first_s"), "n")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id, event_type")
def alert_new_once(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'")
    return alerts.announce_once(errors, ["user_id", "event_type"], "event_id")


#: Users as documents, whose events say that they match an alert, are gone, or are merely written.
_ALERTS = {"errors": "error", "sales": "purchase"}
_NEWS = (
    "r AS (SELECT CASE event_type WHEN 'error' THEN 'errors' WHEN 'purchase' THEN 'sales' END AS alert, user_id::VARCHAR AS document, ts, event_id, false AS gone FROM events WHERE event_type IN ('error', 'purchase') "
    "UNION ALL SELECT unnest(['errors', 'sales']), user_id::VARCHAR, ts, event_id, true FROM events WHERE event_type = 'signup'), "
    "l AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY alert, document ORDER BY ts, event_id), true) AS before FROM r), "
    "n AS (SELECT alert, document, event_id AS seq, ts, CASE WHEN gone THEN 'forgotten' ELSE 'announced' END AS news FROM l WHERE before <> gone) "
)


def _event_rows(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), "event_type")
    return changes.alert_rows(rows, {a: F.col("event_type") == e for a, e in _ALERTS.items()}, gone=F.col("event_type") == "signup")


def _event_log(spark: SparkSession, d: str, batches: int = 3) -> DataFrame:
    """The log of a stream over ``events`` that arrives in batches by time, null last; the stream stops after each and starts again."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    arriving, log, state, checkpoint = (new_path(spark, f"events-{x}") for x in ("arriving", "log", "state", "checkpoint"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(micros, [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events.where((F.lit(True) if low is None else micros > low) & (micros <= high) if high is not None else F.lit(True) if low is None else micros.isNull() | (micros > low))
        part.write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(events.schema).parquet(arriving)
        changes.log_announcements(_event_rows(stream), log, state, checkpoint).awaitTermination()
    delete_path(spark, arriving)
    return changes.read_news(spark, log, state)


@query(f"WITH {_NEWS} SELECT alert, document, seq, news FROM n")
def alert_stream(spark, d):
    return _event_log(spark, d).select("alert", "document", "seq", "news")


@query(
    f"WITH {_NEWS}, m AS (SELECT alert, document, arg_max(news, (ts, seq)) AS news, max(ts) AS ts FROM n GROUP BY ALL), k AS (SELECT CASE event_type WHEN 'error' THEN 'errors' ELSE 'sales' END AS alert, make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS read FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1) "
    "SELECT alert, document, ts > read AS fresh FROM m JOIN k USING (alert) WHERE news = 'announced'"
)
def alert_fresh(spark, d):
    """What the alerts have seen at the end, by a window over the whole log; a user looked at each halfway between its first and last match."""
    rows = _event_rows(table(spark, d, "events"))
    middle = F.expr("(unix_micros(min(at)) + unix_micros(max(at))) div 2")
    reads = rows.where("kind = 'matches'").groupBy("alert").agg(F.timestamp_micros(middle).alias("at"))
    return changes.seen_documents(changes.announced_so_far(rows), reads).select("alert", "document", "fresh")


@query(
    "WITH p AS (SELECT page_id, array_to_string(string_split(url, '/')[3:], '/') AS path, length(html) AS size, coalesce(toxic, 0) AS toxic, coalesce(quality, 1) AS quality, page_id % 4 AS part FROM pages LEFT JOIN labels ON page_id = doc_id), "
    "m AS (SELECT path, sum(size)::BIGINT AS size, max(toxic) AS toxic, min(quality) AS quality FROM p GROUP BY path), "
    "r AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS folder FROM m WHERE quality = 0) "
    "SELECT path, CASE WHEN quality = 0 THEN 'removed' ELSE 'changed' END AS action FROM m WHERE array_to_string(string_split(path, '/')[1:2], '/') IN (SELECT folder FROM r) AND len(string_split(path, '/')) >= 2 AND (quality = 0 OR toxic = 1) "
    "UNION ALL SELECT path, 'removed' FROM m WHERE len(string_split(path, '/')) < 2 AND quality = 0"
)
def change_resolution(spark, d):
    """Pages as files by their hosts and paths.  Those of low quality are gone, toxic ones have another size, and the folders of the former are reported."""
    pages = table(spark, d, "pages").join(table(spark, d, "labels").withColumnRenamed("doc_id", "page_id"), "page_id", "left")
    path = F.array_join(F.slice(F.split("url", "/", -1), 3, 2**30), "/")
    files = pages.groupBy(path.alias("path")).agg(F.sum(F.length("html")).alias("size"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    files = files.select(F.lit("web").alias("site_id"), "path", "size", "toxic", "quality", F.lit(0).cast("long").alias("modified"))
    manifest, there = files.select("site_id", "path", "size", "modified"), files.where("quality = 1").select("site_id", "path", (F.col("size") + F.col("toxic")).alias("size"), "modified", F.lit(False).alias("excluded"))
    reports = files.where("quality = 0").select("site_id", F.array_join(F.slice(F.split("path", "/", -1), 1, 2), "/").alias("path"), F.lit(False).alias("rescan"))
    return changes.resolve_reports(reports, there, manifest).select("path", "action")


@query()
def passages_split(spark, d):
    return meaning.passages(documents(spark, d)).select("path", "passage", "start", "end", "text")


@query()
def snippets(spark, d):
    return search.hits(documents(spark, d), SearchRequest("therein", fuzzy=True, limit=search.LIMIT)).select("path", "exact", "matches", "snippets")


@query()
def preview(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("body"))
    return matching.preview_lines(docs, q.parse("the"))


@query()
def detect_language(spark, d):
    from .functions.langid import language

    return table(spark, d, "documents").select("doc_id", language(F.col("text")).alias("lang"))


@query()
def stem_forms(spark, d):
    from .operators.dictionary import inflected_forms

    return inflected_forms(documents(spark, d), "ering", "en")


@query("SELECT r_name AS site_group, count(*) AS sites FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def site_groups(spark, d):
    groups = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("site_ids")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return groups.select(F.col("r_name").alias("site_group"), F.explode("site_ids").alias("site")).groupBy("site_group").agg(F.count("*").alias("sites"))


