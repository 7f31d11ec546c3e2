"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operators only.

An item's windows of consecutive words are the sets to be contained; their tokens are shingles of three
words (a window of one or two words is its own shingle).  Documents are read once as (position, shingle)
rows against the shingles of all windows, which leaves few rows.  From these the shingles are counted, and
those of each window are ordered by rarity; since containment must be whole, the prefix that has to be
joined is the rarest shingle.  A match fixes where the window would begin; it must lie within the document,
and the exact words are compared within the item-sized span around the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, row_tag

WINDOW, SHINGLE = 10, 3
#: A join side is broadcast if its counted size is at most this; beyond, it is shuffled.
BROADCAST_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The array of a text's words: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _BETWEEN, -1), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window_words, item_id): each window of each item; an item of fewer words is one window."""
    listed = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return listed.select("item_id", "w", F.explode(starts).alias("s")).select(F.slice("w", F.col("s") + 1, F.lit(size)).alias("window_words"), "item_id")


def _shingles(rows: DataFrame, widths: list[int]) -> DataFrame:
    """``rows(..., w)`` with a row for each place and width: pos, width, h (a hash of the words there)."""
    n = F.size("w")
    words_at = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c"))
    each = rows.select("*", F.posexplode(words_at).alias("pos", "s"))
    hashes = {1: F.xxhash64(F.lit(1), "s.a"), 2: F.when(F.col("s.b").isNotNull(), F.xxhash64(F.lit(2), "s.a", "s.b")), 3: F.when(F.col("s.c").isNotNull(), F.xxhash64(F.lit(3), "s.a", "s.b", "s.c"))}
    if len(widths) == 1:
        found = each.withColumn("width", F.lit(widths[0])).withColumn("h", hashes[widths[0]])
    else:
        found = each.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("width"), hashes[k].alias("h")) for k in widths]))).select("*", "x.width", "x.h").drop("x")
    return found.where("h is not null").drop("s")


def _window_shingles(windows: DataFrame) -> tuple[DataFrame, list[int]]:
    """((window_id, window_words, n, at, h) of each distinct window, the widths of shingles that occur)."""
    rows = windows.select("window_words").distinct().select(F.array_join("window_words", " ").alias("window_id"), "window_words", F.size("window_words").alias("n"), F.col("window_words").alias("w"))
    widths = sorted(r[0] for r in rows.select(F.least("n", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]  # at most three numbers
    placed = _shingles(rows, widths).where(F.col("width") == F.least("n", F.lit(SHINGLE)))
    return materialize(placed.select("window_id", "window_words", "n", F.col("pos").alias("at"), "h"), "window-shingles"), widths


def _small(table: DataFrame, bytes_of_row: Column) -> bool:
    return (table.agg(F.sum(bytes_of_row)).first()[0] or 0) <= BROADCAST_BYTES


def _matched(rows: DataFrame, vocabulary: DataFrame, widths: list[int], size: int) -> DataFrame:
    """(id, tag, pos, low, span, h): places of ``rows(id, tag, w)`` whose shingle a window has.

    ``span`` are the words from ``low`` on that any window over the place can cover.
    """
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    span = F.slice("w", low + 1, F.col("pos") - low + size).alias("span")
    if _small(vocabulary, F.lit(48)):
        return _shingles(rows, widths).join(F.broadcast(vocabulary), "h").select("id", "tag", "pos", low.alias("low"), span, "h")
    # places alone are shuffled; the words come back from the documents, whose places are grouped again
    places = _shingles(rows, widths).select("id", "tag", "pos", "h").join(vocabulary, "h")
    grouped = materialize(places.groupBy("id", "tag").agg(F.collect_set(F.struct("pos", "h")).alias("places")), "places")
    texts = rows.dropDuplicates(["id", "tag"]).withColumnsRenamed({"id": "_id", "tag": "_tag"})
    both = texts.join(grouped, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tag") == F.col("tag")))
    return both.select("id", "tag", "w", F.explode("places").alias("p")).select("id", "tag", "w", "p.pos", "p.h").select("id", "tag", "pos", low.alias("low"), span, "h")


def window_hits(docs: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, tag, start, n, window_id): every place where a window occurs in ``docs(id, tag, w)``.

    Of a window, the first place of its rarest shingle is joined, so an occurrence is found once.  Rows equal
    in id and tag may be found once or several times.
    """
    placed, widths = _window_shingles(windows)
    vocabulary = materialize(placed.select("h").distinct(), "item-shingles")
    matched = materialize(_matched(docs, vocabulary, widths, size), "matched")
    counts = materialize(matched.groupBy("h").count(), "shingle-counts")
    ranked = placed.join(counts, "h", "left").groupBy("window_id", "window_words", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "h", "at")).alias("rarest"))
    prefixes = ranked.where("rarest.c > 0").select("window_id", "window_words", "n", "rarest.h", "rarest.at")
    prefixes = materialize(prefixes, "prefixes")
    side = F.broadcast(prefixes) if _small(prefixes, F.octet_length("window_id") * 2 + 64) else prefixes
    start, inside = F.col("pos") - F.col("at"), F.col("pos") - F.col("at") - F.col("low")
    found = matched.join(side, "h").where((start >= 0) & (inside >= 0) & (F.slice("span", F.greatest(inside, F.lit(0)) + 1, F.col("n")) == F.col("window_words")))
    hits = materialize(found.select("id", "tag", start.alias("start"), "n", "window_id"), "window-hits")
    discard(placed, vocabulary, matched, counts, prefixes)
    return hits


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    ``items(item_id, text)`` are the benchmark.  A document word is hit if it lies in any occurrence of
    a window of ``size`` consecutive item words; shorter items are one window, items without words
    none.  n_items counts the items of which a window occurs, items_sha256 digests their ids, sorted as
    strings and joined by commas.  Null and empty texts have no words.  Rows equal in id and text get
    equal results; items of a null id count for n_hit only; an empty benchmark hits nothing and an
    empty table gives an empty result.  Texts are taken whole at any length.  Other columns are ignored.
    The names of a document's items take as much memory as all items that own one of its windows.
    """
    rows = docs.select(F.col(id_col).alias("id"), row_tag(id_col, text_col).alias("tag"), words(F.col(text_col)).alias("w"))
    windows = materialize(item_windows(items.select("item_id", "text"), size), "item-windows")
    occurring = window_hits(rows, windows, size)
    hits = materialize(occurring.groupBy("id", "tag").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"), F.collect_set("window_id").alias("windows")), "hits")
    # the words that sorted spans cover: each adds what lies behind the end of those before
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["n"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).alias("sum")),
        lambda a: a["sum"],
    )
    owners = windows.where("item_id is not null").select(F.array_join("window_words", " ").alias("window_id"), F.col("item_id").cast("string").alias("item")).distinct()
    named = hits.select("id", "tag", F.explode("windows").alias("window_id")).join(owners, "window_id").groupBy("id", "tag").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = hits.alias("h").join(named.alias("m"), F.expr("h.id <=> m.id and h.tag = m.tag"), "left").select(F.expr("h.id").alias("hit_id"), F.expr("h.tag").alias("hit_tag"), covered.alias("n_hit"), "items")
    found = materialize(found, "contaminated")
    discard(occurring, hits, windows)
    sized = rows.select("id", "tag", F.size("w").alias("n_words"))
    out = sized.join(found, sized["id"].eqNullSafe(found["hit_id"]) & (sized["tag"] == found["hit_tag"]), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs; all columns stay.

    Null and empty texts hold none and stay.  Texts are judged whole at any length; rows equal in id and text
    stay or go together, and rows that share an id are judged each by its text.  An empty benchmark keeps
    everything, items of a null id count, and an empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), row_tag(id_col, text_col).alias("tag"), words(F.col(text_col)).alias("w"))
    windows = materialize(item_windows(items.select("item_id", "text")), "item-windows")
    occurring = window_hits(rows, windows)
    hit = materialize(occurring.select(F.col("id").alias("_hit_id"), F.col("tag").alias("_hit_tag")).distinct(), "hits")
    discard(occurring, windows)
    return docs.join(hit, docs[id_col].eqNullSafe(hit["_hit_id"]) & (row_tag(id_col, text_col) == hit["_hit_tag"]), "left_anti")


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s + 1 : s + 10] AS x FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
pos AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
hit AS (SELECT doc_id, p, n, item_id FROM pos JOIN sizes ON p + n <= len(w) JOIN win ON w[p + 1 : p + n] = x),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, cov.n IS NOT NULL AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN own ON d.doc_id = own.doc_id
"""
