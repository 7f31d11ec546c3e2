"""Line dedup by overlapping windows of three consecutive lines.

Every window is hashed, windows that occur more than once anywhere are found, and all but the first
occurrence mark the lines that they cover; the covered positions of a document are merged and removed.
Plain DataFrame operators: the count of occurrences is combined before it is shuffled, and the search
for later occurrences joins a written table, whose hot windows adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, row_tag

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, id, tag, pos, size): windows of each row's lines, with a hash of 128 bits."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    with_lines = docs.select("id", row_tag("id", "text").alias("tag"), lines.alias("lines"))
    n = F.size("lines")
    first = F.when(n < WINDOW, F.slice("lines", 1, 1)).otherwise(F.slice("lines", F.lit(1), n - (WINDOW - 1)))
    rows = with_lines.select("id", "tag", n.alias("n"), F.posexplode(F.arrays_zip(first.alias("a"), F.slice("lines", 2, n).alias("b"), F.slice("lines", 3, n).alias("c"))).alias("pos", "w"))
    rows = rows.where((F.col("n") < WINDOW) & (F.col("pos") == 0) | (F.col("pos") <= F.col("n") - WINDOW))
    return rows.select(F.xxhash64("w.a", "w.b", "w.c", F.least("n", F.lit(WINDOW))).alias("h1"), F.xxhash64(F.lit(7), "w.c", F.lit(11), "w.a", F.lit(13), "w.b").alias("h2"), "id", "tag", "pos", F.least("n", F.lit(WINDOW)).alias("size"))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, covered): the positions that later occurrences cover, for rows that have any.

    The first occurrence is that of the least (id, tag, position).  Where a later one overlaps the
    first in the same row, it covers only what lies behind the first.
    """
    windows = _windows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    place = F.struct("id", "tag", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    repeated = materialize(repeated, "repeated-windows")
    later = windows.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    start = F.when(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tag") == F.col("first.tag")), F.greatest("pos", F.col("first.pos") + F.col("size"))).otherwise(F.col("pos"))
    spans = later.select("id", "tag", start.alias("s"), (F.col("pos") + F.col("size")).alias("e")).where("s < e")
    spans = spans.groupBy("id", "tag").agg(F.collect_set(F.sequence("s", F.col("e") - 1)).alias("spans"))
    return spans.select("id", "tag", F.array_distinct(F.flatten("spans")).alias("covered"))


def _reduced(docs: DataFrame, id_col: str, text_col: str, n_lines: str, n_removed: str) -> DataFrame:
    """``docs`` with shortened texts and two counts under the given names, which replace columns of these names."""
    covered = covered_lines(docs, id_col, text_col)
    covered = materialize(covered.select(F.col("id").alias("_line_id"), F.col("tag").alias("_line_tag"), F.col("covered").alias("_line_covered")), "covered-lines")
    # a merge join at every size: texts are shuffled once, and a hot key's side can be split
    joined = docs.join(covered.hint("merge"), docs[id_col].eqNullSafe(covered["_line_id"]) & (row_tag(id_col, text_col) == covered["_line_tag"]), "left")
    own, covers = docs[text_col], covered["_line_covered"]
    lines = F.split(F.coalesce(own, F.lit("")), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covers)
    text = F.when(covers.isNull() | own.isNull(), own).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    kept = [text.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in (n_lines, n_removed)]
    return joined.select(*kept, F.size(lines).alias(n_lines), F.coalesce(F.size(covers), F.lit(0)).alias(n_removed))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages removed from its texts; all columns and rows stay.

    Adds ``n_lines`` and ``n_removed`` (they replace columns of these names).  Lines end at a line
    feed and are compared exactly.  A text of one or two lines is one window of its own length; a
    null text is null afterwards and counts as one empty line.  A text whose lines all go becomes
    empty.  Rows equal in id and text count as one occurrence and are treated alike.  A null id is the
    least.  Texts are taken whole at any length.  An empty table stays empty.
    """
    return _reduced(docs, id_col, text_col, "n_lines", "n_removed")


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


def keep_new_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with the text that is left; rows of which nothing is left go.

    All columns keep their names and values but for the text, columns named ``n_lines`` or ``n_removed``
    too.  Null and empty texts are one empty line: the first of them in the order of ids stays, later ones
    go.  Rows equal in id and text stay or go together.  An empty table stays empty.
    """
    done = _reduced(docs, id_col, text_col, "_line_count", "_line_gone")
    return done.where("_line_gone < _line_count").select(*docs.columns)


ORACLE = """
WITH lines AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
pos AS (SELECT doc_id, ls, unnest(range(greatest(len(ls) - 2, 1))) AS p, least(len(ls), 3) AS size FROM lines),
win AS (SELECT doc_id, p, size, array_to_string(ls[p + 1 : p + 3], chr(10)) AS w FROM pos),
firsts AS (SELECT w, size, min({'d': doc_id, 'p': p}) AS f FROM win GROUP BY w, size HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = f.d THEN greatest(p, f.p + size) ELSE p END, p + size)) AS i
        FROM win JOIN firsts USING (w, size) WHERE {'d': doc_id, 'p': p} > f),
each AS (SELECT doc_id, ls[i + 1] AS l, i FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM lines)),
kept AS (SELECT e.doc_id, string_agg(l, chr(10) ORDER BY e.i) FILTER (c.i IS NULL) AS t, count(c.i) AS n
         FROM each e LEFT JOIN cov c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, n AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text
FROM lines l JOIN kept k ON l.doc_id = k.doc_id
"""
