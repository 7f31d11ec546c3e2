"""A word index: postings clustered by token, ways from spellings to tokens, and documents without their bodies.

``postings`` (token, raw, lang, site_id, doc_id, named, tf, positions, starts) are sorted by token in runs of texts as they
are read, ranged by token when generations are merged, so that a search for a few tokens reads the pages that hold them; words of a document's name are
``named``, and ``starts`` are characters of the folded text.  ``dictionary`` (lang, raw, token, df, stem, core) has each
spelling once.  ``grams`` (gram, pos, length, token) are the trigrams of the tokens, padded at both ends: partial words
and typos find their candidates there.  ``stems`` (stem, lang, raw, token, core) does so for inflected forms.
``documents`` has everything of a document but its text, and its ``length`` in tokens; ``sites`` the number and the
mean length of each site's documents.  A batch of changes is a further generation of these tables; generations of
about one size are merged, so that a read meets a logarithmic number of them.  Word, phrase, term-list and boolean
searches, NEAR, BM25, facets and reports run on these tables; regular expressions, LINES, detectors and exact case read
texts instead, which an index can keep as ``bodies`` (doc_id, body).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import stem
from ..functions.text import MAX_TOKEN_BYTES, WORD, _fold_table, core_length, fold, fold_text, fuzzy_distance, split_words, stem_input, with_lam
from ..operators.intervals import mutual_counts
from ..operators.search import B, K1, SearchRequest, hits, with_snippets
from ..plans import query as q
from ..plans.compile import APPROXIMATE_ONLY, CONTAINS_BOOST, FUZZY_BOOST, NAME_BOOST, STEM_BOOST, Options, count_in
from ..session import delete_path, materialize, return_memory

#: A spelling: a word character, then word characters and marks.
RAW = rf"([{WORD}][{WORD}\p{{M}}]*)"
STEMMED = ("en", "fr", "es", "ar")
#: Up to so many tokens are searched by a list of them; more by the conditions that they fulfil, and forms by a join.
STATIC_TOKENS = 1000


@F.pandas_udf(T.StringType())
def _stems(raw: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([stem(r, g) if g in STEMMED else None for r, g in zip(raw, lang)])


@F.pandas_udf(T.IntegerType())
def _cores(token: pd.Series) -> pd.Series:
    return token.map(core_length)


#: Length of the pieces of tokens by which spellings are found, and what stands before and behind a token.
GRAM, BEFORE, BEHIND = 3, "\x02", "\x03"
#: So many neighbouring generations of one size class are merged; each class is so many times the one below.
TIER = 4
#: Removed documents up to this number are broadcast, ids of eight bytes or a path each.
BROADCAST_REMOVED = 100_000
#: Words and trigrams of a run that is sorted at once, rows that a task passes on at once, and bytes of a row group.
RUN_WORDS, RUN_GRAMS, OUT_ROWS, ROW_GROUP = 2_000_000, 1_000_000, 50_000, 8 << 20
#: Places of words of the name begin here, so that no phrase runs from the name into the text.
NAME_PLACES = 1 << 30


def _runs(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that hold about ``most`` of what ``size`` counts in each; a longer row is a run of its own."""
    held, n = [], 0
    for batch in batches:
        through, first = np.cumsum(size(batch)), 0
        while first < batch.num_rows:
            before = int(through[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(through, before + most - n, "right")))
            held.append(batch.slice(first, last - first))
            n, first = n + int(through[last - 1]) - before, last
            if n >= most or first < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _parts(run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (run.slice(i, OUT_ROWS) for i in range(0, run.num_rows, OUT_ROWS))


def _postings(texts: DataFrame) -> DataFrame:
    """Postings of ``texts(doc_id, site_id, lang, named, start, raw, gap)``: spellings, and what stands before each.

    A text is one row, so its words are grouped where it is read, a run of texts at a time.  A run is sorted by token
    and is no longer than a few row groups, of which a search reads the pages that hold its tokens.
    """
    source, target = _fold_table()
    folded = str.maketrans(source[: len(target)], target, source[len(target) :])

    def run(batches):
        for batch in _runs(batches, lambda b: b.column("raw").value_lengths().to_numpy(zero_copy_only=False), RUN_WORDS):
            sizes = batch.column("raw").value_lengths().to_numpy(zero_copy_only=False)
            coded = batch.column("raw").flatten().dictionary_encode()
            if not len(coded):
                continue
            spelled = coded.dictionary.to_pylist()
            tokens = [r.translate(folded) for r in spelled]
            order = sorted(range(len(tokens)), key=lambda i: (tokens[i], spelled[i]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            width = np.array([len(t) for t in tokens])[code]
            gaps = batch.column("gap").flatten().dictionary_encode()
            end = np.cumsum(np.array([len(g.translate(folded)) for g in gaps.dictionary.to_pylist()])[gaps.indices.to_numpy()] + width)
            first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            base = np.concatenate(([0], end))[first]
            key = rank[code] * len(sizes) + row
            place = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[place], prepend=-1))
            pos = (np.arange(len(code)) - first[row] + batch.column("start").to_numpy()[row])[place].astype(np.int32)
            at = (end - width - base[row])[place].astype(np.int32)
            bounds = pa.array(np.append(starts, len(code)), pa.int32())
            which, text = pa.array(code[place][starts]), pa.array(row[place][starts])
            columns = [pa.array(tokens).take(which), coded.dictionary.take(which), *[batch.column(c).take(text) for c in ("lang", "site_id", "doc_id", "named")]]
            columns += [pa.array(np.diff(np.append(starts, len(code))), pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(pos)), pa.ListArray.from_arrays(bounds, pa.array(at))]
            yield from _parts(pa.RecordBatch.from_arrays(columns, ["token", "raw", "lang", "site_id", "doc_id", "named", "tf", "positions", "starts"]))
        return_memory()

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    return texts.mapInArrow(run, f"token string, raw string, lang string, site_id {kinds['site_id']}, doc_id {kinds['doc_id']}, named boolean, tf int, positions array<int>, starts array<int>")


def _grams(words: DataFrame) -> DataFrame:
    """(gram, pos, length, token) of ``words(token)``, in runs sorted by gram."""

    def run(batches):
        for batch in _runs(batches, lambda b: pc.utf8_length(b.column("token")).to_numpy() + GRAM - 1, RUN_GRAMS):
            tokens = batch.column("token").to_pylist()
            sizes = np.array([len(t) + GRAM - 1 for t in tokens])
            coded = pa.array([g for t in tokens for g, _ in _trigrams(t)], pa.string()).dictionary_encode()
            rank = pc.rank(coded.dictionary).to_numpy().astype(np.int64)
            place = np.argsort(rank[coded.indices.to_numpy()], kind="stable")
            of = np.repeat(np.arange(len(tokens)), sizes)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [coded.dictionary.take(coded.indices.take(pa.array(place))), pa.array(pos[place], pa.int32()), pa.array((sizes - GRAM + 1)[of][place], pa.int32()), batch.column("token").take(pa.array(of[place]))]
            yield from _parts(pa.RecordBatch.from_arrays(columns, ["gram", "pos", "length", "token"]))
        return_memory()

    return words.mapInArrow(run, "gram string, pos int, length int, token string")


def _write_postings(postings: DataFrame, path: str) -> DataFrame:
    """Merged postings in one order; a token of very many documents lies in several ranges."""
    postings.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
    return postings.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")


def _write_spellings(words: DataFrame, path: str) -> None:
    """The dictionary of ``words(lang, raw, token, df, stem, core)`` and the tables by which its tokens are found."""
    words.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/dictionary")
    written = words.sparkSession.read.schema(words.schema).parquet(f"{path}/dictionary")
    _grams(written.select("token").distinct()).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/grams")
    stems = written.where("stem is not null").select("stem", "lang", "raw", "token", "core")
    stems.repartitionByRange("stem", "raw").sortWithinPartitions("stem", "raw").write.mode("overwrite").parquet(f"{path}/stems")


def _write_generation(docs: DataFrame, folder: str, number: int, body: str, key: str, bodies: bool) -> str:
    """Write the postings, spellings and documents of ``docs`` as one generation; its folder."""
    path = f"{folder}/g{number:06d}"
    fields = [(False, F.col(body), 0), *([(True, F.col("name"), NAME_PLACES)] if "name" in docs.columns else [])]
    texts = F.array(*[F.struct(F.lit(named).alias("named"), F.lit(start).alias("start"), F.coalesce(text, F.lit("")).alias("text")) for named, text, start in fields])
    each = docs.select(F.col(key).alias("doc_id"), "site_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(texts).alias("t"))
    each = each.select("doc_id", "site_id", "lang", "t.named", "t.start", stem_input(F.col("t.text")).alias("text"))
    raw = F.regexp_extract_all("text", F.lit(RAW), 1)
    gap = F.slice(F.split("text", RAW, -1), F.lit(1), F.size(raw))
    postings = _postings(each.select("doc_id", "site_id", "lang", "named", "start", raw.alias("raw"), gap.alias("gap")))
    postings.where("token <> ''").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
    written = docs.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")
    words = written.groupBy("lang", "raw", "token").agg(F.count("*").alias("df"))
    _write_spellings(words.withColumns({"stem": _stems("raw", "lang"), "core": _cores("token")}), path)
    lengths = written.where("not named").groupBy("doc_id").agg(F.sum("tf").alias("length")).withColumnRenamed("doc_id", "_id")
    plain = docs.select(F.col(key).alias("doc_id"), *[c for c in docs.columns if c not in ("doc_id", body)])
    plain.join(lengths, F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumn("length", F.coalesce("length", F.lit(0))).write.mode("overwrite").parquet(f"{path}/documents")
    if bodies:
        docs.select(F.col(key).alias("doc_id"), F.col(body).alias("body")).write.mode("overwrite").parquet(f"{path}/bodies")
    return path


def _commit(spark: SparkSession, folder: str, sizes: dict[int, tuple[int, int]]) -> None:
    """Make the generations of ``sizes`` the live ones: who is removed, who is live, and last the sites, which make it count.

    ``sizes`` has the numbers of documents and of removed ids of each generation, oldest first.
    """
    numbers = list(sizes)
    path = f"{folder}/g{numbers[-1]:06d}"
    parts = [spark.read.parquet(f"{folder}/g{n:06d}/removed").select("doc_id", F.lit(n).alias("upto")) for n in numbers[1:]]
    if parts:
        reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.max("upto").alias("upto")).write.mode("overwrite").parquet(f"{path}/dead")
    live = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(d).cast("long").alias("documents"), F.lit(r).cast("long").alias("removed")) for n, (d, r) in sizes.items()])
    spark.range(1).select(F.inline(live)).coalesce(1).write.mode("overwrite").parquet(f"{path}/live")
    documents = _living(spark, folder, sizes, "documents")
    documents.groupBy("site_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{path}/sites")


def _has(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _generations(spark: SparkSession, folder: str) -> dict[int, tuple[int, int]]:
    """The live generations, those that the latest complete one names, with their numbers of documents and removed ids."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(root) if re.fullmatch(r"g\d{6}", s.getPath().getName())]
    complete = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "sites/_SUCCESS"))]
    if not complete:
        return {}
    rows = spark.read.schema("number int, documents long, removed long").parquet(f"{folder}/{max(complete)}/live").collect()
    return {r["number"]: (r["documents"], r["removed"]) for r in sorted(rows)}


def _living(spark: SparkSession, folder: str, sizes: dict[int, tuple[int, int]], table: str) -> DataFrame:
    """The rows of a table in the generations, without documents that later ones replaced or removed.

    One anti join serves all: a removed document has the number of the last generation that removed it.
    """
    numbers = list(sizes)
    parts = [spark.read.parquet(f"{folder}/g{n:06d}/{table}") for n in numbers]
    if len(parts) == 1:
        return parts[0]
    dead = spark.read.parquet(f"{folder}/g{numbers[-1]:06d}/dead").withColumnRenamed("doc_id", "_dead")
    if sum(removed for _, removed in sizes.values()) <= BROADCAST_REMOVED:
        dead = F.broadcast(dead)
    rows = reduce(DataFrame.unionByName, [p.withColumn("_number", F.lit(n)) for n, p in zip(numbers, parts)])
    return rows.join(dead, (F.col("doc_id") == F.col("_dead")) & (F.col("_number") < F.col("upto")), "left_anti").drop("_number")


def _size(spark: SparkSession, path: str, removed: bool) -> tuple[int, int]:
    return spark.read.parquet(f"{path}/documents").count(), spark.read.parquet(f"{path}/removed").count() if removed else 0


def build_index(docs: DataFrame, folder: str, body: str = "body", key: str = "doc_id", bodies: bool = False) -> SearchIndex:
    """Write the index of ``docs(doc_id, site_id, lang, body, ...)`` into ``folder`` and open it, with the texts if ``bodies``.

    Ids are unique and not null; a null text has no tokens.  Words are grouped where their text is read; only spellings are shuffled.
    """
    path = _write_generation(docs, folder, 0, body, key, bodies)
    _commit(docs.sparkSession, folder, {0: _size(docs.sparkSession, path, False)})
    return SearchIndex(docs.sparkSession, folder)


def update_index(index: SearchIndex, fresh: DataFrame, gone: DataFrame, body: str = "body", key: str = "doc_id") -> SearchIndex:
    """The index after a batch: ``fresh`` documents are added or replaced, those of ``gone(doc_id)`` removed.

    The batch is a generation of its own beside a list of the ids that older ones lose; only it is tokenized.  A
    generation counts when it is complete, so a batch that was interrupted is written again.  Then generations of one
    size are merged, as often as there are enough; folders that the last two states do not name are deleted.
    """
    spark, folder, number = index.spark, index.folder, index.numbers[-1] + 1
    path = _write_generation(fresh, folder, number, body, key, index.bodies is not None)
    ids = fresh.select(F.col(key).alias("doc_id")).unionByName(gone.select(F.col(key).alias("doc_id")))
    ids.distinct().write.mode("overwrite").parquet(f"{path}/removed")
    sizes = {**index.sizes, number: _size(spark, path, True)}
    _commit(spark, folder, sizes)
    before = sizes
    while (first := merge_from([documents for documents, _ in sizes.values()])) is not None:
        before, sizes = sizes, _merge(spark, folder, sizes, first)
    _vacuum(spark, folder, {*index.sizes, *before, *sizes})
    return SearchIndex(spark, folder)


def merge_from(sizes: list[int]) -> int | None:
    """The place from which on generations are merged into one, or None.

    A class is a power of ``TIER`` documents.  The latest generations of a class or below are merged if ``TIER`` of them
    are of that class; so fewer than ``TIER`` of each class stay, and a document is merged once for each class.
    """
    classes = [max(n, 1).bit_length() // 2 for n in sizes]  # by powers of four
    for c in sorted(set(classes)):
        first = len(classes)
        while first and classes[first - 1] <= c:
            first -= 1
        if classes[first:].count(c) >= TIER:
            return first
    return None


def _merge(spark: SparkSession, folder: str, sizes: dict[int, tuple[int, int]], first: int) -> dict[int, tuple[int, int]]:
    """Write the generations from place ``first`` on as one new generation, and make it count; the live ones.

    What later ones of the run removed is left out.  Ids that the run removed from older generations stay listed; the
    oldest run has none before it.  Nothing is tokenized or stemmed again.
    """
    numbers = list(sizes)
    run, number = numbers[first:], numbers[-1] + 1
    path = f"{folder}/g{number:06d}"
    parts = {t: _run_rows(spark, folder, run, t) for t in ("postings", "documents", "bodies") if t != "bodies" or _has(spark, f"{folder}/g{run[0]:06d}/bodies")}
    written = _write_postings(parts["postings"], path)
    known = reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/g{n:06d}/dictionary") for n in run]).groupBy("lang", "raw", "token").agg(F.first("stem").alias("stem"), F.first("core").alias("core"))
    words = written.groupBy("lang", "raw", "token").agg(F.count("*").alias("df"))
    _write_spellings(words.join(known, ["lang", "raw", "token"]).select("lang", "raw", "token", "df", "stem", "core"), path)
    for table in set(parts) - {"postings"}:
        parts[table].write.mode("overwrite").parquet(f"{path}/{table}")
    if first:
        removed = [spark.read.parquet(f"{folder}/g{n:06d}/removed") for n in run]
        reduce(DataFrame.unionByName, removed).distinct().write.mode("overwrite").parquet(f"{path}/removed")
    live = {**{n: sizes[n] for n in numbers[:first]}, number: _size(spark, path, first > 0)}
    _commit(spark, folder, live)
    return live


def _run_rows(spark: SparkSession, folder: str, run: list[int], table: str) -> DataFrame:
    """The rows of a table in a run of generations, without documents that later ones of the run replaced or removed."""
    removed = [spark.read.parquet(f"{folder}/g{n:06d}/removed").select(F.col("doc_id").alias("_dead"), F.lit(n).alias("upto")) for n in run[1:]]
    dead = reduce(DataFrame.unionByName, removed).groupBy("_dead").agg(F.max("upto").alias("upto"))
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/g{n:06d}/{table}").withColumn("_number", F.lit(n)) for n in run])
    return rows.join(dead, (F.col("doc_id") == F.col("_dead")) & (F.col("_number") < F.col("upto")), "left_anti").drop("_number")


def _vacuum(spark: SparkSession, folder: str, keep: set[int]) -> None:
    """Delete complete generations that are not kept; readers of the state before the last still find theirs."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    for status in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root):
        name = status.getPath().getName()
        if re.fullmatch(r"g\d{6}", name) and int(name[1:]) < max(keep) and int(name[1:]) not in keep:
            delete_path(spark, f"{folder}/{name}")


@dataclass(frozen=True)
class _Asked:
    """One clause: a phrase of tokens, or a word with its conditions on the dictionary."""

    words: tuple[str, ...]
    phrase: bool
    exact: frozenset[str] = frozenset()
    forms: str | None = None
    partial: bool = False
    typos: int = 0

    @property
    def plain(self) -> bool:
        return self.phrase or not (self.forms or self.partial or self.typos)


def indexable(clause: q.Clause, options: Options) -> bool:
    if isinstance(clause, q.Near):
        return all(indexable(t, options) for t in clause.terms)
    return isinstance(clause, (q.Word, q.Phrase, q.Like, q.Exact)) and not options.case_sensitive


def _asked(clause: q.Clause, options: Options, stems: bool) -> _Asked | None:
    words = tuple(split_words(clause.text))
    if not words:
        return None
    if len(words) > 1 or isinstance(clause, q.Phrase):
        return _Asked(words, True)
    word = words[0]
    if len(word.encode()) >= MAX_TOKEN_BYTES:
        return _Asked(words, False)
    like = isinstance(clause, q.Like)
    typos = max(fuzzy_distance(word) if options.fuzzy and not isinstance(clause, q.Exact) or like else 0, int(like))
    return _Asked(words, False, frozenset(filter(None, (word, with_lam(word)))), clause.text.strip() if stems and not isinstance(clause, q.Exact) else None, not options.whole_word, typos)


def _trigrams(word: str) -> list[tuple[str, int]]:
    """(gram, place) of a padded word, as :func:`_write_spellings` cuts tokens."""
    padded = BEFORE * (GRAM - 1) + word + BEHIND * (GRAM - 1)
    return [(padded[i : i + GRAM], i) for i in range(len(word) + GRAM - 1)]


def _within(word: str, distance: int) -> Column:
    """Whether a token is within an edit distance of a word."""
    about = F.length("token").between(len(word) - distance, len(word) + distance)
    return about & (F.octet_length("token") < MAX_TOKEN_BYTES) & (F.levenshtein("token", F.lit(word), distance) >= 0)


def _moved(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - k)


def _phrase_count(words: tuple[str, ...]) -> Column:
    """An aggregate: how often the tokens follow each other, from the positions of a document's postings."""
    places = [F.flatten(F.collect_list(F.when(F.col("token") == w, F.col("positions")))) for w in words]
    starts = places[0]
    for k, own in enumerate(places[1:], 1):
        starts = F.array_intersect(starts, _moved(own, k))
    return F.size(starts)


class SearchIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.sizes = spark, folder, _generations(spark, folder)
        if not self.sizes:
            raise FileNotFoundError(folder)
        self.numbers = list(self.sizes)
        self.postings, self.documents = (_living(spark, folder, self.sizes, x) for x in ("postings", "documents"))
        self.bodies = _living(spark, folder, self.sizes, "bodies") if _has(spark, f"{folder}/g{self.numbers[0]:06d}/bodies") else None
        words = [spark.read.parquet(f"{folder}/g{n:06d}/dictionary") for n in self.numbers]
        self.dictionary = words[0] if len(words) == 1 else reduce(DataFrame.unionByName, words).dropDuplicates(["lang", "raw", "token"])
        self.grams, self.stems = (reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/g{n:06d}/{t}") for n in self.numbers]) for t in ("grams", "stems"))
        self.sites = spark.read.parquet(f"{folder}/g{self.numbers[-1]:06d}/sites")

    def _containing(self, word: str) -> DataFrame:
        """(token) of the tokens that contain a word: those that have all its trigrams, or one that begins with a shorter word."""
        inner = list(dict.fromkeys(word[i : i + GRAM] for i in range(len(word) - GRAM + 1)))
        if inner:
            some = self.grams.where(F.col("gram").isin(inner)).groupBy("token").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(inner))
        else:
            some = self.grams.where(F.startswith("gram", F.lit(word))).select("token").distinct()
        return some.where(F.contains("token", F.lit(word))).select("token")

    def _misspelt(self, word: str, distance: int) -> DataFrame:
        """(token) of the tokens within an edit distance of a word.

        An edit touches at most ``GRAM`` trigrams and moves the others by one place at most, so tokens of about the
        word's length with enough of its trigrams at about their places are the candidates.
        """
        n, grams = len(word), _trigrams(word)
        rows = self.grams.where(F.col("length").between(n - distance, n + distance))
        if n + GRAM - 1 - GRAM * distance > 0:
            places = reduce(lambda a, b: a | b, [(F.col("gram") == g) & F.col("pos").between(i - distance, i + distance) for g, i in grams])
            met = rows.where(F.col("gram").isin([g for g, _ in grams]) & places).distinct().groupBy("token", "length").agg(F.count("*").alias("n"))
            some = met.where(F.col("n") >= F.greatest(F.lit(n), F.col("length")) + GRAM - 1 - GRAM * distance)
        else:
            some = rows.where("pos = 0").select("token").distinct()
        return some.where(_within(word, distance)).select("token")

    def _forms(self, raw: str) -> DataFrame:
        """(token, lang, raw) of spellings of a language that have the word's stem there and about its length."""
        wanted, near = {g: s for g in STEMMED if (s := stem(raw, g))}, core_length(fold_text(raw))
        same = [(F.col("stem") == s) & (F.col("lang") == g) for g, s in wanted.items()]
        return self.stems.where((reduce(lambda a, b: a | b, same) if same else F.lit(False)) & F.col("core").between(near - 1, near + 1)).select("token", "lang", "raw")

    def candidates(self, asked: list[_Asked]) -> DataFrame | None:
        """(clause, way, token, lang, raw): the tokens that clauses with partial words, typos or stems ask for; None without such.

        ``way`` is ``c`` for exact or contained, ``z`` for typos, both whatever the spelling, and ``s`` for inflected forms.
        """
        found, none = [], F.lit(None).cast("string")
        for i, a in enumerate(asked):
            if a.plain or not a.exact:
                continue
            add = lambda way, rows, i=i: found.append(rows.select(F.lit(i).alias("clause"), F.lit(way).alias("way"), "token", *[c if c in rows.columns else none.alias(c) for c in ("lang", "raw")]))
            if a.partial:
                add("c", self._containing(a.words[0]))
            if a.forms:
                add("s", self._forms(a.forms))
            if a.typos:
                add("z", self._misspelt(a.words[0], a.typos))
        return reduce(DataFrame.unionByName, found).distinct() if found else None

    def _rows(self, asked: list[_Asked]) -> tuple[DataFrame, list[tuple[Column, Column, Column]]]:
        """Postings of everything asked, and for each word clause its (exact, inflected, typo) flags on them, without overlaps."""
        static = {w for a in asked for w in (a.words if a.phrase else a.exact)}
        exact = [F.col("token").isin(*a.exact) if a.exact else F.lit(False) for a in asked]
        none = F.lit(False)
        found = self.candidates(asked)
        if found is None:
            return self.postings.where(F.col("token").isin(*static)), [(e, none, none) for e in exact]
        some = found.limit(STATIC_TOKENS + 1).collect()
        if len(some) <= STATIC_TOKENS:
            rows = self.postings.where(F.col("token").isin(*(static | {r["token"] for r in some})))
            tokens = lambda i, way: [r["token"] for r in some if (r["clause"], r["way"]) == (i, way)]
            spelled = lambda i: [F.struct(F.lit(r["token"]).alias("token"), F.lit(r["lang"]).alias("lang"), F.lit(r["raw"]).alias("raw")) for r in some if (r["clause"], r["way"]) == (i, "s")]
            hit = lambda i, way: F.col("token").isin(*t) if (t := tokens(i, way)) else none
            form = lambda i: F.struct("token", "lang", "raw").isin(*f) if (f := spelled(i)) else none
        else:
            # parts and typos are judged on the postings themselves, which are read once and not shuffled; forms are joined beside them
            def hit(i: int, way: str) -> Column:
                a, token = asked[i], F.col("token")
                if a.plain or not a.exact or not (a.partial if way == "c" else a.typos):
                    return none
                return F.contains(token, F.lit(a.words[0])) if way == "c" else _within(a.words[0], a.typos)

            inflected, rows = any(a.forms for a in asked), self.postings
            if inflected:
                found = materialize(found.where("way = 's'"), "spellings")
                by_form = found.groupBy("token", "lang", "raw").agg(*[F.coalesce(F.max(F.col("clause") == i), none).alias(f"s_{i}") for i in range(len(asked))])
                rows = rows.join(by_form, ["token", "lang", "raw"], "left")
            form = lambda i: F.coalesce(F.col(f"s_{i}"), none) if inflected else none
            some_way = [hit(i, way) for i in range(len(asked)) for way in "cz"] + [form(i) for i in range(len(asked))]
            rows = rows.where(reduce(lambda a, b: a | b, some_way, F.col("token").isin(*static)))
        flags = []
        for i, e in enumerate(exact):
            own = e | hit(i, "c")
            flags.append((own, ~own & form(i), ~own & ~form(i) & hit(i, "z")))
        return rows, flags

    def _counts(self, asked: list[_Asked], names: bool = False) -> DataFrame:
        """(doc_id, site_id, c0, s0, z0, c1, ...): exact, inflected and approximate occurrences of each clause, with those in ``names`` or without."""
        rows, flags = self._rows(asked)
        rows = rows if names else rows.where("not named")
        total = lambda flag: F.sum(F.when(flag, F.col("tf")).otherwise(0))
        columns = []
        for i, a in enumerate(asked):
            each = (_phrase_count(a.words), F.lit(0), F.lit(0)) if a.phrase else tuple(total(f) for f in flags[i])
            columns += [c.alias(f"{n}{i}") for n, c in zip("csz", each)]
        return rows.groupBy("doc_id", "site_id").agg(*columns)

    def supports(self, query: q.Query, options: Options) -> bool:
        return not query.lines and all(indexable(c, options) for g in [*query.must, query.must_not] for c in g)

    def matches(self, query: q.Query, options: Options = Options(), stems: bool = False, names: bool = False) -> DataFrame:
        """(doc_id, exact, matches) of the documents that a query of words, phrases and NEAR chains matches, in their texts or ``names`` too.

        Inflected forms count as exact ones.  Excluded clauses take exact occurrences only.  Clauses without a
        token are ignored; an empty query matches nothing, one of exclusions all other documents.
        """
        if not self.supports(query, options):
            raise ValueError("this query reads texts")
        asked: list[_Asked] = []
        chains: list[tuple[q.Near, Options, bool]] = []
        groups: list[list[str]] = []

        def place(clause: q.Clause, options: Options, stems: bool) -> str | None:
            """The number of a clause among the words and phrases, or the chains; None for one without a token."""
            if isinstance(clause, q.Near):
                chains.append((clause, options, stems))
                return f"n{len(chains) - 1}"
            if a := _asked(clause, options, stems):
                asked.append(a)
            return str(len(asked) - 1) if a else None

        for group in query.must:
            if own := [p for c in group if (p := place(c, options, stems)) is not None]:
                groups.append(own)
        strict = Options(False, False, options.whole_word)
        without = [p for c in query.must_not if (p := place(c, strict, False)) is not None]
        if not asked and not chains:
            return self.documents.select("doc_id", F.lit(0).cast("long").alias("exact"), F.lit(0).cast("long").alias("matches")).limit(0)
        tables = [self._counts(asked, names).drop("site_id")] if asked else []
        for k, (near, own, forms) in enumerate(chains):
            counted = self.near_matches(near, own, forms, names)
            tables.append(counted.select("doc_id", F.col("matches").alias(f"cn{k}"), *[F.lit(0).cast("long").alias(f"{c}n{k}") for c in "sz"]))
        if not groups:
            tables.insert(0, self.documents.select("doc_id"))
        rows = reduce(lambda a, b: a.join(b, "doc_id", "full" if groups else "left"), tables)
        rows = rows if len(tables) == 1 else rows.na.fill(0)
        exact = lambda i: F.col(f"c{i}") + F.col(f"s{i}")
        every = lambda i: exact(i) + F.col(f"z{i}")
        add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0)).cast("long")
        tests = [reduce(lambda a, b: a | b, [every(i) > 0 for i in g]) for g in groups] + [exact(i) == 0 for i in without]
        wanted = [i for g in groups for i in g]
        return rows.where(reduce(lambda a, b: a & b, tests)).select("doc_id", add(exact(i) for i in wanted).alias("exact"), add(every(i) for i in wanted).alias("matches"))

    def occurrences(self, asked: list[_Asked], names: bool = False) -> DataFrame:
        """(doc_id, named, term, start, end): where each clause occurs, in characters of the folded text or name."""
        rows, flags = self._rows(asked)
        rows = rows if names else rows.where("not named")
        any_of = lambda i: reduce(lambda a, b: a | b, flags[i])
        hits = [F.when(F.col("token").isin(*a.words) if a.phrase else any_of(i), F.lit(i)) for i, a in enumerate(asked)]
        each = rows.select("doc_id", "named", "token", F.explode(F.array(*hits)).alias("term"), F.arrays_zip("positions", "starts").alias("at")).where("term is not null")
        each = each.select("doc_id", "named", "token", "term", F.explode("at").alias("at")).select("doc_id", "named", "token", "term", F.col("at.positions").alias("pos"), F.col("at.starts").alias("start"), (F.col("at.starts") + F.length("token")).alias("end"))
        found = [each.where(F.col("term").isin([i for i, a in enumerate(asked) if not a.phrase])).select("doc_id", "named", "term", "start", "end")]
        for i, a in enumerate(asked):
            if a.phrase:
                # a row for each place of the phrase that a token can have, and the phrase where all its places are met
                at = F.array(*[F.when(F.col("token") == w, F.lit(k)) for k, w in enumerate(a.words)])
                placed = each.where(F.col("term") == i).select("*", F.explode(at).alias("k")).where("k is not null")
                runs = placed.groupBy("doc_id", "named", "term", (F.col("pos") - F.col("k")).alias("first")).agg(F.count_distinct("k").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
                found.append(runs.where(F.col("n") == len(a.words)).select("doc_id", "named", "term", "start", "end"))
        return reduce(DataFrame.unionByName, found)

    def near_matches(self, near: q.Near, options: Options = Options(), stems: bool = False, names: bool = False) -> DataFrame:
        """(doc_id, matches): the occurrences of a chain's terms that have every other term within its characters."""
        asked = [_asked(t, options, stems) for t in near.terms]
        if not all(asked):
            return self.documents.select("doc_id", F.lit(0).cast("long").alias("matches")).limit(0)
        places = self.occurrences(asked, names).withColumn("field", F.struct("doc_id", "named")).select("field", "term", "start", "end")
        return mutual_counts(places, len(asked), near.chars, "field").groupBy("field.doc_id").agg(F.sum("matches").alias("matches"))

    def scores(self, words: list[str], options: Options = Options(), stems: bool = False) -> DataFrame:
        """(doc_id, score): BM25 of words with the statistics of each site; forms, parts and typos weigh less."""
        asked = [a for w in words if (a := _asked(q.Word(w), options, stems))]
        if options.whole_word is False:  # what merely contains the word is a measure of its own
            asked = [_Asked(a.words, False, a.exact, a.forms, False, a.typos) for a in asked] + [_Asked(a.words, False, a.exact, None, True, 0) for a in asked]
        counts = self._counts(asked)
        half = len(asked) // 2 if options.whole_word is False else len(asked)
        measures = [(F.col(f"c{i}"), 1.0) for i in range(half)] + [(F.col(f"c{i + half}") - F.col(f"c{i}"), CONTAINS_BOOST) for i in range(len(asked) - half)]
        measures += [(F.col(f"s{i}"), STEM_BOOST) for i in range(half) if stems] + [(F.col(f"z{i}"), FUZZY_BOOST) for i in range(half) if asked[i].typos]
        rows = counts.select("doc_id", "site_id", *[m.alias(f"m{i}") for i, (m, _) in enumerate(measures)])
        seen = rows.groupBy("site_id").agg(*[F.count_if(F.col(f"m{i}") > 0).alias(f"d{i}") for i in range(len(measures))])
        sites = self.sites.join(seen, "site_id")
        both = rows.join(F.broadcast(sites) if self.sites.count() <= STATIC_TOKENS else sites, "site_id").join(self.documents.select("doc_id", "length"), "doc_id")
        score = F.lit(0.0)
        for i, (_, weight) in enumerate(measures):
            tf, idf = F.col(f"m{i}"), F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
            score = score + weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest("mean", F.lit(1e-9))))
        return both.select("doc_id", score.alias("score"))

    def search(self, request: SearchRequest, stems: bool = True) -> DataFrame:
        """The ranked hits of a request, with every column of ``documents``.

        A score is that of the words, raised for words of the name by as much as a best single word could
        score, and lowered without an exact occurrence.
        """
        query, filters = request.parsed(), request.filters()
        found = self.matches(query, request.options, stems, names=True)
        kept = self.documents.where(filters["site"] & filters["kind"] & filters["lang"] & filters["other"]).join(found, "doc_id")
        words = list(dict.fromkeys(w for g in query.must for c in g if not isinstance(c, q.Near) for w in split_words(c.text)))
        scored = kept.join(self.scores(words, request.options, stems), "doc_id", "left") if words else kept.withColumn("score", F.lit(0.0))
        named = reduce(lambda a, b: a + b, [F.when(count_in(q.Word(w), F.col("name"), fold(F.col("name")), Options()).exact > 0, F.lit(NAME_BOOST)).otherwise(0.0) for w in words], F.lit(0.0))
        penalty = F.when((F.col("exact") == 0) & (F.col("matches") > 0), F.lit(APPROXIMATE_ONLY)).otherwise(F.lit(1.0))
        return scored.withColumn("score", (F.coalesce("score", F.lit(0.0)) + named) * penalty).orderBy(F.desc("score"), "path").limit(request.limit)

    def texts(self) -> DataFrame:
        """The documents with their texts, for searches that read these."""
        return self.documents.join(self.bodies, "doc_id")

    def hits(self, request: SearchRequest, most_snippets: int = 2) -> DataFrame:
        """The hits of any request with spans and snippets; only listed documents' texts are read where postings can answer."""
        if not self.supports(request.parsed(), request.options) or request.name_only or not request.parsed():
            return hits(self.texts(), request, most_snippets)
        listed = self.search(request)
        return with_snippets(listed.join(self.bodies, "doc_id"), request, most_snippets).orderBy(F.desc("score"), "path")

    def facets(self, request: SearchRequest, stems: bool = False, own: bool = False) -> DataFrame:
        """(facet, key, n) of the documents that match; each facet without its own filter, or with all (``own``)."""
        query, filters = request.parsed(), request.filters()
        rows = self.documents.join(self.matches(query, request.options, stems, names=True), "doc_id").where(filters["other"])
        flags = {k: f for k, f in filters.items() if k != "other"}
        passed = lambda name: reduce(lambda a, b: a & b, [f for k, f in flags.items() if own or k != name], F.lit(True))
        keys = {"kind": F.col("kind"), "lang": F.col("lang"), "year": F.year(F.timestamp_seconds(F.col("modified"))).cast("string"), "site": F.col("site_id")}
        each = F.array(*[F.struct(F.lit(name).alias("facet"), key.alias("key"), passed(name).alias("ok")) for name, key in keys.items()])
        return rows.select(F.explode(each).alias("f")).where("f.ok").groupBy("f.facet", "f.key").agg(F.count("*").alias("n"))

    def term_counts(self, terms: list[str]) -> DataFrame:
        """(term, doc_id, n): occurrences of each term of a list, a word or a phrase, in each document that has it.

        Terms are a table of (term, place, token), so any number of them is one join; a phrase occurs where each
        of its places has its token.
        """
        rows = [(t, k, len(words), w) for t in dict.fromkeys(terms) if (words := split_words(t)) for k, w in enumerate(words)]
        rows += [(t, 0, 1, lam) for t in dict.fromkeys(terms) if len(words := split_words(t)) == 1 and (lam := with_lam(words[0]))]
        table = self.spark.createDataFrame(rows, "term string, place int, size int, token string")
        tokens = {r[3] for r in rows}
        postings = self.postings.where("not named")
        postings = postings.where(F.col("token").isin(*tokens)) if len(tokens) <= STATIC_TOKENS else postings
        found = postings.select("token", "doc_id", "tf", "positions").join(F.broadcast(table), "token")  # as long as the list that came in
        single = found.where("size = 1").groupBy("term", "doc_id").agg(F.sum("tf").alias("n"))
        if all(r[2] == 1 for r in rows):
            return single
        starts = found.where("size > 1").select("term", "doc_id", "size", F.explode("positions").alias("pos"), "place").groupBy("term", "doc_id", "size", (F.col("pos") - F.col("place")).alias("start")).agg(F.count_distinct("place").alias("k"))
        return single.unionByName(starts.where("k = size").groupBy("term", "doc_id").agg(F.count("*").alias("n")))

    def keyword_report(self, terms: list[str]) -> DataFrame:
        """(term, files, matches) of the terms that occur."""
        return self.term_counts(terms).groupBy("term").agg(F.count("*").alias("files"), F.sum("n").alias("matches"))

    def any_term(self, terms: list[str]) -> DataFrame:
        """(doc_id, matches) of the documents that hold at least one term."""
        return self.term_counts(terms).groupBy("doc_id").agg(F.sum("n").alias("matches"))
