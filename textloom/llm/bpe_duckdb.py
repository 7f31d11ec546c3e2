"""Byte-level BPE by recursive queries of an in-process DuckDB in each partition.

Words (matches of the split pattern) are token-position rows, at first one for each byte.  A step of
the recursion joins neighbouring tokens to the merge table and contracts, in each word, the leftmost
pair of the least rank; a word without such a pair is done.  As in tiktoken, a word that is a token of
the vocabulary as a whole is that token; a join finds these.  Distinct words are merged
once for as long as a task remembers them: Spark deals tasks to all idle workers in turn, so what
a worker kept would be held as often as an executor has workers.  Decoding joins ids to their bytes
in the order of their places.

A word of more than ``LONG_WORD`` bytes is first cut where no token of the vocabulary lies across:
no merge can cross such a place, so the parts are merged by themselves.  A part that is still longer
than ``LONG_PART`` contracts, in a step, the leftmost least pair of each neighbourhood instead of that of
the whole part.  Contractions spread from a pair only as far as tokens that occur in the part are long,
so pairs that are least within three times that distance do not touch each other's order, and the
result is that of one contraction at a time.  Equal pairs are contracted together, every second of a run
of overlapping ones, unless one before them might form a pair of lower rank.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_cache import coded_parts, cut_text, even_texts, letters_and_tail, one_split, with_lead
from .shared import return_memory, text_slices

#: The pattern of byte_bpe_50k; only under it texts are cut at spaces first, which changes nothing.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Of words, and of pieces of text, in a generation of what a task remembers.  Results do not depend on it.
CACHE_WORDS, CACHE_PIECES = 300_000, 100_000
#: Bytes of text that are encoded together, ids that are decoded together, token rows of a recursion,
#: and rows over all its steps.
BATCH_BYTES, DECODE_IDS, QUERY_ROWS, STEP_ROWS = 1 << 20, 1 << 18, 100_000, 2_000_000
#: Characters of texts whose pieces are strings at the same time.
CUT_CHARS = 1 << 18
#: Bytes of a word that is not cut, and of a part that contracts one pair in a step.
LONG_WORD, LONG_PART = 48, 256
#: Of DuckDB, for rows of ordinary size; a part of more bytes gets ROW_BYTES for each.
MEMORY_MB, ROW_BYTES = 400, 500

#: Rows are (x, id, nx, nid): word << 32 | position, token, place and token of the next row.
_STEPS = {
    # one pair of each word in a step
    "single": """
WITH RECURSIVE step(x, id, nx, nid, live, depth) AS (
  SELECT x, id, nx, nid, true, 0 FROM init
  UNION ALL (
  WITH pairs AS MATERIALIZED (
    SELECT s.x, s.x >> 32 AS w, s.id, s.nx, s.nid, s.depth, (m.c::BIGINT << 32) | (s.x & 4294967295) AS k
    FROM step s LEFT JOIN merges m ON s.id = m.a AND s.nid = m.b WHERE s.live AND s.depth < {depth}),
  best AS (SELECT w, min(k) AS k, arg_min(nx, k) AS gone FROM pairs GROUP BY w),
  fused AS MATERIALIZED (
    SELECT best.w, best.k, (best.k >> 32)::INTEGER AS c, (best.w << 32) | (best.k & 4294967295) AS spot, best.gone, b.nx, b.nid
    FROM best LEFT JOIN pairs b ON b.x = best.gone)
  SELECT t.x, CASE WHEN t.x = spot THEN c ELSE t.id END, CASE WHEN t.x = spot THEN fused.nx ELSE t.nx END,
         CASE WHEN t.x = spot THEN fused.nid WHEN t.nx = spot THEN c ELSE t.nid END, fused.k IS NOT NULL, t.depth + 1
  FROM pairs t JOIN fused ON t.w = fused.w WHERE fused.k IS NULL OR t.x <> gone))
SELECT x, id, live FROM step WHERE NOT live OR depth = {depth}""",
    # the least pairs of each neighbourhood in a step: of a run of overlapping equal ones every second;
    # no further equal one where the contraction of one may form a pair of lower rank (loud)
    "spread": """
WITH RECURSIVE step(x, id, nx, nid, live, depth) AS (
  SELECT x, id, nx, nid, true, 0 FROM init
  UNION ALL (
  WITH pairs AS (
    SELECT s.x, s.x >> 32 AS w, s.id, s.depth, m.c, (m.c::BIGINT << 32) | (s.x & 4294967295) AS k
    FROM step s LEFT JOIN merges m ON s.id = m.a AND s.nid = m.b WHERE s.live AND s.depth < {depth}),
  near AS (
    SELECT *, min(k) OVER (PARTITION BY w ORDER BY x RANGE BETWEEN {near} PRECEDING AND {near} FOLLOWING) AS least, count(k) OVER (PARTITION BY w) AS n,
           lag(id) OVER o AS before, lead(id, 2) OVER o AS behind, lag(c) OVER o IS DISTINCT FROM c AS fresh FROM pairs WINDOW o AS (PARTITION BY w ORDER BY x)),
  judged AS (
    SELECT t.*, coalesce(t.c = least >> 32, false) AS fits, coalesce(l.c < t.c, false) OR coalesce(r.c < t.c, false) OR coalesce(d.c < t.c, false) AS loud
    FROM near t LEFT JOIN merges l ON l.a = t.before AND l.b = t.c LEFT JOIN merges r ON r.a = t.c AND r.b = t.behind LEFT JOIN merges d ON d.a = t.c AND d.b = t.c),
  runs AS (
    SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY w ORDER BY x) AS run,
           min(CASE WHEN loud THEN c END) OVER (PARTITION BY w ORDER BY x RANGE BETWEEN {near} PRECEDING AND CURRENT ROW) AS loudest FROM judged),
  placed AS (SELECT *, bool_and(fits) OVER r AS clear, row_number() OVER r AS q FROM runs WINDOW r AS (PARTITION BY w, run ORDER BY x)),
  hits AS (SELECT *, c IS NOT NULL AND (k = least OR clear AND q % 2 = 1 AND loudest IS DISTINCT FROM c) AS hit FROM placed),
  taken AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY x), false) AS gone FROM hits),
  fused AS (SELECT x, w, CASE WHEN hit THEN c ELSE id END AS id, n > 0 AS live, depth + 1 AS depth FROM taken WHERE NOT gone)
  SELECT x, id, lead(x) OVER o, lead(id) OVER o, live, depth FROM fused WINDOW o AS (PARTITION BY w ORDER BY x)))
SELECT x, id, live FROM step WHERE NOT live OR depth = {depth}""",
}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Trie:
    """All prefixes of a vocabulary as numbered nodes, to be walked from many places at once."""

    def __init__(self, tokens):
        node, edges, ends = {b"": 0}, [], set()
        for token in tokens:
            for i in range(1, len(token) + 1):
                prefix = token[:i]
                if prefix not in node:
                    node[prefix] = len(node)
                    edges.append((node[prefix[:-1]] << 8 | prefix[-1], node[prefix]))
            ends.add(node[token])
        edges.sort()
        self.keys, self.nodes = (np.array(x, np.int64) for x in zip(*edges))
        self.whole = np.zeros(len(node), bool)
        self.whole[list(ends)] = True

    def longest(self, raw: bytes) -> np.ndarray:
        """The length of the longest token at each position."""
        data, out = np.frombuffer(raw, np.uint8).astype(np.int64), np.ones(len(raw), np.int64)
        at, node, depth = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0
        while len(at):
            key = node << 8 | data[at + depth]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            at, node, depth = at[hit], self.nodes[found[hit]], depth + 1
            out[at[self.whole[node]]] = depth
            inside = at + depth < len(raw)
            at, node = at[inside], node[inside]
        return out


class Coder:
    """The vocabulary and its merge table in one DuckDB connection."""

    _loaded: dict[tuple, Coder] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern, self.cut = load_ranks(path), regex.compile(pattern), pattern == SPACED_PATTERN
        ranks = self.ranks
        #: Ids as decimals, each with the space before the next one.
        self.shown = pa.array([f"{i} " for i in range(max(ranks.values()) + 1)], pa.large_string())
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tables: dict[str, pa.Table] = {}
        self._con = None
        self._table("vocabulary", id=np.array(list(ranks.values()), np.int32), raw=list(ranks))
        self.trie: _Trie | None = None
        self.merging = False
        self.forget()

    @classmethod
    def of(cls, path: str, pattern: str) -> Coder:
        key = (path, pattern)
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, pattern)
        return cls._loaded[key]

    @property
    def con(self):
        if self._con is None:
            import duckdb

            self._con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "", "preserve_insertion_order": False})
            for name in self.tables:
                self._load(name)
        return self._con

    def _load(self, name: str) -> None:
        self._con.register("rows", self.tables[name])
        self._con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self._con.unregister("rows")

    def forget(self) -> None:
        """Drop words and pieces, and what DuckDB has taken; the vocabulary stays."""
        if self._con is not None:
            self._con.close()
            self._con = None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _table(self, name: str, **columns) -> None:
        self.con.execute(f"DROP TABLE IF EXISTS {name}")
        self.tables[name] = pa.table(columns)
        self._load(name)

    def _prepare_merges(self) -> None:
        """The merge table: every pair of tokens that make a token.  Who only decodes does not need it."""
        if not self.merging:
            ranks = self.ranks
            a, b, c = zip(*[(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]) if len(ranks) > 256 else ((), (), ())
            a, b, c = (np.array(x, np.int32) for x in (a, b, c))
            self._table("merges", a=a, b=b, c=c)
            self.merging = True

    def _merge(self, parts: list[bytes], near: int = 0) -> list[bytes]:
        """Ids of each part by the recursive query, repeated on what a bounded number of steps leaves."""
        sizes = np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(sizes)
        x = np.repeat(np.arange(len(parts), dtype=np.int64) << 32, sizes) | np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
        ids, kind = self.byte_id[np.frombuffer(b"".join(parts), np.uint8)], "spread" if near else "single"
        need = max(MEMORY_MB, len(x) * ROW_BYTES >> 20)
        self.con.execute(f"SET memory_limit = '{need}MB'")
        places, tokens = [], []
        while len(x):
            last = np.append(x[1:] >> 32 != x[:-1] >> 32, True)
            init = pa.table({"x": x, "id": ids, "nx": pa.array(np.append(x[1:], 0), mask=last), "nid": pa.array(np.append(ids[1:], 0).astype(np.int32), mask=last)})
            self.con.register("init", init)
            got = self.con.execute(_STEPS[kind].format(depth=max(1, min(64, STEP_ROWS // len(x))), near=near)).fetchnumpy()
            self.con.unregister("init")
            live = got["live"].astype(bool)
            places.append(got["x"][~live])
            tokens.append(got["id"][~live])
            order = np.argsort(got["x"][live])
            x, ids = got["x"][live][order], got["id"][live][order]
        place, token = np.concatenate(places), np.concatenate(tokens)
        order = np.argsort(place)
        raw, ends = token[order].astype("<u4").tobytes(), (4 * np.searchsorted(place[order], np.arange(1, len(parts) + 1) << 32)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_all(self, parts: list[bytes], near: int = 0) -> list[bytes]:
        """:meth:`_merge` in queries of bounded size."""
        out, at = [], 0
        while at < len(parts):
            until, size = at, 0
            while until < len(parts) and (until == at or size + len(parts[until]) <= QUERY_ROWS):
                size += len(parts[until])
                until += 1
            out += self._merge(parts[at:until], near)
            at = until
        return out

    def _merge_long(self, raw: bytes) -> bytes:
        """Ids of a long word, by parts that no token crosses."""
        self.trie = self.trie or _Trie(self.ranks)
        longest = self.trie.longest(raw)
        crossed = np.zeros(len(raw) + 1, np.int64)
        np.add.at(crossed, np.arange(len(raw)) + 1, 1)
        np.subtract.at(crossed, np.arange(len(raw)) + longest, 1)
        cuts = [0, *(np.flatnonzero(np.cumsum(crossed)[1:-1] == 0) + 1).tolist(), len(raw)]
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        small = dict.fromkeys(x for x in parts if len(x) <= LONG_PART)
        ids = dict(zip(small, self._merge_all(list(small))))
        for part in parts:
            if part not in ids:
                ids[part] = self._merge([part], near=3 * int(self.trie.longest(part).max()))[0]
        return b"".join([ids[x] for x in parts])

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words."""
        known = self.words
        new = [w for w in words if w not in known]
        if self.old_words:
            old = self.old_words
            known |= {w: old[w] for w in new if w in old}
            new = [w for w in new if w not in old]
        if not new:
            return
        self._prepare_merges()
        raws = [w.encode("utf-8") for w in new]
        asked = pa.table({"w": np.arange(len(raws)), "raw": pa.array(raws, pa.binary())})
        self.con.register("asked", asked)
        whole = self.con.execute("SELECT w, id FROM asked JOIN vocabulary USING (raw)").fetchnumpy()
        self.con.unregister("asked")
        for i, token in zip(whole["w"].tolist(), whole["id"].astype("<u4")):
            known[new[i]] = token.tobytes()
        left = [(w, r) for w, r in zip(new, raws) if w not in known]
        short = [x for x in left if len(x[1]) <= LONG_WORD]
        known |= zip([w for w, _ in short], self._merge_all([r for _, r in short]))
        known |= {w: self._merge_long(r) for w, r in left if len(r) > LONG_WORD}

    def _split(self, piece: str) -> list[str]:
        plain = letters_and_tail(piece) if self.cut else None
        return [x for x in plain if x] if plain else self.pattern.findall(piece)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of whole texts, as unsigned 32-bit integers; null is an empty text."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        even = even_texts(texts) if self.cut else np.zeros(len(texts), bool)
        gc.disable()  # nothing here makes cycles, and the lists of words would be searched for them
        try:
            if len(self.words) > CACHE_WORDS:
                self.old_words, self.words = self.words, {}
            coded = iter(coded_parts(texts.filter(pa.array(even)), self._ids_of_parts))
            others = iter(self._encode([] if even.all() else texts.filter(pa.array(~even)).to_pylist()))
            return [next(coded if e else others) for e in even.tolist()]
        finally:
            gc.enable()

    def _ids_of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts between which the pattern always splits; those of several words are remembered like a word."""
        known, old = self.words, self.old_words
        known |= {x: old[x] for x in parts if x in old}
        several = {x: self.pattern.findall(x) for x in parts if x not in known and not one_split(x)}
        self.learn({x for x in parts if x not in several}.union(*several.values()))
        known |= {x: b"".join([known[w] for w in words]) for x, words in several.items()}
        return [known[x] for x in parts]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.pieces) > CACHE_PIECES:
            self.old_pieces, self.pieces = self.pieces, {}
        known, old = self.pieces, self.old_pieces
        # the strings of a few texts at a time, since those of all pieces are many times their text
        heads, counts, coded = [], [], [pa.array([], pa.large_string()).dictionary_encode()]
        for some in _text_groups(texts):
            cut = [cut_text(t) if self.cut else [t] for t in some]
            heads += [c[0] for c in cut]
            counts += [len(c) - 1 for c in cut]
            coded.append(pa.array(chain.from_iterable([c[1:] for c in cut]), pa.large_string()).dictionary_encode())
            del cut
        coded = pa.chunked_array(coded).unify_dictionaries()
        pieces, at = coded.chunk(0).dictionary.to_pylist(), np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        missing = [x for x in pieces if x not in known]
        known |= {x: old[x] for x in missing if x in old}
        new = {x: [w for part in with_lead(x) for w in self._split(part)] for x in missing if x not in known}
        first = [self._split(h) for h in heads]
        self.learn(set(chain(chain.from_iterable(new.values()), chain.from_iterable(first))))
        words = self.words
        for piece, parts in new.items():
            known[piece] = words[parts[0]] if len(parts) == 1 else b"".join([words[x] for x in parts])
        # ids of each piece in its places: one gather for all texts
        blobs = [known[x] for x in pieces]
        sizes = np.array([len(x) >> 2 for x in blobs], np.int64)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(blobs), "<u4")))
        flat = lists.take(pa.array(at)).flatten().to_numpy()
        through = np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], np.cumsum(counts)])]
        leads = [np.frombuffer(b"".join([words[x] for x in f]), "<u4") for f in first]
        return [np.concatenate([lead, flat[a:b]]) for lead, a, b in zip(leads, through, through[1:])]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids: those of a bounded number of tokens at a time, in order."""
        flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
        ends, done, made = np.cumsum([0] + [len(x) for x in ids]), [], [np.zeros(1, np.int64)]
        for at in range(0, len(flat), DECODE_IDS):
            some = flat[at : at + DECODE_IDS]
            self.con.register("coded", pa.table({"p": np.arange(len(some), dtype=np.int32), "id": some}))
            got = self.con.sql("SELECT raw FROM coded JOIN vocabulary USING (id) ORDER BY p").to_arrow_table().column("raw")
            self.con.unregister("coded")
            if len(got) != len(some):
                raise ValueError("an id is not in the vocabulary")
            for chunk in got.cast(pa.large_binary()).chunks:
                until = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
                made.append(np.diff(until))
                done.append(memoryview(chunk.buffers()[2] or b"")[until[0] : until[-1]])
        cuts = np.cumsum(np.concatenate(made), dtype=np.int64)[ends].tolist()
        whole = memoryview(b"".join(done))
        return [bytes(whole[a:b]) for a, b in zip(cuts, cuts[1:])]

    def decimals(self, ids: list[np.ndarray]) -> list[memoryview]:
        """Each list of ids as decimals joined by a space."""
        shown = self.shown.take(pa.array(np.concatenate([*ids, np.zeros(0, "<u4")])))
        until = np.frombuffer(shown.buffers()[1], np.int64)[np.cumsum([0] + [len(x) for x in ids])].tolist()
        whole = memoryview(shown.buffers()[2] or b"")
        return [whole[a : max(a, b - 1)] for a, b in zip(until, until[1:])]


def _text_groups(texts: list[str], most: int = CUT_CHARS):
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def _slices(batches, path: str, pattern: str):
    """(coder, slice) of the texts of a task; in the end the worker forgets them."""
    coder = Coder.of(path, pattern)
    try:
        for batch in batches:
            for part in text_slices(batch, BATCH_BYTES):
                yield coder, part
    finally:
        coder.forget()
        return_memory()


def _encode_batches(batches, path: str, pattern: str):
    for coder, part in _slices(batches, path, pattern):
        ids = coder.encode(part.column(1))
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        flat = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], ["id", "ids"])


def _decode_batches(batches, path: str, pattern: str):
    coder = Coder.of(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = coder.decode([np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in part.column(1)])
            texts = [t if x.is_valid else None for t, x in zip(texts, part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["id", "bytes"])
    coder.forget()
    return_memory()


def encode(docs: DataFrame, ranks_path: str, pattern: str = SPACED_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each whole text, without special tokens.

    A null text is empty and has no ids; repeated rows and null ids stay; an empty table stays empty;
    other columns are ignored.  Whatever looks like a special token is ordinary text.  Texts are taken
    whole at any length; a task holds one text and some hundred bytes for each byte of the longest part
    of a word that no token boundary cuts (see the module's text).
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_encode_batches, path=ranks_path, pattern=pattern), f"id {kind}, ids array<int>")


def decode(coded: DataFrame, ranks_path: str, pattern: str = SPACED_PATTERN) -> DataFrame:
    """(id, bytes) of ``coded(id, ids)``; an empty list gives no bytes, null gives null.

    A null or unknown id within a list is an error.
    """
    kind = dict(coded.dtypes)["id"]
    return coded.select("id", "ids").mapInArrow(partial(_decode_batches, path=ranks_path, pattern=pattern), f"id {kind}, bytes binary")


def _report_batches(batches, path: str, pattern: str):
    """Encoding and decoding of a slice in one worker, so that a task needs a single vocabulary."""
    for coder, part in _slices(batches, path, pattern):
        ids = coder.encode(part.column(1))
        texts = coder.decode(ids)
        columns = [
            pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coder.decimals(ids)], pa.string()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def coding_report(docs: DataFrame, ranks_path: str, pattern: str = SPACED_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts encoded, and their ids decoded again.

    Nulls, empty and long texts, repeated rows, other columns and empty tables as in :func:`encode`.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_report_batches, path=ranks_path, pattern=pattern), schema)
