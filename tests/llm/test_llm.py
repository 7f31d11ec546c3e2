"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline

from textloom.llm import bpe_duckdb, chat_format, decontaminate, flac_media, graph, line_dedup, ordinal_quality, piece_cache, simhash_mih, token_files, url_reputation, warc_zstd
from textloom.llm.piece_cache import PieceEncoder
from textloom.llm.queries import vocabulary

JSON, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "a  b", "a \n b", " 's don't x  \n\n y", "x <|endoftext|> y", "a\x1c b", "日本 語 x", "a ü's b'll c_d e1f ª º µ x² ×÷", "q\n's", "\nx y", "a.\nBc d\n", "😀" * 30, "=" * 80 + " x", "a" * 300]
DOCS = "doc_id long, text string, lang string, ids string, fp string, tag string, fingerprint string, n_lines string"


def documents(spark, texts, ids=None):
    """Rows with further columns whose names clash with those that operators make."""
    return spark.createDataFrame([((i if ids is None else ids[i]), t, "en", "x", "x", "x", "x", "x") for i, t in enumerate(texts)], DOCS)


def prose(n, words, seed=0):
    pick = random.Random(seed)
    return " ".join(pick.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do", "eius", "tempor"]) + str(pick.randrange(words)) for _ in range(n))


# --- token files -------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_byte_aligned_coding_round_trip(n):
    values = np.random.default_rng(n).integers(0, 1 << np.random.default_rng(n + 1).integers(1, 32, n), n, dtype=np.uint32) if n else np.zeros(0, np.uint32)
    control, data = token_files.pack(values)
    assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == values).all()


def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_pieces_give_the_ids_of_the_text():
    encoder, library = PieceEncoder.of(JSON), fresh_tokenizer()
    special = ["<|endoftext|>", "a <|endoftext|><|endoftext|> b\n<|endoftext|> ", "x<|endoftext|", prose(9, 50) + "<|endoftext|>" + prose(9, 50)]
    for text in filter(None, ODD + [prose(50, 1000)] + special):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert 50256 in np.frombuffer(encoder.encode("x <|endoftext|> y"), "<u4")


def test_parts_of_many_texts_give_their_ids(monkeypatch):
    """Texts together, of which each part is looked up once, against the library; parts are forgotten between them."""
    monkeypatch.setattr(piece_cache, "CACHE_PIECES", 50)
    encoder, library = PieceEncoder(JSON), fresh_tokenizer()
    marks = ["don't 'tis a'b's (x) -y- 12,5 e.g. «é» Œuvre's\nz's\n(q)\nw", "a\x01b", "\x01", "a\n", "\na", "a \nb", "a\n b", "a\n\nb", "x<|endoftext|> y", "naïve-ish, ŝi’s…", "a'll 'll l'l ''s"]
    texts = [*ODD, *marks, None, prose(40, 200, 5), prose(50, 1000)]
    for _ in range(2):
        got = encoder.encode_many(pa.array(texts, pa.string()).slice(1))
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts[1:]]
    assert encoder.encode_many(pa.array([], pa.string())) == []
    looked, known = [], encoder.parts.__class__.__getitem__
    monkeypatch.setattr(encoder, "parts", type("Seen", (dict,), {"__getitem__": lambda s, k: looked.append(k) or known(encoder.words, k)})())
    encoder.encode_many(pa.array(["the end, the end."] * 5))
    assert sorted(looked) == sorted([" end", " the", ",", ".", "the"])


def test_token_files_against_the_library(spark, tmp_path):
    texts = ODD + [prose(3000, 50, 1), prose(40, 1000, 2)]
    order = list(range(len(texts)))[::-1]
    docs = documents(spark, texts, order).unionByName(documents(spark, ["null id"], [None]))
    index = token_files.write_token_files(docs, JSON, str(tmp_path / "t"))
    got = [tuple(r) for r in token_files.digest_token_files(index).orderBy("start").collect()]
    library, start, want = fresh_tokenizer(), 0, []
    for doc_id, text in sorted([*zip(order, texts), (None, "null id")], key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = (library.encode(text, add_special_tokens=False).ids if text else []) + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert {r["doc_id"]: len(r["ids"]) for r in token_files.read_token_files(index).collect()} == {w[0]: w[2] for w in want}
    assert token_files.digest_token_files(token_files.write_token_files(docs.limit(0), JSON, str(tmp_path / "e"))).count() == 0


# --- line dedup ----------------------------------------------------------------------------------


def brute_lines(texts):
    first, covered = {}, [set() for _ in texts]
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        for p in range(max(1, len(lines) - 2)):
            w = tuple(lines[p : p + 3])
            if w not in first:
                first[w] = (d, p)
            else:
                fd, fp = first[w]
                covered[d] |= set(range(max(p, fp + len(w)) if fd == d else p, p + len(w)))
    return [(len((t or "").split("\n")), len(c), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in c)) for t, c in zip(texts, covered)]


def test_line_dedup_against_brute_force(spark):
    pick = random.Random(5)
    texts = ["\n".join(pick.choice("abcd") for _ in range(pick.randrange(1, 9))) for _ in range(40)] + ["a\na\na\na\na", "", None, "long\n" * 3000, "x"]
    got = line_dedup.dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"], r["text"]) for r in got] == brute_lines(texts)
    twice = documents(spark, ["p\nq\nr"]).unionByName(documents(spark, ["p\nq\nr"])).unionByName(documents(spark, ["z\np\nq\nr"], [None]))
    # a null id is the least, so its occurrence is the first; equal rows are one
    assert sorted((r["doc_id"] is None, r["text"]) for r in line_dedup.dedup_lines(twice).collect()) == [(False, ""), (False, ""), (True, "z\np\nq\nr")]
    assert line_dedup.dedup_lines(documents(spark, ["x"]).limit(0)).count() == 0
    assert line_dedup.keep_new_lines(documents(spark, ["a\nb\nc", "a\nb\nc", "d"])).count() == 2


# --- URL filters ---------------------------------------------------------------------------------


def test_rules_and_reputation(spark):
    urls = ["https://A.example.org/es/x", "http://example.org/en/12?x", "http://x.com/fr/1", "http://y.com/de/", "http://org/", "http://org", "no", None, "http://spam.net/1", "http://fine.net/1", "http://notexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    more = spark.createDataFrame([(100 + i, f"http://{'spam' if i % 2 else 'fine'}.net/{i}", "x") for i in range(120)], pages.schema)
    outcomes = spark.createDataFrame([(100 + i, i % 2) for i in range(120)] + [(None, 1), (3, None), (999, 1)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages.unionByName(more), outcomes).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 1, 5, 6, 7)] == [("a.example.org", "/es/x"), ("example.org", "/en/12"), ("org", ""), ("", ""), ("", "")]
    assert [got[i]["rule"] for i in range(11)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", "org/", None, None, None, None, None, "org/"]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 8, 9)] == ["block", "block", "allow", "block", "block", "allow"]
    assert got[8]["bad_rate"] > 0.9 and got[9]["bad_rate"] < 0.1
    assert {r["verdict"] for r in url_reputation.judge_urls(more, outcomes.limit(0)).collect()} == {"allow"}
    assert url_reputation.judge_urls(pages.limit(0), outcomes).count() == 0


def test_registered_domains(spark):
    hosts = ["a.b.example.org", "example.org:8080", "user:pw@x.example.org.", "a.co.uk", "co.uk", "x.a.co.uk:80", "10.0.3.4", "10.0.3.4:80", "[::1]:443", "localhost", "", "."]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in rows.select("host", url_reputation.registered_domain(rows["host"]), url_reputation.suffix(rows["host"])).collect()]
    assert {h: (d, s) for h, d, s in got} == {
        "a.b.example.org": ("example.org", "org"), "example.org:8080": ("example.org", "org"), "user:pw@x.example.org.": ("example.org", "org"), "a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "x.a.co.uk:80": ("a.co.uk", "co.uk"), "10.0.3.4": ("10.0.3.4", "10.0.3.4"), "10.0.3.4:80": ("10.0.3.4", "10.0.3.4"), "[::1]:443": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "": ("", ""), ".": ("", ""),
    }


def test_any_number_of_rules(spark, monkeypatch):
    pick = random.Random(3)
    hosts, paths = ["a.b.c", "b.c", "c", "x.c", "d", "", "a..c"], ["", "/", "/p", "/p/q", "/q"]
    rules = tuple(url_reputation.Rule(pick.choice(["allow", "block"]), pick.choice(["c", "b.c", "d", "", "a.b.c"]) + pick.choice(["/", "/p", "/p/q", "/q"])) for _ in range(12))
    rows = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] * 2, "page_id long, host string, path string")
    few = sorted(map(str, url_reputation.with_rules(rows, rules).collect()))
    monkeypatch.setattr(url_reputation, "EXPRESSION_RULES", 2)
    assert sorted(map(str, url_reputation.with_rules(rows, rules).collect())) == few


# --- WARC ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    index = warc_zstd.write_warc(pages, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc_zstd.read_warc(index).collect()}
    assert len(got) == len(rows)
    for page_id, _, text in rows:
        payload = (text or "").encode()
        assert (got[page_id]["payload_bytes"], got[page_id]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert got[page_id]["payload"] is None or bytes(got[page_id]["payload"]) == payload
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2)}
    assert got[1]["url"] == "http://a/%0D%0Ax"
    head = next((tmp_path / "w").glob("*.warc.zst")).read_bytes()[:4]
    assert struct.unpack("<I", head)[0] == 0x184D2A5D
    assert warc_zstd.read_warc(warc_zstd.write_warc(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_cut_archives_are_errors(spark, tmp_path, monkeypatch):
    """An archive that was cut anywhere does not read as a shorter one."""
    import io

    monkeypatch.setattr(warc_zstd, "FEED_BYTES", 64)
    pages = spark.createDataFrame([(i, f"u{i}", prose(30, 50, i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = warc_zstd.write_warc(pages, f"{tmp_path}/w")
    (row,) = index.collect()
    data = open(row["path"], "rb").read()
    records = list(warc_zstd.read_archive(io.BytesIO(data)))
    assert len(records) == row["n_records"] == 40
    ends, at = set(), len(data)
    for cut in [1, 5, 20, 60, 200, *range(300, len(data), 977), len(data) - 3, len(data)]:
        try:
            got = list(warc_zstd.read_archive(io.BytesIO(data[: at - cut])))
            ends.add(len(got))  # cut between two records: the index notices
            assert got == records[: len(got)]
        except ValueError:
            continue
    assert 40 not in ends
    short = spark.createDataFrame([(row["path"], 41)], "path string, n_records long")
    with pytest.raises(Exception, match="has 40 records, not 41"):
        warc_zstd.read_warc(short).collect()
    with open(row["path"], "wb") as out:
        out.write(data[:-5])
    with pytest.raises(Exception, match="within a record"):
        warc_zstd.read_warc(index).collect()


def test_warc_task_goes_on_in_further_files(spark, tmp_path):
    """A task whose archives are full at once writes as many files as it takes, and loses no page."""
    folder = str(tmp_path / "w")

    def small_files(batches):
        whole = warc_zstd.FILE_BYTES, warc_zstd.SAMPLE_RECORDS
        warc_zstd.FILE_BYTES, warc_zstd.SAMPLE_RECORDS = 4, 3
        try:
            yield from warc_zstd._write_batches(batches, folder)
        finally:
            warc_zstd.FILE_BYTES, warc_zstd.SAMPLE_RECORDS = whole

    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(10)], "page_id long, url string, html string").coalesce(1)
    index = spark.createDataFrame(warc_zstd.plan_records(pages).coalesce(1).mapInArrow(small_files, "path string, n_records long").collect(), "path string, n_records long")
    assert sorted(r["n_records"] for r in index.collect()) == [1, 3, 3, 3]
    got = warc_zstd.read_warc(index).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got) == [(i, f"<p>{i}</p>") for i in range(10)]


# --- SimHash -------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ["", None, "One", "one Two", "É x y z", prose(30, 5), prose(500, 900), "a\x0bb\x1cc d"]:
        assert simhash_mih.fingerprint(text) == brute_fingerprint(text), text


def roots_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_against_all_pairs(spark, monkeypatch):
    pick = random.Random(3)
    centres = [pick.getrandbits(64) for _ in range(30)]
    values = {0, (1 << 64) - 1} | set(centres)
    for c in centres:
        for _ in range(12):
            values.add(c ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(1, 6))))
    low = pick.getrandbits(32)
    values |= {low | pick.getrandbits(7) << 32 for _ in range(90)}  # one hot segment
    monkeypatch.setattr(simhash_mih, "HOT_SEGMENT", 20)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {(r["a"], r["b"]) for r in simhash_mih.linked_fingerprints(fps).collect()}
    own = sorted(map(signed, values))
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}
    assert got == want
    roots = {r["node"]: r["root"] for r in graph.connected_components(simhash_mih.linked_fingerprints(fps)).collect()}
    assert roots == {n: r for n, r in roots_of(want, own).items() if n in roots} and set(roots) == {n for p in want for n in p}


def test_exploded_segments_are_not_broadcast(spark):
    links = simhash_mih.linked_fingerprints(spark.range(100).selectExpr("id * 7 as fp"))
    joins = [line for line in links._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"Join \[seg#\d+, key#\d+L, part#", line)]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_kept_rows_are_not_broadcast(spark):
    docs = documents(spark, ["a b", "c d", "c d"])
    kept = spark.range(3).selectExpr("id as _kept_id", "id as _kept_tag", "id as _kept_n")
    plan = simhash_mih.one_row_each(docs, kept, "doc_id", simhash_mih.row_tag("doc_id", "text"), "_kept_tag")
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.connected_components(links.limit(0)).count() == 0


def test_near_duplicates(spark):
    base = prose(400, 5000, 9)
    texts = [base, base.upper(), base + " end", prose(400, 5000, 10), "", None, "  "]
    got = simhash_mih.near_duplicates(documents(spark, texts)).orderBy("doc_id").collect()
    fps = [brute_fingerprint(t) for t in texts]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = roots_of(pairs, range(len(fps)))
    assert [r["component_id"] for r in got] == [want[i] for i in range(len(fps))]
    kept = simhash_mih.keep_one_of_each(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == documents(spark, texts).columns
    assert simhash_mih.near_duplicates(documents(spark, ["x"]).limit(0)).count() == 0
    assert [r["component_id"] for r in simhash_mih.near_duplicates(documents(spark, ["x y z", "x y z"], [None, 4])).collect()] == [4, 4]


# --- quality classifier --------------------------------------------------------------------------


def graded_corpus(n, seed):
    pick, rows = random.Random(seed), []
    for _ in range(n):
        words = [f"{a}{b}" for a in "bcdfg" for b in ("aro", "eni", "olt")]
        text, grade = " ".join(pick.choice(words) for _ in range(pick.randrange(20, 60))), 2
        if pick.random() < 0.2:
            text, grade = " ".join(w + "!!" for w in text.upper().split()), 1
        elif pick.random() < 0.2:
            text, grade = text.replace(" ", f" {pick.choice(['nasty', 'vile', 'rotten'])} ", 2), 0
        rows.append((text, grade))
    return rows


def test_held_out_accuracy(spark):
    train, held = graded_corpus(700, 1), graded_corpus(300, 2)
    docs = documents(spark, [t for t, _ in train] + ["", None])
    grades = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(train)], "id long, grade int")
    model = ordinal_quality.train(docs, grades)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in ordinal_quality.score(documents(spark, [t for t, _ in held] + [None, "", "w " * 50_000]), model).collect()}
    right = sum(got[i]["keep"] == (g == 2) for i, (_, g) in enumerate(held))
    assert right >= 0.97 * len(held)
    mean = lambda g: np.mean([got[i]["expected_grade"] for i, (_, x) in enumerate(held) if x == g])
    assert mean(0) < mean(1) < mean(2)
    again = ordinal_quality.train(docs, grades)
    assert np.allclose(again.weights, model.weights)


def test_likelihood_against_a_dense_form():
    """The fit's model is a minimum of the penalised likelihood, written out for dense rows, and scores by hand."""
    rows, grades, n = [], [], 90
    pick = np.random.default_rng(4)
    for _ in range(n):
        grade = int(pick.integers(0, 3))
        rows.append(np.unique(np.concatenate([pick.choice(6, 3, replace=False), [10 + grade] if pick.random() < 0.7 else []])).astype(np.int32))
        grades.append(grade)
    grades = np.array(grades)
    model = ordinal_quality.fit(rows, grades, steps=3000, rate=0.02)
    used = np.flatnonzero(model.weights)
    dense = np.array([[float(b in r) for b in used] for r in rows])

    def loss(params):
        theta, score = params[len(used) :], dense @ params[: len(used)]
        tail = [np.ones(n), *[1 / (1 + np.exp(t - score)) for t in theta], np.zeros(n)]
        return -sum(np.log(tail[g][i] - tail[g + 1][i]) for i, g in enumerate(grades)) / n + 0.5 * (params[: len(used)] ** 2).sum() / n

    best = np.concatenate([model.weights[used], model.thresholds])
    for i in range(len(best)):
        step = np.zeros(len(best))
        step[i] = 1e-4
        assert abs(loss(best + step) - loss(best - step)) / 2e-4 < 2e-3
    text = "Good words, good!"
    total = sum(model.weights[ordinal_quality.bucket(f)] for f in ordinal_quality.features(text))
    assert np.allclose(model.tails(total), [1 / (1 + np.exp(t - total)) for t in model.thresholds])
    assert {f for f in ordinal_quality.features("ab " + "!" * 40)} >= {b"wab", b"m" + b"!" * 40}


def test_fit_needs_little_memory_beside_its_features():
    pick = np.random.default_rng(5)
    rows = [np.unique(pick.integers(0, 60_000, 1000)).astype(np.int32) for _ in range(2000)]
    tracemalloc.start()
    try:
        ordinal_quality.fit(rows, pick.integers(0, 3, len(rows)), steps=2)
        assert tracemalloc.get_traced_memory()[1] < 16 * sum(map(len, rows))
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("block", [1, 7, 40, 1000])
def test_model_does_not_depend_on_blocks_or_partitions(spark, monkeypatch, block):
    texts = [prose(n % 37, 5, n) for n in range(120)] + [prose(30, 5, 1)] * 5 + ["", None]
    grades = [i % 3 for i in range(len(texts))]
    buckets = [np.unique(np.array([ordinal_quality.bucket(f) for f in ordinal_quality.features(t)], np.int32)) for t in texts]
    rows = sorted(zip(buckets, grades), key=lambda r: (r[0].tobytes(), r[1]))
    rows, sorted_grades = [r for r, _ in rows], np.array([g for _, g in rows])
    lone = [np.array([200_000 + i], np.int32) for i in range(3)]  # nothing of these is left
    want, padded = ordinal_quality.fit(rows, sorted_grades), ordinal_quality.fit([*lone, *rows, *lone], np.array([0, 1, 2, *sorted_grades, 0, 1, 2]))
    monkeypatch.setattr(ordinal_quality, "BLOCK", block)
    table = spark.createDataFrame([(i, g) for i, g in enumerate(grades)], "id long, grade int")
    got = ordinal_quality.train(documents(spark, texts).repartition(3), table)
    assert want.weights.any() and (got.weights == want.weights).all() and (got.thresholds == want.thresholds).all()
    again = ordinal_quality.fit([*lone, *rows, *lone], np.array([0, 1, 2, *sorted_grades, 0, 1, 2]))
    assert (again.weights == padded.weights).all() and (again.thresholds == padded.thresholds).all()


def test_labelled_features_are_bounded(spark):
    docs = documents(spark, [prose(40, 5, i) for i in range(60)])
    grades = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, grade int")
    whole, some = ordinal_quality.train(docs, grades), ordinal_quality.train(docs, grades, most=900)
    assert not np.allclose(some.thresholds, whole.thresholds)
    first = ordinal_quality.train(docs, grades, most=1)  # one text is taken whatever its size, so that something is fitted
    assert first.thresholds.tolist() != [0, 0] and not first.weights.any()
    assert ordinal_quality.train(docs, grades, most=1, least=1).weights.any()


def test_keep_good_on_odd_rows(spark):
    docs = documents(spark, [None, "", "x " * 30_000, "x", "x"], [1, None, 3, 4, 4])
    kept = ordinal_quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_labels_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, ordinal_quality.graded(labels).collect())) == [(1, 0), (2, 1)]
    docs = documents(spark, ["x"])
    assert ordinal_quality.classify(docs.limit(0), labels).count() == 0
    assert ordinal_quality.classify(docs, labels.limit(0)).first()["tail"] == 0.5
    assert ordinal_quality.keep_good(docs, labels.limit(0)).columns == docs.columns


# --- decontamination -----------------------------------------------------------------------------


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item_id, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            window = w[s : s + 10]
            for p in range(len(own) - len(window) + 1):
                if own[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found |= {str(item_id)} if item_id is not None else set()
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark):
    items = [(1, prose(25, 3, 1)), (2, prose(12, 3, 2)), (10, "Short ITEM, here"), (11, "a a a a a a a a a a a a"), (12, ""), (13, None), (None, "lone words of null"), (14, "short item here")]
    texts = [prose(60, 3, 3) + " " + prose(25, 3, 1)[30:150] + " tail", "x SHORT item; here! " + prose(12, 3, 2), "a " * 30, "lone words of null", "", None, prose(40, 2, 7), "été short item hére", prose(8000, 50, 8)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, w string")
    got = decontaminate.contamination(documents(spark, texts), bench).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert tuple(r)[1:] == brute_contamination(t, items), t
    assert sorted(r["doc_id"] for r in decontaminate.keep_uncontaminated(documents(spark, texts), bench).collect()) == [i for i, t in enumerate(texts) if not brute_contamination(t, items)[4]]
    assert not any(r["contaminated"] for r in decontaminate.contamination(documents(spark, texts), bench.limit(0)).collect())
    assert decontaminate.contamination(documents(spark, texts).limit(0), bench).count() == 0
    twice = documents(spark, texts[:1]).unionByName(documents(spark, texts[:1])).unionByName(documents(spark, texts[1:2], [0]))
    assert sorted(r["n_hit"] for r in decontaminate.contamination(twice, bench).collect()) == sorted([brute_contamination(t, items)[1] for t in (texts[0], texts[0], texts[1])])


def test_contamination_with_shuffled_sides(spark, monkeypatch):
    """Both joins as they are beyond the size of a broadcast give the same rows."""
    items = [(1, prose(25, 3, 1)), (2, "Short ITEM, here"), (3, "two words"), (4, "solo"), (5, "a a a a a a a a a a a a")]
    texts = [prose(40, 3, 3) + " " + prose(25, 3, 1)[20:150], "x short item, HERE two words", "solo", "a " * 40, "", None, prose(3000, 4, 9), "solo"]
    docs = documents(spark, texts, [0, 1, 2, 3, 4, 5, 6, 2]).unionByName(documents(spark, ["solo"], [None]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=str) == small
    assert [r[1:] for r in small if r[0] == 0] == [brute_contamination(texts[0], items)]
    assert sorted(str(r["text"]) for r in decontaminate.keep_uncontaminated(docs, bench).collect()) == sorted(str(t) for t in texts if not brute_contamination(t, items)[4])


# --- BPE -----------------------------------------------------------------------------------------


def test_bpe_against_the_library(spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_duckdb.load_ranks(RANKS), special_tokens={})
    pick = random.Random(1)
    texts = ODD + [prose(100, 1000), "".join(pick.choice("etaoins") for _ in range(700)), "".join(pick.choice("ab") for _ in range(300)), "x\x00y"]
    docs = documents(spark, texts)
    coded = {r["id"]: r["ids"] for r in bpe_duckdb.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert [coded[i] for i in range(len(texts))] == [library.encode_ordinary(t or "") for t in texts]
    back = {r["id"]: bytes(r["bytes"]) for r in bpe_duckdb.decode(bpe_duckdb.encode(docs, RANKS), RANKS).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").encode() for t in texts]
    assert bpe_duckdb.coding_report(docs.limit(0), RANKS).count() == 0


# --- FLAC ----------------------------------------------------------------------------------------


def test_flac_round_trip():
    noise = np.random.default_rng(1).integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    payloads = [flac_media.padded(t)[0] for t in ODD] + [noise, bytes(range(256)) * 3, b"\x00\xff" * 96, flac_media.padded("x" * 400_000)[0]]
    streams = flac_media.encode(payloads)
    for samples, payload in zip(flac_media.decode(streams), payloads):
        blocks = flac_media.pcm_blocks(samples)
        assert b"".join(p for _, p in blocks) == payload and [a for a, _ in blocks] == list(range(0, len(payload), flac_media.PCM_BLOCK))


def test_flac_checksums_are_verified():
    (stream,) = flac_media.encode([b"some text".ljust(192 * 3)])
    for at in (len(stream) - 1, len(stream) - 40, 20):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac_media.decode([bytes(broken)])


def read_bit_by_bit(stream):
    """A FLAC reader of its own: bits as a string, one value after the other, from the format's description."""
    place = 4
    while True:
        last, size = stream[place] & 0x80, int.from_bytes(stream[place + 1 : place + 4])
        place += 4 + size
        if last:
            break
    out, bits = [], "".join(f"{b:08b}" for b in stream[place:])
    at = 0

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at], 2) if n else 0

    def signed(n):
        value = take(n)
        return value - (1 << n) if value >> (n - 1) else value

    def rice(k):
        nonlocal at
        q = bits.index("1", at) - at
        at += q + 1
        u = q << k | take(k)
        return -(u + 1 >> 1) if u & 1 else u >> 1

    kinds = set()
    while at < len(bits):
        assert take(14) == 0x3FFE and take(2) == 0 and take(4) == 1
        take(12)
        lead = take(8)
        more = 0 if lead < 0x80 else f"{lead:08b}".index("0") - 1
        take(8 * more + 8)
        assert take(1) == 0
        kind = take(6)
        assert take(1) == 0
        kinds.add("lpc" if kind >= 32 else "fixed" if kind >= 8 else kind)
        if kind == 0:
            x = [signed(8)] * 192
        elif kind == 1:
            x = [signed(8) for _ in range(192)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [signed(8) for _ in range(order)]
            if kind >= 32:
                precision, shift = take(4) + 1, take(5)
                coefs = [signed(precision) for _ in range(order)]
            else:
                shift, coefs = 0, {0: [], 1: [1], 2: [2, -1]}[order]
            assert take(6) == 0
            k = take(4)
            for _ in range(192 - order):
                x.append((sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift) + rice(k))
        at = -(-at // 8) * 8
        take(16)
        out += x
    return out, kinds


def test_encoder_against_a_reader_of_its_own():
    wave = (128 + 90 * np.sin(np.arange(192 * 8) / 5) + np.random.default_rng(5).integers(-3, 4, 192 * 8)).astype(np.uint8).tobytes()
    payloads = [wave, np.random.default_rng(1).integers(0, 256, 192 * 3, dtype=np.uint8).tobytes(), b"\x07" * 192, bytes(range(192)), flac_media.padded(prose(200, 100, 3))[0]]
    seen = set()
    for stream, payload in zip(flac_media.encode(payloads), payloads):
        samples, kinds = read_bit_by_bit(stream)
        assert bytes(x + 128 for x in samples) == payload
        seen |= kinds
    assert seen == {0, 1, "fixed", "lpc"}


def test_sparse_seek_points(monkeypatch):
    payloads = [flac_media.padded(prose(n, 50, n))[0] for n in (3, 400, 900)]
    monkeypatch.setattr(flac_media, "MOST_POINTS", 3)
    for samples, payload in zip(flac_media.decode(flac_media.encode(payloads)), payloads):
        assert ((samples + 128) & 255).astype(np.uint8).tobytes() == payload


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - j) & 1 for j in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def crc(data, poly, bits):
    out = 0
    for byte in data:
        out ^= byte << (bits - 8)
        for _ in range(8):
            out = (out << 1 ^ poly if out >> (bits - 1) & 1 else out << 1) & (1 << bits) - 1
    return out


@pytest.mark.parametrize("kind", ["lpc", "escape", "fixed4"])
def test_foreign_streams_without_seek_points(kind):
    """Linear prediction, partitions, an escape code, and order 4, written bit by bit."""
    pick = random.Random(2)
    x = [max(-128, min(127, int(60 * np.sin(i / 5)) + pick.randrange(-3, 4))) for i in range(32)]
    w = BitWriter()
    if kind == "fixed4":
        order, coefs, shift = 4, [4, -6, 4, -1], 0
        w.put((8 | 4) << 1, 8)
    else:
        order, coefs, shift = 2, [29, -15], 4
        w.put((32 | order - 1) << 1, 8)
    for v in x[:order]:
        w.put(v & 255, 8)
    if kind != "fixed4":
        w.put(6 - 1, 4)
        w.put(shift, 5)
        for c in coefs:
            w.put(c & 63, 6)
    residual = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, 32)]
    w.put(0, 2)
    w.put(1, 4)
    for part in (residual[: 16 - order], residual[16 - order :]):
        if kind == "escape":
            w.put(15, 4)
            w.put(12, 5)
            for r in part:
                w.put(r & 4095, 12)
        else:
            w.put(2, 4)
            for r in part:
                u = 2 * r if r >= 0 else -2 * r - 1
                w.put(1, (u >> 2) + 1)
                w.put(u & 3, 2)
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0, 31])
    frame = head + bytes([crc(head, 7, 8)]) + w.bytes()
    frame += crc(frame, 0x8005, 16).to_bytes(2)
    md5 = hashlib.md5(np.array(x, np.int8).tobytes()).digest()
    info = struct.pack(">HH", 32, 32) + bytes(6) + (8000 << 44 | 7 << 36 | 32).to_bytes(8) + md5
    assert flac_media.decode([b"fLaC\x80" + len(info).to_bytes(3) + info + frame])[0].tolist() == x


def test_media_columns(spark):
    got = {r["doc_id"]: r for r in flac_media.media_report(documents(spark, ODD)).collect()}
    for i, text in enumerate(ODD):
        payload, n = flac_media.padded(text)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[0]["media_sha256"] == got[1]["media_sha256"]
    blocks = flac_media.read_pcm_blocks(flac_media.store_media(documents(spark, ["y" * 150_000]))).orderBy("block").collect()
    assert [r["sample_offset"] for r in blocks] == [0, 65536, 131072]
    assert flac_media.read_pcm_blocks(spark.createDataFrame([(1, 3, None)], "id int, n_bytes long, media binary")).count() == 0
    assert flac_media.media_report(documents(spark, ["x"]).limit(0)).count() == 0


# --- chat formatting -----------------------------------------------------------------------------


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "system", "be <|im_end|>"), (1, 1, "user", "x<\\|im_start|>y<|"), (1, 2, "assistant", "é<\\\\|im_end|>\n"), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "tail"),
        (2, 0, "user", "no reply"), (3, None, "assistant", "b"), (3, None, "assistant", "a"), (3, None, "assistant", "a"), (None, 0, "a\\n\nb\\", "odd role"), (4, 0, None, None),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    examples = chat_format.format_examples(df).collect()
    assert sorted((r["conv_id"] or 0, r["example"], r["n_turns"]) for r in examples) == [(0, 0, 1), (1, 0, 3), (1, 1, 5), (1, 2, 6), (2, 0, 1), (3, 0, 1), (3, 1, 2), (3, 2, 3), (4, 0, 1)]
    got = {r["conv_id"]: r for r in chat_format.format_report(spark, df).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        plain = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(own), hashlib.sha256(plain.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_report(spark, df.limit(0)).count() == 0


def test_chat_uses_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    for plan in (chat_format.format_report(spark, df), decontaminate.contamination(documents(spark, ["a"]), spark.createDataFrame([(1, "a")], "item_id long, text string"))):
        assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    train = graded_corpus(400, 4)
    passage = prose(15, 4, 21)
    extra = ["line one\nline two\nline three\nown words of this text", "line one\nline two\nline three", passage + " baroeni", "caro " * 30 + "\nfirst", "caro " * 30 + "\nfirst"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([t for t, _ in train] + extra)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, (_, g) in enumerate(train)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in stage.collect()}
        stage = spark.createDataFrame(f(spark, stage, str(tmp_path)).collect(), docs.schema)
        after = {r["doc_id"] for r in stage.collect()}
        assert after <= before
        if name == "ordinal_quality":
            clean = {i for i, (_, g) in enumerate(train) if g == 2}
            assert len(clean & after) >= 0.98 * len(clean) and len({i for i, (_, g) in enumerate(train) if g < 2} & after) <= 12
    assert stage.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert len(train) + 4 not in left and len(train) + 2 not in left and len(train) + 1 not in left
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == set(left)
    assert all(r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest() for r in final)


# --- similar texts ---------------------------------------------------------------------------------


def brute_similar(texts, threshold=0.8):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    return [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]


def altered(text, n, seed):
    """The text with ``n`` words replaced, so that similarities lie on both sides of 0.8."""
    pick, words = random.Random(seed), text.split()
    for at in pick.sample(range(len(words)), n):
        words[at] = f"new{pick.randrange(10**9)}"
    return " ".join(words)


def test_pipeline_keeps_one_of_similar_texts(spark):
    base = [prose(150, 10**6, s) for s in range(12)]
    texts = [altered(b, n, i) for i, b in enumerate(base) for n in (0, 1, 2, 3, 4, 6)] + [base[0], "", None, " ", "a b", "A  b", "a b c d e f"]
    step = base[1]
    for i in range(5):  # a chain whose ends are unlike
        step = altered(step, 2, 100 + i)
        texts.append(step)
    pairs = brute_similar(texts)
    root = roots_of(pairs, range(len(texts)))
    want = sorted({min(j for j in root if root[j] == root[i]) for i in root})
    assert any(bin(simhash_mih.fingerprint(texts[a]) ^ simhash_mih.fingerprint(texts[b])).count("1") > 3 for a, b in pairs)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), "").orderBy("doc_id").collect()]
    assert got == want


def test_rows_that_share_ids_or_names_are_not_lost(spark):
    x, y, z = prose(60, 10**6, 1), prose(60, 10**6, 2), prose(60, 10**6, 3)
    docs = documents(spark, [x, x, y, z, z, None, ""], [1, 5, 5, 7, 7, None, 9])
    for keep in (simhash_mih.keep_one_of_each, lambda d: corpus_pipeline.near_dedup(spark, d, "")):
        got = keep(docs)
        assert got.columns == docs.columns
        assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, x), (5, y), (7, z), (9, "")]
        assert keep(docs.limit(0)).count() == 0
    lines = spark.createDataFrame([(1, "a\nb\nc", "mine", "own"), (2, "a\nb\nc\nd", "mine", "own"), (3, None, None, "x"), (4, None, None, "x")], "doc_id long, text string, n_lines string, n_removed string")
    got = sorted(map(tuple, line_dedup.keep_new_lines(lines).collect()))
    assert got == [(1, "a\nb\nc", "mine", "own"), (2, "d", "mine", "own"), (3, None, None, "x")]


def brute_pipeline(docs, keep, items):
    """The stages in plain Python on (doc_id, text) rows without null ids; ``keep`` are the texts that the classifier keeps."""
    rows = sorted((i, t) for i, t in docs if t in keep)
    left = [(i, t) for (i, _), (n, gone, t) in zip(rows, brute_lines([t for _, t in rows])) if gone < n]
    root = roots_of(brute_similar([t for _, t in left]), range(len(left)))
    left = [left[k] for k in sorted(set(root.values()))]
    return [(i, t) for i, t in left if not brute_contamination(t, items)[4]]


def test_pipeline_against_brute_force(spark, tmp_path):
    import tiktoken

    train = graded_corpus(300, 8)
    passage, own = prose(15, 4, 21), [prose(80, 10**5, s) for s in range(6)]
    extra = ["p one\np two\np three\n" + own[0], "p one\np two\np three\n" + own[1], "p one\np two\np three", own[2], altered(own[2], 1, 1), altered(own[2], 2, 2), passage + " " + own[3], own[4] + "\n" * 3, "", None, "x y " * 9000, own[5], own[5]]
    docs = [*enumerate([t for t, _ in train]), *((1000 + i, t) for i, t in enumerate(extra))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string"
    spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, (_, g) in enumerate(train)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, passage), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = ordinal_quality.train(table, ordinal_quality.graded(spark.read.parquet(f"{tmp_path}/labels.parquet")))
    kept = {t for _, t in docs if round(model.tails(float(np.sum([model.weights[ordinal_quality.bucket(f)] for f in ordinal_quality.features(t)])))[-1], 6) >= 0.5}
    want = brute_pipeline(docs, kept, items)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_duckdb.load_ranks(RANKS), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    ids = [library.encode_ordinary(t or "") for _, t in want]
    assert got == sorted((i, len(x), digest(" ".join(map(str, x)).encode()), digest((t or "").encode())) for (i, t), x in zip(want, ids))


def test_pipeline_keeps_a_text_of_each_group_where_ids_repeat(spark):
    x, y = prose(100, 10**6, 1), prose(100, 10**6, 2)
    docs = documents(spark, [x, y, altered(x, 1, 3), altered(y, 1, 4), x], [1, 5, 5, 6, None])
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [(1, x), (5, y)]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_bpe_holds_the_pieces_of_few_texts_at_a_time():
    coder, texts = bpe_duckdb.Coder.of(RANKS, public_tokenizers.PATTERN), [prose(4000, 20, i) for i in range(40)]
    want = coder.encode(texts)
    tracemalloc.start()
    try:
        got = coder.encode(texts)
        assert tracemalloc.get_traced_memory()[1] < 8 * sum(map(len, texts))
    finally:
        tracemalloc.stop()
    alone = [coder.encode([t])[0] for t in texts]
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(want, got, alone)) and coder.decode(want) == [t.encode() for t in texts]
    assert [len(x) for x in coder.encode(["", ""])] == [0, 0]


def test_bpe_worker_keeps_no_words_after_a_task():
    """Idle workers take tasks in turn, so an executor would hold the words of each of them."""
    texts, seen = pa.array([prose(400, 20, i) for i in range(20)] + [None]), []
    batch = pa.RecordBatch.from_arrays([pa.array(range(21)), texts], ["id", "text"])
    for run in (bpe_duckdb._report_batches, bpe_duckdb._encode_batches, bpe_duckdb._report_batches):
        seen.append([x.to_pydict() for x in run(iter([batch]), RANKS, public_tokenizers.PATTERN)])
        coder = bpe_duckdb.Coder._loaded[RANKS, public_tokenizers.PATTERN]
        assert not (coder.words or coder.pieces or coder.old_words or coder.old_pieces or coder._con)
    assert seen[0] == seen[2] and len(seen[0][0]["id"]) == 21
    stopped = bpe_duckdb._report_batches(iter([batch]), RANKS, public_tokenizers.PATTERN)
    next(stopped)
    stopped.close()
    assert not coder.words


def test_bpe_looks_up_each_word_once_whatever_follows_it():
    """Words between which the pattern always splits, among others, against the library; null is empty."""
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_duckdb.load_ranks(RANKS), special_tokens={})
    coder = bpe_duckdb.Coder(RANKS, public_tokenizers.PATTERN)
    coder.encode(["Zorblat, zorblat. zorblat!\nzorblat; zorblat's (zorblat) zorblat"])
    assert not coder.pieces and {w for w in coder.words if "orblat" in w} == {"Zorblat", " zorblat", "zorblat", " (zorblat"}
    pick = random.Random(11)
    kinds = ["a", "Don't", "'s", "'tis", "ø", "ªº", "x²", "1,5", "×", "=", "--", "é.", "(", "'", "''ll", " ", "\n", "b" * 60]
    texts = [" ".join("".join(pick.choice(kinds[:most]) for _ in range(pick.randrange(1, 4))) for _ in range(30)) for most in [15, 18] * 40]
    texts += [*ODD, "日本 a,b", "x" * 3000 + ",", "\x01 a", "a\x01,b"]
    even = piece_cache.even_texts(pa.array([t or "" for t in texts]))
    assert even.any() and not even.all()
    ids = coder.encode(pa.array(texts))
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(x).decode() for x in coder.decimals(ids)] == [" ".join(map(str, x.tolist())) for x in ids]
    assert coder.decode(ids) == [(t or "").encode() for t in texts]
    assert coder.encode([]) == coder.decode([]) == coder.decimals([]) == []


def test_bpe_decodes_no_list_with_an_unknown_id():
    coder = bpe_duckdb.Coder.of(RANKS, public_tokenizers.PATTERN)
    with pytest.raises(ValueError, match="not in the vocabulary"):
        coder.decode([np.array([72, 10**6, 71], "<u4")])


def test_bpe_of_very_long_words():
    """Cut words, neighbourhoods, runs of equal pairs, and ranks below those of their parts, against the library."""
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_duckdb.load_ranks(RANKS), special_tokens={})
    pick = random.Random(7)
    draw = lambda kinds, n: "".join(pick.choice(kinds) for _ in range(n))
    texts = [draw("abcdefghijklmnopqrstuvwxyz", 9000), draw("acgt", 9000), draw("0123456789", 6000), draw(["the", "tion", "ing", "er", "a"], 2000), "a" * 20_000, "=" * 3001, "the" * 3000, "wwwhhhaaaa" * 400, "abcabcabd" * 400, "日本語テキスト" * 500, draw("ab", 3000)]
    coder = bpe_duckdb.Coder.of(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), text[:40]
        assert coder.decode([ids]) == [text.encode()]


def test_bpe_decodes_nulls(spark):
    coded = spark.createDataFrame([(1, None), (2, []), (None, [72, 71]), (None, [72, 71])], "id long, ids array<int>")
    got = sorted(((r["id"] or 0, r["bytes"]) for r in bpe_duckdb.decode(coded, RANKS).collect()), key=str)
    vocabulary = {v: k for k, v in bpe_duckdb.load_ranks(RANKS).items()}
    assert got == sorted([(1, None), (2, b""), (0, vocabulary[72] + vocabulary[71]), (0, vocabulary[72] + vocabulary[71])], key=str)
