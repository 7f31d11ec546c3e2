"""The index as a log of generations: merges, removed documents, interrupted batches, and spellings by their trigrams."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.cli import main
from textloom.operators.matching import edit_distance
from textloom.operators.search import SearchRequest, documents_of, hits
from textloom.plans import query as q
from textloom.plans.compile import Options
from textloom.store import index as module
from textloom.store.index import SearchIndex, build_index, merge_from, update_index
from textloom.store.sync import sync_folder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["apple", "apples", "grape", "pear", "peer", "plum", "of", "the"]


def docs(spark, texts):
    return documents_of(spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts.items()], COLUMNS))


def answers(index):
    asked = [("apple", {}), ("pear -plum", {}), ('"of the"', {}), ("NOT apple", {}), ("app", {"whole_word": False}), ("LIKE pear", {}), ("grapes", {"fuzzy": True})]
    out = [sorted(map(tuple, index.matches(q.parse(text), Options(**o), stems=True).collect())) for text, o in asked]
    ranked = [(r["doc_id"], round(r["score"], 9)) for r in index.search(SearchRequest("apple OR pear", limit=1000)).collect()]
    return out, ranked, sorted(map(tuple, index.sites.collect()))


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_generations_are_one_index(spark, tmp_path, one_partition, monkeypatch):
    """Documents added, replaced and removed in batches, merged on several levels: the answers of a fresh build, from few generations."""
    monkeypatch.setattr(module, "TIER", 2)
    pick, folder = random.Random(3), f"file://{tmp_path}/i"
    write = lambda: " ".join(pick.choices(WORDS, k=8))
    state = {i: write() for i in range(20)}
    index, most = build_index(docs(spark, state), folder), 0
    for step in range(5):
        fresh = {i: write() for i in [*pick.sample(sorted(state), 1), 100 + step]}
        gone = pick.sample(sorted(set(state) - set(fresh)), 1) if step % 3 == 0 else []
        index = update_index(index, docs(spark, fresh), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        state = {i: t for i, t in (state | fresh).items() if i not in gone}
        most = max(most, len(index.numbers))
    assert most <= 4 and len(list((tmp_path / "i").glob("g*"))) <= 12
    assert sorted(r["doc_id"] for r in index.documents.collect()) == sorted(state)
    assert answers(index) == answers(build_index(docs(spark, state), f"file://{tmp_path}/w"))


def test_merges_are_logarithmic():
    sizes, moved = [], 0
    for _ in range(3000):
        sizes.append(1)
        while (first := merge_from(sizes)) is not None:
            moved += sum(sizes[first:])
            sizes = [*sizes[:first], sum(sizes[first:])]
        assert len(sizes) <= 3 * 7
    assert sum(sizes) == 3000 and moved <= 3000 * 7
    assert merge_from([]) is None and merge_from([10**6, 1, 1, 1]) is None and merge_from([10**6, 1, 1, 1, 0]) == 1


def test_an_interrupted_merge_changes_nothing(spark, tmp_path, monkeypatch):
    index = build_index(docs(spark, {1: "apple", 2: "pear"}), f"file://{tmp_path}/i")
    for i in range(2):
        index = update_index(index, docs(spark, {10 + i: "plum"}), spark.createDataFrame([], "doc_id long"))
    monkeypatch.setattr(module, "TIER", 3)
    plain = module._write_spellings
    monkeypatch.setattr(module, "_write_spellings", lambda words, path: plain(words, path) if "g000004" not in path else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        update_index(index, docs(spark, {1: "plum"}), spark.createDataFrame([(2,)], "doc_id long"))
    again = SearchIndex(spark, index.folder)
    assert again.numbers == [0, 1, 2, 3] and sorted(r["doc_id"] for r in again.matches(q.parse("plum")).collect()) == [1, 10, 11]
    monkeypatch.setattr(module, "_write_spellings", plain)
    after = update_index(again, docs(spark, {12: "plum"}), spark.createDataFrame([], "doc_id long"))
    assert len(after.numbers) < 4 and sorted(r["doc_id"] for r in after.matches(q.parse("plum")).collect()) == [1, 10, 11, 12]


@pytest.fixture(scope="module")
def spelled(spark, tmp_path_factory):
    pick = random.Random(9)
    words = {"".join(pick.choices("abcé", k=pick.randrange(1, 9))) for _ in range(400)} | {"a", "ab", "aaaa", "aaaaaaaa", "x" * 70}
    index = build_index(documents_of(spark.createDataFrame([(0, " ".join(sorted(words)), "en", "s", 1)], COLUMNS)), f"file://{tmp_path_factory.mktemp('grams')}/i")
    return index, {r["token"] for r in index.dictionary.select("token").collect()} - {"doc", "0", "txt"}


@pytest.mark.parametrize("word", ["a", "b", "ab", "abc", "aaaa", "abcab", "cabbac", "bcabcaab", "zz"])
def test_candidates_against_every_spelling(spelled, word):
    """Trigrams give what a look at all spellings gives, for parts of words and for one and two typos."""
    index, tokens = spelled
    got = lambda rows: sorted(r["token"] for r in rows.collect() if r["token"] not in ("doc", "0", "txt"))
    assert got(index._containing(word)) == sorted(t for t in tokens if word in t)
    for d in (1, 2):
        assert got(index._misspelt(word, d)) == sorted(t for t in tokens if edit_distance(t, word, d) <= d and len(t.encode()) < module.MAX_TOKEN_BYTES)


def test_candidates_are_read_by_their_trigrams(spark, spelled):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = spelled[0]._misspelt("abcab", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(gram, [" in plan and "dictionary" not in plan
    plan = spelled[0]._containing("ab")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(gram,ab)" in plan


def test_names_and_forms_are_found_as_by_a_scan(spark, tmp_path):
    """A document that only its name or another form of a word speaks for: the index lists what a scan of texts lists."""
    rows = [(1, "the red fox", "report-red.txt"), (2, "a contract", "blue.txt"), (3, "contracts", "red.txt"), (4, "nothing", "contract of red.txt"), (5, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, body string, name string").withColumns({"site_id": F.lit("s"), "lang": F.lit("en"), "path": F.concat(F.lit("p"), F.col("doc_id").cast("string")), "file": F.lit("f"), "inner": F.lit(None).cast("string"), "kind": F.lit("text"), "size": F.lit(1), "modified": F.lit(0), "name_raw": F.array("name")})
    index = build_index(table, f"file://{tmp_path}/i", bodies=True)
    listed = lambda frame: {r["doc_id"]: (r["exact"], r["matches"]) for r in frame.collect()}
    assert listed(index.search(SearchRequest("red"))) == {1: (2, 2), 3: (1, 1), 4: (1, 1)}
    assert listed(index.search(SearchRequest("red"), stems=False)) == {r["path"][1:] and int(r["path"][1:]): (r["exact"], r["matches"]) for r in hits(table, SearchRequest("red")).collect()}
    assert set(listed(index.search(SearchRequest("contract")))) == {2, 3, 4} and set(listed(index.search(SearchRequest("contract -red")))) == {2}
    assert listed(index.search(SearchRequest('"red the"'))) == {} and set(listed(index.search(SearchRequest('"of red"')))) == {4}
    assert [(r["path"], r["snippets"][0]["text"]) for r in index.hits(SearchRequest("fox")).collect()] == [("p1", "the red ⟦fox⟧")]
    assert [r["path"] for r in index.hits(SearchRequest("/f.x/")).collect()] == ["p1"]


def test_command_line_index_is_incremental(spark, tmp_path, capsys, monkeypatch):
    folder, index = tmp_path / "docs", f"{tmp_path}/i"
    folder.mkdir()
    for name in ("a", "b[1]", "c"):
        (folder / f"{name}.txt").write_text(f"red {name}")
    assert main(["index", str(folder), index]) == 0
    first = SearchIndex(spark, index)
    assert main(["index", str(folder), index]) == 0 and SearchIndex(spark, index).numbers == first.numbers == [0]
    (folder / "b[1].txt").write_text("blue sky, longer")
    (folder / "d.txt").write_text("red d")
    (folder / "c.txt").unlink()
    assert main(["index", str(folder), index]) == 0
    second = SearchIndex(spark, index)
    assert second.numbers == [0, 1]
    fresh = {r["name"] for r in spark.read.parquet(f"{index}/g000001/documents").collect()}
    assert fresh == {"b[1].txt", "d.txt"}  # nothing else was read
    capsys.readouterr()
    assert main(["search", "red", index, "--format", "csv"]) == 0
    assert {line.split(",")[4] for line in capsys.readouterr().out.splitlines()[1:]} == {"a.txt", "d.txt"}
    assert main(["search", "sky", index]) == 0 and main(["search", "c", index]) == 1
    assert sync_folder(spark, str(folder), index, "site").numbers == [0, 1]
