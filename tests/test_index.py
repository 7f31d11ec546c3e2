"""The word index against brute force."""

import re

import pytest

from textloom.functions.stem import stem
from textloom.functions.text import core_length, fold_text
from textloom.operators.matching import edit_distance
from textloom.operators.search import SearchRequest, documents_of
from textloom.plans import query as q
from textloom.plans.compile import Options
from textloom.store import index as module
from textloom.store.index import SearchIndex, build_index, update_index

TEXTS = {
    1: ("fr", "Un contrat signé. Deux contrats, trois CONTRATS de la contrée"), 2: ("es", "un contrato y dos contratos; contratación"), 3: ("en", "the contract of the contracts of the the the"),
    4: ("de", "contrat contrats"), 5: ("fr", None), 6: ("fr", ""), 7: ("en", "of of the"), 8: ("ar", "عقد العقد لعقد كتاب"), 9: ("en", "café café CAFE wor_ld x" + "y" * 80),
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    raw = spark.createDataFrame([(i, t, g, f"s{i % 2}", len(t or "")) for i, (g, t) in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return build_index(documents_of(raw), f"file://{tmp_path_factory.mktemp('index')}/i")


def tokens(text):
    return [t for raw in re.findall(r"[^\W]+(?:[̀-ًͯ-ْ]+\w*)*", text or "") if (t := fold_text(raw))]


def found(index, text, stems=False, **options):
    return {r["doc_id"]: r["matches"] for r in index.matches(q.parse(text), Options(**options), stems).collect()}


def test_words_and_phrases(index):
    count = lambda w: {i: n for i, (_, t) in TEXTS.items() if (n := tokens(t).count(w))}
    assert found(index, "contrat") == count("contrat") and found(index, "Café") == count("cafe") == {9: 3}
    assert found(index, '"of the"') == {3: 2, 7: 1} and found(index, '"the the"') == {3: 2}
    assert found(index, "the -contract") == {7: 1} and set(found(index, "NOT the")) == set(TEXTS) - {3, 7}
    assert found(index, "contrat OR contrato") == {1: 1, 2: 1, 4: 1} and found(index, "") == {} and found(index, "!!") == {}
    assert found(index, "contrat", whole_word=False) == {1: 3, 2: 3, 4: 2} 
    near = lambda w: {i: n for i, (_, t) in TEXTS.items() if (n := sum(edit_distance(x, w, 1) <= 1 for x in tokens(t)))}
    assert found(index, "LIKE contrat") == near("contrat") and found(index, "contract", fuzzy=True) == near("contract") and len(near("contract")) == 3
    with pytest.raises(ValueError):
        index.matches(q.parse("/a.b/"))


@pytest.mark.parametrize("word", ["contrat", "contrats", "contrato", "contract", "عقد"])
def test_inflected_forms(index, word):
    """Tokens of a document's language with the word's stem and about its length count as well."""
    want = {}
    for i, (lang, text) in TEXTS.items():
        for raw in re.findall(r"\w+", (text or "").lower()):
            token = fold_text(raw)
            wanted = stem(word, lang) if lang in module.STEMMED else None
            same = wanted is not None and stem(raw, lang) == wanted and abs(core_length(token) - core_length(fold_text(word))) <= 1
            if token in (word, "ل" + word) or same:
                want[i] = want.get(i, 0) + 1
    assert found(index, word, stems=True) == want and len(want) >= 1
    assert {r["doc_id"] for r in index.search(SearchRequest(word)).collect()} == set(want)


def test_many_forms_are_joined(index, monkeypatch):
    few = found(index, "a", whole_word=False)
    monkeypatch.setattr(module, "STATIC_TOKENS", 1)
    assert found(index, "a", whole_word=False) == few
    assert {r["term"]: (r["files"], r["matches"]) for r in index.keyword_report(["the", "of the", "contrat", "absent", "عقد"]).collect()} == {"the": (2, 6), "of the": (2, 3), "contrat": (2, 2), "عقد": (1, 2)}


def test_ranking_and_facets(index):
    listed = index.search(SearchRequest("contrat", fuzzy=True), stems=False).collect()
    assert len(listed) == 4
    assert [r["score"] for r in listed] == sorted((r["score"] for r in listed), reverse=True) and "body" not in listed[0].asDict()
    assert {(r["facet"], r["key"]): r["n"] for r in index.facets(SearchRequest("contrat", langs=["fr"]), own=True).collect() if r["facet"] == "lang"} == {("lang", "fr"): 1}
    assert {r["key"]: r["n"] for r in index.facets(SearchRequest("contrat", langs=["fr"])).collect() if r["facet"] == "lang"} == {"fr": 1, "und": 1}  # without its own filter


def test_batches_of_changes(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = lambda rows: documents_of(spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], columns))
    index = build_index(docs([(1, "old apple", "a"), (2, "apple pie apple", "a"), (3, "pear", "b")]), f"file://{tmp_path}/i")
    index = update_index(index, docs([(1, "new plum", "a"), (4, "apple", "b")]), docs([(3, "pear", "b")]))
    again = build_index(docs([(1, "new plum", "a"), (2, "apple pie apple", "a"), (4, "apple", "b")]), f"file://{tmp_path}/w")
    for words in ("apple", "old", "plum", "pear", "appl*", '"apple pie"', "NOT apple", "LIKE appla"):
        assert found(index, words) == found(again, words)
    rank = lambda x: [(r["doc_id"], round(r["score"], 9)) for r in x.search(SearchRequest("apple OR plum")).collect()]
    assert rank(index) == rank(again) and sorted(map(tuple, index.sites.collect())) == sorted(map(tuple, again.sites.collect()))
    index = update_index(index, docs([(3, "pear apple", "b")]), docs([]))
    assert found(SearchIndex(spark, index.folder), "pear") == {3: 1} and len(index.numbers) == 3
    _ = (tmp_path / "i" / "g000002" / "sites" / "_SUCCESS").unlink()  # a batch that did not end
    assert found(SearchIndex(spark, index.folder), "pear") == {}


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_words_are_grouped_where_their_text_is_read(spark, tmp_path, monkeypatch):
    """A text's words become postings without a shuffle, in runs sorted by token, however long a run is."""
    texts = [(7, "s", "en", False, 0, ["café", "a", "café", "b"], ["", " ", "\n", "--é"]), (8, None, "fr", False, 0, [], []), (9, "s", "fr", True, 100, ["cafe"], ["> "])]
    rows = spark.createDataFrame(texts, "doc_id long, site_id string, lang string, named boolean, start int, raw array<string>, gap array<string>").coalesce(1)
    wanted = {("a", "a", "en", "s", 7, False, 1, (1,), (5,)), ("b", "b", "en", "s", 7, False, 1, (3,), (14,)), ("cafe", "café", "en", "s", 7, False, 2, (0, 2), (0, 7)), ("cafe", "cafe", "fr", "s", 9, True, 1, (100,), (2,))}
    for words in (module.RUN_WORDS, 1):
        monkeypatch.setattr(module, "RUN_WORDS", words)
        made = module._postings(rows)
        assert "Exchange" not in _plan(made)
        got = [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in made.collect()]
        assert set(got) == wanted and len(got) == len(wanted)
        assert words == 1 or [r[0] for r in got] == sorted(r[0] for r in got)


def test_many_spellings_need_no_shuffle_of_postings(index, monkeypatch):
    few = {o: found(index, w, **o_) for o, (w, o_) in {"part": ("a", {"whole_word": False}), "typo": ("LIKE contrat", {})}.items()}
    monkeypatch.setattr(module, "STATIC_TOKENS", 0)
    assert {o: found(index, w, **o_) for o, (w, o_) in {"part": ("a", {"whole_word": False}), "typo": ("LIKE contrat", {})}.items()} == few
    rows, _ = index._rows([module._asked(q.Word("a"), Options(whole_word=False), False)])
    assert "Exchange" not in _plan(rows) and "Join" not in _plan(rows)


@pytest.mark.parametrize("word", ["contrat", "عقد"])
def test_many_forms_beside_typos(index, monkeypatch, word):
    few = found(index, word, stems=True, fuzzy=True)
    monkeypatch.setattr(module, "STATIC_TOKENS", 0)
    assert found(index, word, stems=True, fuzzy=True) == few and few
