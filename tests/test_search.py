import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions.text import fold_text
from textloom.operators import dictionary, dupes, filters, matching, meaning, search
from textloom.operators.search import DOCUMENTS, SearchRequest
from textloom.plans import query as q
from textloom.plans.compile import InvalidQuery, Options, Source, compile_query

BODIES = {
    "a.txt": "The contract is signed.\nPayment follows the contract.\nEnd",
    "b.md": "Résumé of contracts, paiement, and more",
    "c.txt": "nothing here; payement late, une facture_2024-117",
    "d.txt": "far " + "x " * 200 + "apart",
    "e.txt": "",
    "f.txt": None,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("s1" if i < 3 else "s2", p, p, None, p, [p], "text", "en", len(b or ""), 86400 * 400 * i, 0, b) for i, (p, b) in enumerate(BODIES.items())]
    return spark.createDataFrame(rows, DOCUMENTS).cache()


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


@pytest.mark.parametrize(
    "text, options, expected",
    [
        ("contract", {}, ["a.txt"]), ("resume", {}, ["b.md"]), ('"the contract"', {}, ["a.txt"]), ("contract OR paiement", {}, ["a.txt", "b.md"]), ("contract -payment", {}, []),
        ("NOT contract", {}, ["b.md", "c.txt", "d.txt", "e.txt", "f.txt"]), ("contract", {"whole_word": False}, ["a.txt", "b.md"]), ("Contract", {"case_sensitive": True}, []),
        ("payment", {"fuzzy": True}, ["a.txt", "c.txt"]), ("LIKE paymant", {}, ["a.txt"]), ("/pa[iy]e?ment/", {}, ["a.txt", "b.md", "c.txt"]), ("far NEAR:100 apart", {}, []),
        ("signed NEAR:20 payment", {}, ["a.txt"]), ("LINES:2-3 signed", {}, []), ("LINES:1 signed", {}, ["a.txt"]), ("facture_2024-117", {}, ["c.txt"]), ("word OR /nothing/", {}, ["c.txt"]),
        ("a", {}, ["a.txt"]), ("", {}, []), ("the NEAR:30 signed NEAR:30 contract", {}, ["a.txt"]),
    ],
)
def test_queries(docs, text, options, expected):
    request = SearchRequest(text, **options)
    assert paths(search.matching(docs, request)) == expected


def test_compiled_counts_agree_with_the_matcher(docs):
    for text in ("the", "contract", "LIKE payement", '"the contract"', "/e+/"):
        parsed = q.parse(text)
        compiled = compile_query(parsed, Source.of(F.coalesce("body", F.lit(""))))
        spans = matching.match_spans(F.col("body"), parsed)
        for r in docs.select("body", compiled.matches.alias("n"), F.size(spans).alias("m")).collect():
            assert r["n"] == r["m"], (text, r["body"])


WORDS = st.lists(st.sampled_from(["red", "rouge", "Éte", "blue", "b-c", "x_1", "the"]), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=1, max_size=6), st.sampled_from(["red", "red OR blue", "red -blue", '"red the"', "ete", "rouge the"]))
def test_plan_equals_brute_force(spark, texts, asked):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    parsed = q.parse(asked)
    compiled = compile_query(parsed, Source.of(F.col("t")))
    got = {r["i"] for r in spark.createDataFrame(rows, "i int, t string").where(compiled.predicate).collect()}

    def holds(clause, text):
        tokens, wanted = re.findall(r"\w+", fold_text(text)), re.findall(r"\w+", fold_text(clause.text))
        return any(tokens[k : k + len(wanted)] == wanted for k in range(len(tokens)))

    want = {i for i, t in rows if all(any(holds(c, t) for c in g) for g in parsed.must) and not any(holds(c, t) for c in parsed.must_not)}
    assert got == want


def test_look_around_is_refused(docs):
    with pytest.raises(InvalidQuery):
        search.matching(docs, SearchRequest("/a(?=b)/"))


def test_ranking_hits_and_snippets(docs):
    rows = search.hits(docs, SearchRequest("contract OR payment", fuzzy=True)).collect()
    assert [r["path"] for r in rows][0] == "a.txt" and rows[0]["exact"] == 3
    assert rows[0]["snippets"][0]["text"] == "The ⟦contract⟧ is signed."
    assert all(r["score"] > 0 for r in rows)


def test_facets_leave_their_own_filter_out(docs):
    got = {(r["facet"], r["key"]): r["n"] for r in search.facets(docs, SearchRequest("NOT zzz", sites=["s1"])).collect()}
    assert got[("site", "s1")] == 3 and got[("site", "s2")] == 3 and got[("kind", "text")] == 3


def test_name_patterns(spark):
    names = spark.createDataFrame([(["Contrat.PDF"],), (["facture-2024-03.xlsx"],), (["Mon Résumé 2024.docx"],), (["x.txt", "a.zip"],)], "n array<string>")
    match = lambda text: [r["n"][0] for r in names.where(filters.NamePattern.parse(text).matches(F.col("n"))).collect()]
    assert match("*.pdf; facture-2024-??.xlsx") == ["Contrat.PDF", "facture-2024-03.xlsx"]
    assert match("resume") == ["Mon Résumé 2024.docx"] and match("!*.zip, !*.pdf") == ["facture-2024-03.xlsx", "Mon Résumé 2024.docx"]
    assert match("/^x.*t$/") == ["x.txt"] and filters.NamePattern.parse(" ; ") is None


def test_filter_values():
    assert filters.parse_date("1970-01-02") == 86400 and filters.until_date("1970-01-01") == 86400
    assert filters.parse_size("1.5 KB") == 1536 and filters.folder_scope("/a", ["/a/b", "/c"]) == ("prefixes", ["/a/b"])
    assert filters.folder_scope("/a/b", ["/a"]) == ("whole", []) and filters.folder_scope("/x", ["/a"]) == ("outside", [])
    with pytest.raises(ValueError):
        filters.parse_size("many")


def test_folders_and_dictionary(spark, docs):
    df = spark.createDataFrame([("a/b/c.txt",), ("a/d.txt",)], "path string")
    assert sorted(r[0] for r in search.all_folders(df).collect()) == ["a", "a/b"]
    assert [r[0] for r in search.folder_search(df, "b").collect()] == ["a/b"]
    assert {r["raw"] for r in dictionary.inflected_forms(docs, "contract", "en").collect()} == {"contract", "contracts"}
    assert {r["token"] for r in dictionary.similar(docs, "payment", 1).collect()} == {"payment", "paiement", "payement"} - {"paiement"}


def test_preview_of_long_texts():
    text = "\n".join(["— Sheet —"] + [f"line {i}" for i in range(1000)])
    at = text.index("line 600")
    lines, cut = matching.preview(text, [(at, at + 8, False)], sections=True)
    assert cut and [n for n, _ in lines] == [1, 2, 3, 4, 5, 600, 601, 602, 603, 604] and lines[7][1] == "⟦line 600⟧"


def test_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(120))
    rows = [("s", p, "", None, p, [p], "text", "en", len(b), 0, 0, b) for p, b in {"a": base, "b": base, "c": base.replace("word60", "other"), "d": "short", "e": " ".join(f"z{i}" for i in range(120)), "g": ""}.items()]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    exact = dupes.report_order(dupes.exact_duplicates(docs)).collect()
    assert [r["paths"] for r in exact] == [["a", "b"]] and exact[0]["wasted"] == len(base)
    groups = dupes.similar_groups(dupes.similar_pairs(dupes.signatures(docs), 0.7)).collect()
    assert [r["paths"] for r in groups] == [["a", "b", "c"]]
    assert paths(dupes.copies_of(docs, "a")) == ["a", "b"]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21)], "a long, b long")
    got = {r["node"]: r["root"] for r in dupes.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, 20: 20, 21: 20}


def test_meaning(spark):
    words = " ".join(["w"] * 130) + ". " + " ".join(["v"] * 20)
    cut = meaning.split_passages("n", words)
    assert len(cut) == 2 and cut[0][2].startswith("n\n") and cut[1][2] == " ".join(["v"] * 20)
    assert meaning.split_passages("n", " ") == [(0, 0, "n")] and len(meaning.split_passages("", "w " * 5000)) == 12
    assert meaning.clean_question('what OR "is" -not /x.y/ NEAR:5 it') == "what is it"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    near = meaning.nearest(df, [1.0, 0.0], 2)
    assert [(r["vec_id"], round(r["score"], 3)) for r in near.collect()] == [(1, 1.0), (2, 0.6)]
    assert [r["vec_id"] for r in meaning.relative_cut(near).collect()] == [1]
    fused = meaning.fuse(near.select(F.col("vec_id").alias("k"), "score"), near.select(F.col("vec_id").alias("k"), "score"), "k").collect()
    assert {r["k"]: round(r["score"], 6) for r in fused} == {1: round(2 / 61, 6), 2: round(2 / 62, 6)}
    q8 = df.select(meaning.quantize(F.col("embedding")).alias("q")).collect()
    assert q8[1]["q"]["vec"] == [95, 127]


def test_passages_of_whole_texts(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([("s", "a", "", None, "a", ["a"], "text", "en", len(text), 0, 0, text)], DOCUMENTS)
    whole = meaning.passages(docs).orderBy("passage").collect()
    assert " ".join(r["text"].partition("\n")[2] or r["text"] for r in whole).split() == text.split()
    assert meaning.passages(docs, most=meaning.MOST_PASSAGES).count() == 12


def test_similar_pairs_are_exact_and_all(spark):
    """More than 200 near copies in one bucket, short texts, and a text that differs behind 200,000 characters."""
    base = [f"word{i}" for i in range(60)]
    bodies = {f"m{i:03d}": " ".join([*base[:30], f"own{i}", *base[30:]]) for i in range(210)}
    long = " ".join(f"x{i}" for i in range(40000))
    bodies |= {"s": "one two three four five six", "t": "One two three  four five six", "l": long, "l2": " ".join(long.split()[:30000] + [f"y{i}" for i in range(10000)])}
    docs = spark.createDataFrame([("s", p, "", None, p, [p], "text", "en", len(b), 0, 0, b) for p, b in bodies.items()], DOCUMENTS)

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {p: shingles(b) for p, b in bodies.items()}
    for threshold in (0.8, 0.5):
        want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a in sets for b in sets if a < b}
        got = [(r["a"], r["b"], round(r["similarity"], 9)) for r in dupes.similar_pairs(dupes.signatures(docs), threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if w[2] >= threshold}
    groups = dupes.similar_groups(dupes.similar_pairs(dupes.signatures(docs))).collect()
    assert sorted(len(r["paths"]) for r in groups) == [2, 210]
