import pytest
from pyspark.sql import functions as F

from textloom.functions import detectors as D
from textloom.functions import text as X
from textloom.functions.stem import detect_language, stem

SAMPLES = ["Résumé", "CANCIÓN", "Ñandú", "العَقْدُ", "إيجار", "مدرسة", "عـــقد", "ﬁn Å Ｗ", "", "ẞ straße", "e\u0301te\u0301"]


def test_fold_agrees_with_the_column_form(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select("s", X.fold(F.col("s")).alias("f")).collect()
    assert [r["f"] for r in rows] == [X.fold_text(r["s"]) for r in rows]
    assert X.fold_text("Résumé") == "resume" and X.fold_text("مدرسة") == "مدرسه"


def test_path_and_name_columns(spark):
    row = spark.createDataFrame([("a.zip › b/c.txt", 'x<y>: "z".  ', "FR76 1234 5678")], "p string, n string, v string").select(
        X.file_of(F.col("p")), X.inner_of(F.col("p")), X.safe_name(F.col("n")), X.mask_sensitive(F.col("v")), X.passage_count(F.lit(130)), X.passage_count(F.lit(0))
    ).first()
    assert tuple(row) == ("a.zip", "b/c.txt", "x_y__ _z_", "•••• •••• 5678", 2, 1)


def test_word_rules():
    assert [X.fuzzy_distance("a" * n) for n in (5, 6, 9, 10)] == [0, 1, 1, 2]
    assert X.with_lam("تصميم") == "لتصميم" and X.with_lam("abc") is None
    assert X.core_length("العقد") == 3 and X.core_length("word") == 4


@pytest.mark.parametrize(
    "words, lang, expected",
    [
        ("agreements running flies happily national generously relational hopping", "en", "agreement run fli happili nation generous relat hop"),
        ("contrats continuellement majestueusement nationales finissons chevaux", "fr", "contrat continuel majestu national fin cheval"),
        ("contratos chicas torneo habitaciones comiendo", "es", "contrat chic torne habit com"),
        ("العقود", "ar", "عقد"),
    ],
)
def test_published_stems(words, lang, expected):
    assert [stem(w, lang) for w in words.split()] == expected.split()
    assert stem("wort", "de") is None


def test_language():
    assert detect_language("Le présent contrat de prestation prend effet à la date de signature par les deux parties.") == "fr"
    assert detect_language("This service agreement takes effect on the date it is signed by both parties.") == "en"
    assert detect_language("El presente contrato de prestación de servicios se regirá por la legislación española.") == "es"
    assert detect_language("يبدأ سريان هذا العقد") == "ar" and detect_language("") == "und" and detect_language(None) == "und"


VALID = {
    "iban": "FR1420041010050500013M02606", "bic": "BNPAFRPP001", "rib": "20041 01005 0500013M026 06", "card": "4111 1111 1111 1111", "email": "a.b+c@mail.example.org", "phone": "+33 6 12 34 56 78",
    "ip": "10.0.255.1", "amount": "1 234,50 €", "vat": "FR40303265045", "dni": "12345678Z", "mrz": "L898902C36UTO7408122F1204159ZE184226B<<<<<10",
}
INVALID = {
    "iban": "FR1420041010050500013M02607", "bic": "ABCDEFGH", "rib": "20041 01005 0500013M026 07", "card": "4111 1111 1111 1112", "email": "a@b", "phone": "00 11", "ip": "10.0.256.1",
    "vat": "FR41303265045", "dni": "12345678A", "mrz": "L898902C37UTO7408122F1204159ZE184226B<<<<<10",
}


@pytest.mark.parametrize("kind", list(VALID))
def test_valid_and_invalid_data(kind):
    assert [k for k, _, _ in D.find_detections(f"x {VALID[kind]} y", [kind])] == [kind]
    if kind in INVALID:
        assert D.find_detections(f"x {INVALID[kind]} y", [kind]) == []


def test_context_words_and_keys():
    assert D.find_detections("SIRET : 732 829 320 00074", ["siren"]) == [("siren", 8, 25)]
    assert D.find_detections("732 829 320 00074", ["siren"]) == []
    body = "2 55 08 14 168 025".replace(" ", "")
    key = 97 - int(body) % 97
    assert D.nir_ok(f"{body}{key:02d}")
    corsica = "255082A168025"
    assert D.nir_ok(f"{corsica}{97 - int(corsica.replace('2A', '19')) % 97:02d}")


def test_detection_columns(spark):
    texts = [(1, "mail a@b.org and 10.0.0.1"), (2, "nothing"), (3, None), (4, "4111 1111 1111 1111 twice 4111 1111 1111 1111")]
    df = spark.createDataFrame(texts, "id int, t string")
    rows = {r["id"]: r for r in df.select("id", D.count_detections(F.col("t")).alias("n"), D.sensitive_values(F.col("t")).alias("s"), F.size(D.emails(F.col("t"))).alias("e"), D.cards(F.col("t")).alias("c")).collect()}
    assert rows[1]["n"] == {"email": 1, "ip": 1} and rows[2]["n"] == {} and rows[3]["n"] == {}
    assert rows[4]["n"]["card"] == 2 and rows[4]["s"] == ["4111 1111 1111 1111"] and rows[4]["c"] == ["4111111111111111"] * 2


def test_all_sensitive_values(spark):
    numbers = [f"{n}{'TRWAGMYFPDXBNJZSQVHLCKE'[n % 23]}" for n in range(10_000_000, 10_000_150)]
    df = spark.createDataFrame([("; ".join(numbers),)], "t string")
    assert df.select(D.sensitive_values(F.col("t"), ("dni",)).alias("s")).first()["s"] == numbers


def test_language_of_a_whole_text(spark):
    from textloom.functions.langid import language

    text = "this is the service agreement that takes effect on the date " * 350 + "le contrat de prestation prend effet dans les conditions pour la date " * 2000
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r["l"] for r in df.select(language(F.col("t")).alias("l")).collect()] == ["fr", "und"]
