"""Word stems by the published Snowball algorithms, and language guesses by frequent words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .text import ARABIC_MARKS, TATWEEL

VOWELS = {"en": "aeiouy", "fr": "aeiouyâàëéêèïîôûù", "es": "aeiouáéíóúü"}


def _after_vowel_consonant(word: str, vowels: str, start: int = 0) -> int:
    """The place behind the first non-vowel that follows a vowel, or the word's end."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s)), None)


# --- English (Porter2) ---------------------------------------------------------------------------

#: Fixed values of the published algorithm.
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_EN_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_EN_STOP_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _en_short(word: str, r1: int) -> bool:
    v = VOWELS["en"]
    return r1 >= len(word) and bool(re.search(rf"(?:[^{v}][{v}][^{v}wxY]|^[{v}][^{v}])$", word))


def stem_en(word: str) -> str:
    word = word.replace("’", "'")
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    if word in _EN_SAME:
        return word
    v = VOWELS["en"]
    word = re.sub(rf"(^|[{v}])y", r"\1Y", word)
    head = re.match("gener|commun|arsen", word)
    r1 = head.end() if head else _after_vowel_consonant(word, v)
    r2 = _after_vowel_consonant(word, v, r1)
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{v}]", word[:-2]):
        word = word[:-1]
    if word in _EN_STOP_1A:
        return word
    tail = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if tail in ("eed", "eedly"):
        if len(word) - len(tail) >= r1:
            word = word[: -len(tail)] + "ee"
    elif tail and re.search(f"[{v}]", word[: -len(tail)]):
        word = word[: -len(tail)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif _en_short(word, r1):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in v:
        word = word[:-1] + "i"
    tail = _longest(word, _EN_2)
    if tail and len(word) - len(tail) >= r1:
        base = word[: -len(tail)]
        if tail == "li":
            word = base if base[-1:] in "cdeghkmnrt" and base else word
        elif tail != "ogi" or base.endswith("l"):
            word = base + _EN_2[tail]
    tail = _longest(word, _EN_3)
    if tail and len(word) - len(tail) >= r1 and (tail != "ative" or len(word) - len(tail) >= r2):
        word = word[: -len(tail)] + _EN_3[tail]
    tail = _longest(word, _EN_4)
    if tail and len(word) - len(tail) >= r2 and (tail != "ion" or word[: -len(tail)].endswith(("s", "t"))):
        word = word[: -len(tail)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not re.search(rf"(?:[^{v}][{v}][^{v}wxY]|^[{v}][^{v}])$", word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# --- Spanish -------------------------------------------------------------------------------------


def _rv(word: str, v: str) -> int:
    """The region behind the first part of a Spanish word."""
    if len(word) < 3:
        return len(word)
    if word[1] not in v:
        m = re.compile(f"[{v}]").search(word, 2)
    elif word[0] in v:
        m = re.compile(f"[^{v}]").search(word, 2)
    else:
        return 3
    return m.end() if m else len(word)


_ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
#: Fixed values: (suffixes, replacement) of the algorithm's first step; each must lie in R2, amente in R1.
_ES_1 = (
    (("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"), ""),
    (("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"), ""),
    (("logía", "logías"), "log"), (("ución", "uciones"), "u"), (("encia", "encias"), "ente"), (("amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"), ""),
)
_ES_2A = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_ES_2B = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def stem_es(word: str) -> str:
    v = VOWELS["es"]
    rv, r1 = _rv(word, v), _after_vowel_consonant(word, v)
    r2 = _after_vowel_consonant(word, v, r1)
    plain = lambda w: w.translate(str.maketrans("áéíóú", "aeiou"))
    tail = _longest(word, _ES_PRONOUNS)
    if tail and len(word) - len(tail) >= rv:
        base = word[: -len(tail)]
        verb = _longest(base, ("iéndo", "ándo", "ár", "ér", "ír", "iendo", "ando", "ar", "er", "ir"))
        if verb and len(base) - len(verb) >= rv:
            word = base[: -len(verb)] + plain(verb)
        elif base.endswith("uyendo") and len(base) - 5 >= rv:
            word = base
    before, found = word, [(s, new) for suffixes, new in _ES_1 for s in suffixes if word.endswith(s)]
    if found:
        tail, new = max(found, key=lambda x: len(x[0]))
        cut = len(word) - len(tail)
        if cut >= (r1 if tail == "amente" else r2):
            word = word[:cut] + new
            follow = {"amente": ("iv", "os", "ic", "ad"), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(tail, ())
            if tail in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
                follow = ("ic",)
            elif tail in ("iva", "ivo", "ivas", "ivos"):
                follow = ("at",)
            more = _longest(word, follow) if follow else None
            if more and len(word) - len(more) >= r2:
                word = word[: -len(more)]
                if tail == "amente" and more == "iv" and word.endswith("at") and len(word) - 2 >= r2:
                    word = word[:-2]
    if word == before:
        tail = _longest(word[rv:], _ES_2A)
        if tail and word[: -len(tail)].endswith("u"):
            word = word[: -len(tail)]
        else:
            tail = _longest(word[rv:], (*_ES_2B, "en", "es", "éis", "emos"))
            if tail:
                word = word[: -len(tail)]
                if tail in ("en", "es", "éis", "emos") and word.endswith("gu"):
                    word = word[:-1]
    tail = _longest(word[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if tail:
        word = word[: -len(tail)]
        if tail in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return plain(word)


# --- French --------------------------------------------------------------------------------------

#: Fixed values of the published algorithm.
_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def stem_fr(word: str) -> str:
    v = VOWELS["fr"]
    word = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
    word = re.sub(rf"(?<=[{v}])y|y(?=[{v}])", "Y", word)
    word = re.sub("(?<=q)u", "U", word)
    if re.match(f"[{v}]{{2}}|par|col|tap", word):
        rv = 3
    else:
        m = re.compile(f"[{v}]").search(word, 1)
        rv = m.end() if m else len(word)
    r1 = _after_vowel_consonant(word, v)
    r2 = _after_vowel_consonant(word, v, r1)
    start = word
    at = lambda tail: len(word) - len(tail)
    verbs = True

    def drop(tail: str, new: str = "") -> None:
        nonlocal word
        word = word[: len(word) - len(tail)] + new

    groups = {
        "plain": "ance iqUe isme able iste eux ances iqUes ismes ables istes".split(), "at": "atrice ateur ation atrices ateurs ations".split(), "log": ["logie", "logies"],
        "u": "usion ution usions utions".split(), "ent": ["ence", "ences"], "ement": ["ement", "ements"], "ite": ["ité", "ités"], "if": "if ive ifs ives".split(), "eaux": ["eaux"], "aux": ["aux"],
        "euse": ["euse", "euses"], "iss": ["issement", "issements"], "amment": ["amment"], "emment": ["emment"], "ment": ["ment", "ments"],
    }
    kind_of = {s: k for k, ss in groups.items() for s in ss}
    tail = _longest(word, kind_of)
    if tail:
        kind, cut = kind_of[tail], at(tail)
        if kind in ("plain", "log", "u", "ent") and cut >= r2:
            drop(tail, {"plain": "", "log": "log", "u": "u", "ent": "ent"}[kind])
        elif kind == "at" and cut >= r2:
            drop(tail)
            if word.endswith("ic"):
                drop("ic", "" if at("ic") >= r2 else "iqU")
        elif kind == "ement" and cut >= rv:
            drop(tail)
            if word.endswith("iv") and at("iv") >= r2:
                drop("iv")
                if word.endswith("at") and at("at") >= r2:
                    drop("at")
            elif word.endswith("eus"):
                drop("eus", "" if at("eus") >= r2 else "eux" if at("eus") >= r1 else "eus")
            elif word.endswith(("abl", "iqU")) and at("abl") >= r2:
                drop("abl")
            elif word.endswith(("ièr", "Ièr")) and at("ièr") >= rv:
                drop("ièr", "i")
        elif kind == "ite" and cut >= r2:
            drop(tail)
            if word.endswith("abil"):
                drop("abil", "" if at("abil") >= r2 else "abl")
            elif word.endswith("ic"):
                drop("ic", "" if at("ic") >= r2 else "iqU")
            elif word.endswith("iv") and at("iv") >= r2:
                drop("iv")
        elif kind == "if" and cut >= r2:
            drop(tail)
            if word.endswith("at") and at("at") >= r2:
                drop("at")
                if word.endswith("ic"):
                    drop("ic", "" if at("ic") >= r2 else "iqU")
        elif kind == "eaux":
            drop(tail, "eau")
        elif kind == "aux" and cut >= r1:
            drop(tail, "al")
        elif kind == "euse" and cut >= r1:
            drop(tail, "" if cut >= r2 else "eux")
        elif kind == "iss" and cut >= r1 and cut and word[cut - 1] not in v:
            drop(tail)
        elif kind in ("amment", "emment") and cut >= rv:
            drop(tail, kind[0] + "nt")
        elif kind == "ment" and cut - 1 >= rv and word[cut - 1] in v:
            drop(tail)
        verbs = word == start or kind in ("amment", "emment", "ment")
    changed = word != start
    if verbs:
        before = word
        tail = _longest(word[rv:], _FR_I)
        if tail and at(tail) > rv and word[at(tail) - 1] not in v:
            drop(tail)
        else:
            tail = _longest(word[rv:], (*_FR_E, *_FR_A, "ions"))
            if tail == "ions":
                if at(tail) >= r2:
                    drop(tail)
            elif tail in _FR_E:
                drop(tail)
            elif tail:
                drop(tail)
                if word.endswith("e") and len(word) - 1 >= rv:
                    drop("e")
        changed = changed or word != before
    if changed:
        if word.endswith("Y"):
            drop("Y", "i")
        elif word.endswith("ç"):
            drop("ç", "c")
    else:
        if re.search("[^aiouès]s$", word):
            drop("s")
        if word.endswith("ion") and at("ion") >= max(r2, rv) and word[at("ion") - 1 :][:1] in ("s", "t"):
            drop("ion")
        else:
            tail = _longest(word[rv:], ("ier", "ière", "Ier", "Ière", "e"))
            if tail:
                drop(tail, "" if tail == "e" else "i")
    if re.search("(enn|onn|ett|ell|eill)$", word):
        word = word[:-1]
    word = re.sub(rf"[éè]([^{v}]+)$", r"e\1", word)
    return word.lower()


# --- Arabic (light) ------------------------------------------------------------------------------


def stem_ar(word: str) -> str:
    """Marks, articles with attached particles, and common endings removed."""
    word = re.sub(f"{ARABIC_MARKS}|{TATWEEL}", "", word)
    word = re.sub("[أإآٱ]", "ا", word)
    for prefix in ("وال", "بال", "كال", "فال", "لل", "ال"):
        if word.startswith(prefix) and len(word) - len(prefix) >= 3:
            word = word[len(prefix) :]
            break
    for suffix in ("هما", "كما", "تان", "تين", "ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            word = word[: -len(suffix)]
            break
    return re.sub("(?<=..)و(?=.$)", "", word)


_STEMMERS = {"en": stem_en, "fr": stem_fr, "es": stem_es, "ar": stem_ar}


@lru_cache(maxsize=200_000)
def stem(word: str, lang: str) -> str | None:
    """The stem of a word in a language, or None for languages without a stemmer."""
    rule = _STEMMERS.get(lang)
    return rule(unicodedata.normalize("NFC", word).lower()) if rule else None


#: Frequent words by which a language is guessed.
FREQUENT = {
    "en": "the of and to in is that it was for on are with as be this have from by not at or an but they which you we his her".split(),
    "fr": "le la les de des du et un une est que qui dans pour par sur au aux pas avec ce cette sont ne se plus ou nous vous il elle".split(),
    "es": "el la los las de del y en que un una es por con para se no su al lo como más pero sus le ya o este sí porque esta".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
}
_SETS = {k: frozenset(v) for k, v in FREQUENT.items()}


def detect_language(text: str | None, most: int | None = 20_000) -> str:
    """en, fr, es, ar or und, from the first ``most`` characters, or the whole text for None.

    Arabic by its letters, others by the share of their frequent words; a short text needs a clear lead.
    """
    sample = (text or "")[:most].lower()
    letters = sum(c.isalpha() for c in sample)
    if letters and sum("؀" <= c <= "ۿ" for c in sample) > letters / 2:
        return "ar"
    words = re.findall(r"\w+", sample)
    if not words:
        return "und"
    score = sorted(((sum(w in s for w in words) / len(words), k) for k, s in _SETS.items()), reverse=True)
    (best, lang), (second, _) = score[:2]
    sure = best - second > 0.2 * best or len(sample.encode()) > 400
    return lang if best > 0 and sure and lang in _STEMMERS else "und"
