"""Text functions as JVM-side column expressions: folding, tokens, word and phrase patterns."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic letters that users type interchangeably, and the tatweel.
ARABIC_LETTERS = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي"}
TATWEEL = "ـ"
ARABIC_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
#: Longer tokens (in bytes) are noise and never searched.
MAX_TOKEN_BYTES = 64

WORD = r"\p{L}\p{N}_"
TOKEN = rf"([{WORD}]+)"


def fold_text(text: str) -> str:
    """Lower case without diacritics, with unified Arabic letters; the plain-Python form."""
    kept = [c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) and unicodedata.category(c)[0] != "M" and c != TATWEEL]
    return unicodedata.normalize("NFC", "".join(ARABIC_LETTERS.get(c, c) for c in "".join(kept).lower()))


@cache
def _fold_table() -> tuple[str, str]:
    """(from, to) for ``translate`` on lower-cased text, by rule over all characters."""
    pairs, drop = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        folded = fold_text(c)
        if not folded:
            drop.append(c)
        elif folded != c.lower() and len(folded) == 1:
            pairs.append((c, folded))
    return "".join(a for a, _ in pairs) + "".join(drop), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Folded text; null stays null."""
    source, target = _fold_table()
    return F.translate(F.lower(text), source, target)


def stem_input(text: Column) -> Column:
    """Lower case, Arabic marks and tatweel removed, Latin accents kept."""
    return F.regexp_replace(F.lower(text), f"{ARABIC_MARKS}|{TATWEEL}", "")


def tokens(folded: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(folded, F.lit(TOKEN), 1)


def searched_tokens(folded: Column) -> Column:
    """Tokens without those of 64 bytes or more."""
    return F.filter(tokens(folded), lambda t: F.octet_length(t) < MAX_TOKEN_BYTES)


def split_words(text: str) -> list[str]:
    """The folded tokens of a query word."""
    return re.findall(r"\w+", fold_text(text))


def quoted(word: str) -> str:
    """A literal for Java and RE2 patterns."""
    return re.sub(r"([^\w\s])", r"\\\1", word)


def word_pattern(words: list[str], whole: bool = True) -> str:
    """A pattern of consecutive tokens; without ``whole``, a token may go on at either end."""
    gap = rf"[^{WORD}]+"
    body = gap.join(quoted(w) for w in words)
    return rf"(?<![{WORD}]){body}(?![{WORD}])" if whole else rf"[{WORD}]*{body}[{WORD}]*"


def fuzzy_distance(word: str) -> int:
    """Typos tolerated in a word of this length."""
    return 0 if len(word) <= 5 else 1 if len(word) <= 9 else 2


def with_lam(word: str) -> str | None:
    """The form "for + word" of an Arabic word."""
    return "ل" + word if len(word) >= 2 and all("ء" <= c <= "ي" for c in word) else None


#: Articles and attached prefixes left out of an Arabic word's length.
ARABIC_PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال")


def core_length(folded: str) -> int:
    for prefix in ARABIC_PREFIXES:
        if folded.startswith(prefix) and len(folded) - len(prefix) >= 2:
            return len(folded) - len(prefix)
    return len(folded)


def mask_sensitive(value: Column) -> Column:
    """Letters and digits become bullets except the last four."""
    return F.regexp_replace(value, r"[\p{L}\p{N}](?=(?:[^\p{L}\p{N}]*[\p{L}\p{N}]){4})", "•")


def strip_markers(text: Column) -> Column:
    return F.translate(text, "⟦⟧⟪⟫", "")


def file_of(path: Column) -> Column:
    """The file of a path such as ``a.zip › b/c.txt``: what stands before the first separator."""
    return F.substring_index(path, " › ", 1)


def inner_of(path: Column) -> Column:
    """What stands behind the first separator, or null."""
    return F.when(F.contains(path, F.lit(" › ")), F.substring(path, F.length(file_of(path)) + 4, F.length(path)))


def safe_name(name: Column) -> Column:
    """A file name without forbidden characters; never empty."""
    cleaned = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.when(F.trim(cleaned) == "", F.lit("document")).otherwise(cleaned)


def passage_count(words: Column) -> Column:
    """Estimated passages of a text of so many words."""
    return F.least(F.greatest(F.ceil(words / 120), F.lit(1)), F.lit(12)).cast("int")
