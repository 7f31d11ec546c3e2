"""From a parsed query to column expressions.

Every clause becomes a predicate and a count of its occurrences over a document's text and, for words
and phrases, its name.  Patterns run on folded text in the JVM behind a plain ``contains``, which is
cheap and lets most rows go before a pattern is tried.  Regular expressions with look-around or back
references are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import MAX_TOKEN_BYTES, fold, fuzzy_distance, quoted, searched_tokens, split_words, with_lam, word_pattern
from . import query as q

#: Boosts of where and how a word is found.
NAME_BOOST, STEM_BOOST, CONTAINS_BOOST, FUZZY_BOOST = 2.0, 0.7, 0.6, 0.5
#: The score of a document without one exact occurrence is multiplied by this.
APPROXIMATE_ONLY = 0.2


@dataclass(frozen=True)
class Options:
    fuzzy: bool = False
    case_sensitive: bool = False
    whole_word: bool = True


@dataclass(frozen=True)
class Source:
    """The columns that clauses read: texts as they are, and folded."""

    body: Column
    folded: Column
    name: Column | None = None
    folded_name: Column | None = None
    lines: tuple[int, int | None] | None = None

    @classmethod
    def of(cls, body: Column, name: Column | None = None, lines: tuple[int, int | None] | None = None) -> Source:
        shown = cut_lines(body, lines) if lines else body
        return cls(shown, fold(shown), name, None if name is None else fold(name), lines)


class InvalidQuery(ValueError):
    pass


def cut_lines(text: Column, lines: tuple[int, int | None]) -> Column:
    """The lines first..last of a text; matches never cross them."""
    first, last = lines
    return F.array_join(F.slice(F.split(text, "\n", -1), first, 2**31 - 1 - first if last is None else last - first + 1), "\n")


def checked_pattern(pattern: str) -> str:
    """A pattern that Java and a linear-time engine read alike, with Unicode classes."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k", pattern):
        raise InvalidQuery("look-around and back references are not supported")
    try:
        re.compile(pattern)
    except re.error as error:
        raise InvalidQuery(str(error)) from error
    return pattern


def _count(text: Column, words: list[str], whole: bool) -> Column:
    """Occurrences of consecutive folded tokens, tried only where every token is contained."""
    near = reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words])
    return F.when(near, F.regexp_count(text, F.lit(word_pattern(words, whole)))).otherwise(F.lit(0))


def _fuzzy_count(folded: Column, word: str, distance: int) -> Column:
    """Tokens within an edit distance that are not the word itself."""
    n = len(word)
    near = F.filter(
        searched_tokens(folded),
        lambda t: (t != word) & (F.length(t) >= n - distance) & (F.length(t) <= n + distance) & (F.levenshtein(t, F.lit(word), distance) >= 0),
    )
    return F.size(near)


@dataclass(frozen=True)
class Found:
    """Occurrences of a clause, exact and approximate."""

    exact: Column
    fuzzy: Column | None = None

    @property
    def total(self) -> Column:
        return self.exact if self.fuzzy is None else self.exact + self.fuzzy


def count_in(clause: q.Clause, text: Column, folded: Column, options: Options) -> Found | None:
    """Occurrences in one text; None for a clause that has no token and is ignored."""
    if isinstance(clause, q.Regex):
        flags = "(?U)" if options.case_sensitive else "(?iU)"
        return Found(F.regexp_count(text, F.lit(flags + checked_pattern(clause.pattern))))
    if isinstance(clause, q.Detect):
        from ..functions.detectors import count_detections

        return Found(F.aggregate(F.map_values(count_detections(text, clause.kinds)), F.lit(0).cast("long"), lambda a, b: a + b).cast("int"))
    if isinstance(clause, q.Near):
        return Found(F.when(near_predicate(clause, text, folded, options), F.lit(1)).otherwise(F.lit(0)))
    words = split_words(clause.text)
    if not words or any(len(w.encode()) >= MAX_TOKEN_BYTES for w in words):
        return None if not words else Found(F.lit(0))
    if options.case_sensitive:
        raw = clause.text.strip()
        pattern = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]){quoted(raw)}(?![\p{{L}}\p{{M}}\p{{N}}_])" if options.whole_word or len(words) > 1 else quoted(raw)
        return Found(F.when(F.contains(text, F.lit(raw)), F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0)))
    exact = _count(folded, words, options.whole_word or len(words) > 1)
    if len(words) > 1 or isinstance(clause, q.Phrase):
        return Found(exact)
    lam = with_lam(words[0])
    if lam:
        exact = exact + _count(folded, [lam], options.whole_word)
    like = isinstance(clause, q.Like)
    distance = max(fuzzy_distance(words[0]) if options.fuzzy and not isinstance(clause, q.Exact) or like else 0, int(like))
    return Found(exact, _fuzzy_count(folded, words[0], distance) if distance else None)


def near_predicate(near: q.Near, text: Column, folded: Column, options: Options) -> Column:
    """Some occurrence of the first term has every other term within so many characters.

    Two terms are one pattern with both orders, inside the JVM; longer chains are judged by the matcher
    on rows that contain every word.
    """
    words = [split_words(t.text) for t in near.terms]
    if not all(words):
        return F.lit(False)
    cheap = reduce(lambda a, b: a & b, [F.contains(folded, F.lit(w)) for ws in words for w in ws])
    if len(words) == 2 and not options.fuzzy and not any(isinstance(t, q.Like) for t in near.terms):
        first, second = (word_pattern(w) for w in words)
        between = rf"(?s:.{{0,{near.chars}}}?)"
        return cheap & F.rlike(folded, F.lit(rf"(?:{first}{between}{second})|(?:{second}{between}{first})"))
    from ..operators.matching import count_matches

    loose = options.fuzzy or any(isinstance(t, q.Like) for t in near.terms)
    return (F.lit(True) if loose else cheap) & (count_matches(text, q.Query(must=[[near]]), options) > 0)


def count_clause(clause: q.Clause, source: Source, options: Options) -> Found | None:
    """Occurrences in the body; a name that matches counts as well, outside LINES."""
    found = count_in(clause, source.body, source.folded, options)
    if found is None or source.name is None or source.lines or isinstance(clause, (q.Regex, q.Detect)):
        return found
    named = count_in(clause, source.name, source.folded_name, options)
    both = None if found.fuzzy is None else found.fuzzy + named.fuzzy
    return Found(found.exact + named.exact, both)


@dataclass(frozen=True)
class Compiled:
    predicate: Column
    exact: Column
    matches: Column


def compile_query(query: q.Query, source: Source, options: Options = Options()) -> Compiled:
    """The predicate of a query and its numbers of exact and all occurrences.

    A document matches if each group has an alternative that occurs and no excluded clause occurs.
    Excluded clauses tolerate no typos.  Clauses without a token are ignored; an empty query matches
    nothing; one with exclusions only matches all other documents.
    """
    groups, counts = [], []
    for group in query.must:
        found = [f for c in group if (f := count_clause(c, source, options)) is not None]
        if found:
            groups.append(reduce(lambda a, b: a | b, [f.total > 0 for f in found]))
            counts += found
    strict = Options(False, options.case_sensitive, options.whole_word)
    without = [f.exact > 0 for c in query.must_not if (f := count_clause(c, source, strict)) is not None]
    if not groups and not without:
        return Compiled(F.lit(False), F.lit(0), F.lit(0))
    predicate = reduce(lambda a, b: a & b, groups + [~w for w in without])
    total = lambda xs: reduce(lambda a, b: a + b, xs) if xs else F.lit(0)
    return Compiled(predicate, total([f.exact for f in counts]), total([f.total for f in counts]))
