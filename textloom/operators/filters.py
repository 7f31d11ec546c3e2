"""Filters of a search request as predicates that reach the scan."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, quoted

DAY = 86_400
#: Presets of dates in days, attribute bits, size units.
PRESETS = {"day": 1, "week": 7, "month": 30, "year": 365}
ATTRIBUTES = {"readOnly": 1, "hidden": 2, "system": 4}
UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30}


def one_of(column: str, values: list[str]) -> Column:
    """Membership; no values mean all."""
    return F.col(column).isin(values) if values else F.lit(True)


def in_range(column: str, least: int | None = None, below: int | None = None) -> Column:
    """least <= column < below."""
    out = F.lit(True)
    if least is not None:
        out = out & (F.col(column) >= least)
    return out if below is None else out & (F.col(column) < below)


def preset_range(name: str, now: int) -> tuple[int, int | None]:
    return now - PRESETS[name] * DAY, None


def parse_date(text: str) -> int:
    """Unix seconds of ``YYYY-MM-DD`` in UTC."""
    return int(dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=dt.UTC).timestamp())


def until_date(text: str) -> int:
    """The bound of a range that includes this day."""
    return parse_date(text) + DAY


def parse_size(text: str) -> int:
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not found or found[2].upper() not in UNITS:
        raise ValueError(f"not a size: {text}")
    return int(float(found[1]) * UNITS[found[2].upper()])


def has_attributes(column: str, names: list[str]) -> Column:
    """All of the requested attribute bits are set."""
    mask = sum(ATTRIBUTES[n] for n in set(names))
    return F.col(column).bitwiseAND(F.lit(mask)) == mask


def digest_matches(content: Column, digest: str) -> Column:
    """Whole content with this MD5 (32 hex digits) or SHA-256 (64)."""
    digest = digest.strip().lower()
    if not re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{64}", digest):
        raise ValueError("a digest has 32 or 64 hex digits")
    return (F.md5(content) if len(digest) == 32 else F.sha2(content, 256)) == digest


def _normal(path: str) -> str:
    return path.replace("\\", "/").rstrip("/").lower()


def in_folder(path: str, folder: str) -> Column:
    """Containment of whole segments, whatever the case and the separator."""
    shown = F.lower(F.translate(F.col(path), "\\", "/"))
    return (shown == _normal(folder)) | shown.startswith(_normal(folder) + "/")


def folder_scope(root: str, folders: list[str]) -> tuple[str, list[str]]:
    """("whole" | "prefixes" | "outside", prefixes) of a site's root for requested folders."""
    root_n, inside = _normal(root), []
    for folder in map(_normal, folders):
        if root_n == folder or root_n.startswith(folder + "/"):
            return "whole", []
        if folder.startswith(root_n + "/"):
            inside.append(folder)
    return ("prefixes", inside) if inside else ("outside", []) if folders else ("whole", [])


def within(docs: DataFrame, results: DataFrame, column: str = "path") -> DataFrame:
    """Documents whose ``column`` is among ``results``."""
    return docs.join(results.select(column).distinct(), column, "left_semi")


_NAME_REGEX = re.compile(r"(?P<not>!?)\s*(?P<word>/.+/)", re.S)
_NAME_ITEM = re.compile(r"(?P<not>!?)\s*(?P<word>\S.*)", re.S)


def name_pattern(item: str) -> str:
    """The pattern of whole folded names that one item stands for; what a regular expression leaves open may be anything."""
    regex = re.fullmatch(r"/(\^?)(.+?)((?<!\\)\$)?/", item, re.S)
    if regex:
        re.compile(item[1:-1])
        head, body, tail = regex.groups()
        return f"{'' if head else '.*'}(?:{body}){'' if tail else '.*'}"
    # runs of wildcards and of other characters
    pieces = [{"*": ".*", "?": "."}.get(x) or quoted(x) for x in re.findall(r"[*?]|[^*?]+", fold_text(item))]
    edge = "" if re.search(r"[*?]", item) else ".*"
    return edge + "".join(pieces) + edge


@dataclass(frozen=True)
class NamePattern:
    """Include and exclude patterns of folded names, each for a whole name."""

    include: tuple[str, ...]
    exclude: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> NamePattern | None:
        """Items parted by ``;`` or ``,``: globs, ``/regex/``, bare words (contained), ``!`` excludes.

        A text that is one regular expression is not parted.
        """
        whole = _NAME_REGEX.fullmatch(text.strip())
        items = [whole] if whole else [_NAME_ITEM.fullmatch(x.strip()) for x in re.split("[;,]", text)]
        patterns = [(bool(m["not"]), name_pattern(m["word"])) for m in items if m]
        include, exclude = (tuple(p for out, p in patterns if out is side) for side in (False, True))
        return cls(include, exclude) if patterns else None

    def matches(self, names: Column) -> Column:
        """One included name is enough, one excluded name is too many, of an array of names."""
        folded = F.transform(names, fold)
        any_of = lambda ps: F.exists(folded, lambda n: F.rlike(n, F.lit("|".join(f"^(?:{p})$" for p in ps))))
        out = any_of(self.include) if self.include else F.lit(True)
        return out & ~any_of(self.exclude) if self.exclude else out


def quick_filter(docs: DataFrame, text: str) -> DataFrame:
    """Rows of a result list whose folded path contains a folded text."""
    return docs.where(F.contains(fold(F.col("path")), F.lit(fold_text(text))))
