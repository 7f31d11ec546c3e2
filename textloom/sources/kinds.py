"""File families by extension, and which folders and files a crawl leaves out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions (or whole names of files without one) by family.
FAMILIES = {
    "pdf": "pdf",
    "word": "docx docm doc odt rtf",
    "excel": "xlsx xlsm xls ods",
    "powerpoint": "pptx pptm ppt odp",
    "archive": "zip jar rar 7z tar gz tgz bz2 tbz2 tbz",
    "email": "eml msg pst ost mbox",
    "image": "png jpg jpeg jfif tif tiff bmp gif webp",
    "code": (
        "rs ts tsx js jsx mjs cjs py pyw java kt kts go c h cc cpp cxx hpp hh cs fs vb php rb swift scala sh bash zsh fish bat cmd ps1 psm1 sql css scss sass less vue svelte astro lua dart r pl pm ex exs "
        "erl hs clj groovy gradle m mm zig nim jl sol proto graphql dockerfile makefile cmake"
    ),
    "text": "txt md markdown rst log csv tsv json jsonl xml yaml yml toml ini cfg conf properties env html htm srt vtt tex adoc org epub",
}
EXTENSIONS = {e: kind for kind, names in FAMILIES.items() for e in names.split()}
#: Folders that a crawl never enters.
EXCLUDED_FOLDERS = (".git", "node_modules", "target", ".svn", ".hg", "__pycache__", ".venv", "$recycle.bin", "system volume information")


def kind_of_name(name: str) -> str | None:
    name = name.lower()
    stem, dot, ext = name.rpartition(".")
    return EXTENSIONS.get(ext if dot and stem else name)


def kind_of(path: Column) -> Column:
    """The family of a path's last segment, or null."""
    name = F.lower(F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1))
    ext = F.when(F.rlike(name, F.lit(r"^.+\.[^.]*$")), F.substring_index(name, ".", -1)).otherwise(name)
    out = F.lit(None).cast("string")
    for kind, names in FAMILIES.items():
        out = F.when(ext.isin(names.split()), kind).otherwise(out)
    return out


def hidden_or_excluded(path: Column) -> Column:
    """A hidden segment, or one of the excluded folders."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    return F.exists(parts, lambda p: (p.startswith(".") & (F.length(p) > 1) & (p != "..")) | p.isin(*EXCLUDED_FOLDERS))


def excluded(path: Column, rules: list[str]) -> Column:
    """User exclusions: a glob, or a prefix of whole segments, whatever the case."""
    shown, out = F.lower(F.translate(path, "\\", "/")), F.lit(False)
    for rule in rules:
        rule = rule.strip().replace("\\", "/").rstrip("/").lower()
        if not rule:
            continue
        if set("*?") & set(rule):
            pattern = "".join(".*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in rule)
            out = out | F.rlike(shown, F.lit(f"^(.*/)?{pattern}(/.*)?$"))
        else:
            out = out | (shown == rule) | shown.startswith(rule + "/")
    return out
