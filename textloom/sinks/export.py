"""Exports of hits: CSV, JSON, JSON Lines, HTML, saved results, and copies of found files."""

from __future__ import annotations

import datetime as dt
import html
import json
import os
import re
import shutil
import zipfile
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The columns of a result row.
COLUMNS = ("site_id", "path", "file", "inner", "name", "kind", "lang", "size", "modified", "score", "exact", "matches", "snippet")


def result_rows(hits: DataFrame) -> DataFrame:
    """The thirteen columns of a result list, dates in ISO form, from hits with snippets."""
    snippet = F.array_join(F.transform("snippets", lambda s: F.concat(s["line"].cast("string"), F.lit(": "), s["text"])), " … ")
    modified = F.date_format(F.timestamp_seconds("modified"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return hits.withColumns({"snippet": snippet, "modified": modified}).select(*COLUMNS)


def write_rows(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Write result rows as a folder of CSV or JSON Lines files."""
    if form == "csv":
        rows.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    elif form == "jsonl":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown form: {form}")


def csv_cell(value: Any, separator: str = ",") -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if re.search(f'[{re.escape(separator)}"\r\n]', text) else text


def excel_csv(rows: list[dict[str, Any]], columns: list[str], separator: str = ";", totals: bool = True) -> str:
    """A CSV for spreadsheets: byte order mark, a separator by locale, and a row of totals."""
    lines = [separator.join(csv_cell(c, separator) for c in columns)]
    lines += [separator.join(csv_cell(r.get(c), separator) for c in columns) for r in rows]
    if totals and rows:
        sums = [sum(r[c] for r in rows if isinstance(r.get(c), (int, float))) if any(isinstance(r.get(c), (int, float)) for r in rows) else "" for c in columns]
        lines.append(separator.join(csv_cell("Total" if i == 0 else s, separator) for i, s in enumerate(sums)))
    return "﻿" + "\r\n".join(lines) + "\r\n"


def wide_report(long: DataFrame, terms: list[str]) -> DataFrame:
    """One row for each document with a column for each term, from (path, term, n)."""
    return long.groupBy("path").pivot("term", terms).agg(F.sum("n")).na.fill(0)


def marked_html(text: str) -> str:
    """Escaped text whose markers are elements."""
    shown = html.escape(text)
    for a, b, kind in (("⟦", "⟧", "exact"), ("⟪", "⟫", "near")):
        shown = shown.replace(a, f'<mark class="{kind}">').replace(b, "</mark>")
    return shown


def html_report(title: str, rows: Iterable[dict[str, Any]]) -> str:
    """A page that needs no other file."""
    items = "".join(
        f"<article><h2>{html.escape(str(r.get('path', '')))}</h2><p class=meta>{html.escape(str(r.get('kind', '')))} · {r.get('matches', '')}</p>"
        + "".join(f"<p><b>{s['line']}</b> {marked_html(s['text'])}</p>" for s in r.get("snippets") or [])
        + "</article>"
        for r in rows
    )
    style = "body{font:15px sans-serif;max-width:60em;margin:2em auto}mark.near{background:#fd9}.meta{color:#666}"
    return f"<!doctype html><html><head><meta charset=utf-8><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{items}</body></html>"


def json_export(query: str, rows: list[dict[str, Any]], now: dt.datetime | None = None) -> str:
    made = (now or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"query": query, "made": made, "total": len(rows), "hits": rows}, ensure_ascii=False, indent=1, default=str)


def save_results(path: Path, query: str, settings: dict[str, Any], rows: list[dict[str, Any]]) -> None:
    path.write_text(json.dumps({"version": 1, "query": query, "settings": settings, "hits": rows}, ensure_ascii=False, default=str), encoding="utf-8")


def load_results(path: Path) -> dict[str, Any]:
    """A saved result list; what is missing has its default."""
    saved = json.loads(path.read_text(encoding="utf-8"))
    hits = [{c: h.get(c) for c in COLUMNS} | {"snippets": h.get("snippets") or []} for h in saved.get("hits", [])]
    return {"version": 1, "query": "", "settings": {}} | saved | {"hits": hits}


def unique_names(names: Iterable[str]) -> list[str]:
    """Names made distinct, whatever the case: ``x``, ``x (2)``, and past names that exist already."""
    taken: set[str] = set()
    out = []
    for name in names:
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (name, "")
        shown, n = name, 1
        while shown.lower() in taken:
            n += 1
            shown = f"{stem} ({n}){ext}"
        taken.add(shown.lower())
        out.append(shown)
    return out


def plain_name(name: str) -> str:
    """The file name form of :func:`textloom.functions.text.safe_name`."""
    shown = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name).rstrip(". ")
    return shown if shown.strip() else "document"


def copy_plan(paths: list[str], root: str | None = None) -> list[tuple[str, str]]:
    """(source, target) of found files, flat or as a tree below ``root``; a path seen once is copied once."""
    sources = list(dict.fromkeys(paths))
    if root is None:
        return list(zip(sources, unique_names(plain_name(os.path.basename(p)) for p in sources)))
    base = root.replace("\\", "/").rstrip("/") + "/"
    inside = [p.replace("\\", "/").removeprefix(base) for p in sources]
    return list(zip(sources, unique_names("/".join(plain_name(x) for x in p.split("/") if x not in ("", ".", "..")) for p in inside)))


def copy_files(plan: list[tuple[str, str]], target: str) -> int:
    """Copy by a plan into a folder, or into a ZIP if the target ends so; nothing is overwritten."""
    done = 0
    if target.lower().endswith(".zip"):
        with zipfile.ZipFile(target, "x", zipfile.ZIP_DEFLATED) as out:
            for source, name in plan:
                out.write(source, name)
                done += 1
        return done
    for source, name in plan:
        to = Path(target) / name
        to.parent.mkdir(parents=True, exist_ok=True)
        n, free = 1, to
        while free.exists():
            n += 1
            free = to.with_name(f"{to.stem} ({n}){to.suffix}")
        shutil.copy2(source, free)
        done += 1
    return done


