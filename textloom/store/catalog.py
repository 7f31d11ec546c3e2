"""Sites, site groups, saved searches and alerts as small JSON files, written beside and renamed."""

from __future__ import annotations

import json
import os
import re
import time
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from ..functions.text import fold_text


@dataclass(frozen=True)
class Site:
    id: str
    name: str
    roots: tuple[str, ...]
    exclusions: tuple[str, ...] = ()
    meaning: bool = False


@dataclass(frozen=True)
class Group:
    id: str
    name: str
    color: str = ""
    site_ids: tuple[str, ...] = ()


@dataclass(frozen=True)
class SavedSearch:
    id: str
    name: str
    query: str
    settings: dict[str, Any] = field(default_factory=dict)
    alert: bool = False
    seen: tuple[str, ...] = ()
    fresh: tuple[str, ...] = ()


def write_json(path: Path, value: Any) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    beside.write_text(json.dumps(value, ensure_ascii=False, indent=1), encoding="utf-8")
    os.replace(beside, path)


def slug(name: str, now: float | None = None) -> str:
    """An id from a folded name and the time."""
    base = re.sub(r"[^a-z0-9]+", "-", fold_text(name)).strip("-") or "site"
    return f"{base}-{int((time.time() if now is None else now) * 1000)}"


class Catalog:
    """The catalogue in one folder."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _load(self, name: str, kind: type) -> list:
        path = self.folder / f"{name}.json"
        if not path.exists():
            return []
        rows = json.loads(path.read_text(encoding="utf-8"))
        return [kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k in kind.__dataclass_fields__}) for row in rows]

    def _save(self, name: str, rows: list) -> None:
        write_json(self.folder / f"{name}.json", [asdict(r) for r in rows])

    def sites(self) -> list[Site]:
        return self._load("sites", Site)

    def add_site(self, name: str, roots: list[str], exclusions: list[str] | None = None) -> Site:
        """A new site; a root that another site has is refused."""
        rows = self.sites()
        taken = {r.replace("\\", "/").rstrip("/").lower() for s in rows for r in s.roots}
        for root in roots:
            if root.replace("\\", "/").rstrip("/").lower() in taken:
                raise ValueError(f"a site has this root already: {root}")
        site = Site(slug(name), name, tuple(roots), tuple(exclusions or ()))
        self._save("sites", [*rows, site])
        return site

    def remove_site(self, site_id: str) -> None:
        self._save("sites", [s for s in self.sites() if s.id != site_id])
        self._save("groups", [replace(g, site_ids=tuple(i for i in g.site_ids if i != site_id)) for g in self.groups()])

    def set_meaning(self, site_id: str, on: bool) -> None:
        self._save("sites", [replace(s, meaning=on) if s.id == site_id else s for s in self.sites()])

    def groups(self) -> list[Group]:
        return self._load("groups", Group)

    def save_group(self, name: str, site_ids: list[str], color: str = "", group_id: str | None = None) -> Group:
        group = Group(group_id or slug(name), name, color, tuple(dict.fromkeys(site_ids)))
        self._save("groups", [*(g for g in self.groups() if g.id != group.id), group])
        return group

    def remove_group(self, group_id: str) -> None:
        self._save("groups", [g for g in self.groups() if g.id != group_id])

    def searches(self) -> list[SavedSearch]:
        return self._load("saved", SavedSearch)

    def save_search(self, name: str, query: str, settings: dict[str, Any]) -> SavedSearch:
        """A saved search; one of the same query and settings is returned as it is."""
        rows = self.searches()
        same = next((s for s in rows if s.query == query and s.settings == settings), None)
        if same:
            return same
        made = SavedSearch(slug(name), name, query, settings)
        self._save("saved", [*rows, made])
        return made

    def remove_search(self, search_id: str) -> None:
        self._save("saved", [s for s in self.searches() if s.id != search_id])

    def set_alert(self, search_id: str, on: bool, found: list[str] | None = None) -> None:
        """Turn an alert on, with what is found now as seen, or off, with nothing remembered."""
        change = lambda s: replace(s, alert=on, seen=tuple(found or ()) if on else (), fresh=())
        self._save("saved", [change(s) if s.id == search_id else s for s in self.searches()])

    def record(self, search_id: str, found: list[str], gone: list[str] | None = None) -> list[str]:
        """New documents of an alert, each announced once; removed documents are forgotten."""
        new: list[str] = []
        rows = []
        for s in self.searches():
            if s.id == search_id and s.alert:
                seen = [p for p in s.seen if p not in set(gone or ())]
                new = [p for p in dict.fromkeys(found) if p not in set(seen)]
                s = replace(s, seen=tuple(seen + new), fresh=tuple(dict.fromkeys([*s.fresh, *new])))
            rows.append(s)
        self._save("saved", rows)
        return new

    def mark_read(self, search_id: str) -> None:
        self._save("saved", [replace(s, fresh=()) if s.id == search_id else s for s in self.searches()])


#: A lease is renewed every 30 seconds and given up after 120.
BEAT, TTL = 30, 120


def take_lease(path: Path, owner: str, now: float | None = None) -> bool:
    """Whether ``owner`` holds the single-writer lease; a stale lease is taken over."""
    now = time.time() if now is None else now
    held = json.loads(path.read_text()) if path.exists() else None
    if held and held["owner"] != owner and now - held["beat"] < TTL:
        return False
    write_json(path, {"owner": owner, "beat": now})
    return True


def release_lease(path: Path, owner: str) -> None:
    if path.exists() and json.loads(path.read_text())["owner"] == owner:
        path.unlink()
