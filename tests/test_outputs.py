import json

import pytest

from textloom.cli import main
from textloom.sinks import export
from textloom.store.catalog import Catalog, release_lease, take_lease


def test_csv_and_html():
    csv = export.excel_csv([{"p": "a;b", "n": 2}, {"p": 'q"', "n": 3}], ["p", "n"])
    assert csv == '\ufeffp;n\r\n"a;b";2\r\n"q""";3\r\nTotal;5\r\n'
    page = export.html_report("T<", [{"path": "a", "matches": 1, "snippets": [{"line": 1, "text": "x ⟦<y>⟧"}]}])
    assert "T&lt;" in page and '<mark class="exact">&lt;y&gt;</mark>' in page


def test_unique_names_and_copies(tmp_path):
    assert export.unique_names(["x.txt", "X.txt", "x (2).txt"]) == ["x.txt", "X (2).txt", "x (2) (2).txt"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("A")
    plan = export.copy_plan([str(tmp_path / "in/a.txt")] * 2)
    assert export.copy_files(plan, str(tmp_path / "out")) == 1 and export.copy_files(plan, str(tmp_path / "out")) == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a (2).txt", "a.txt"]
    assert export.copy_files(plan, str(tmp_path / "o.zip")) == 1


def test_saved_results(tmp_path):
    export.save_results(tmp_path / "r.json", "q", {"fuzzy": True}, [{"path": "a"}])
    back = export.load_results(tmp_path / "r.json")
    assert back["query"] == "q" and back["hits"][0]["path"] == "a" and back["hits"][0]["snippets"] == []
    assert json.loads(export.json_export("q", [{"path": "a"}]))["total"] == 1


def test_catalog(tmp_path):
    c = Catalog(str(tmp_path))
    site = c.add_site("Été", ["/data/A"])
    assert site.id.startswith("ete-")
    with pytest.raises(ValueError):
        c.add_site("again", ["\\data\\a\\"])
    group = c.save_group("g", [site.id, site.id])
    c.remove_site(site.id)
    assert c.sites() == [] and c.groups()[0].id == group.id and c.groups()[0].site_ids == ()
    s = c.save_search("n", "q", {"a": 1})
    assert c.save_search("other", "q", {"a": 1}) == s
    c.set_alert(s.id, True, ["old"])
    assert c.record(s.id, ["old", "new", "new"]) == ["new"] and c.record(s.id, ["new"]) == [] and c.record(s.id, ["old"], gone=["old"]) == ["old"]
    c.mark_read(s.id)
    assert c.searches()[0].fresh == ()


def test_lease(tmp_path):
    path = tmp_path / "lease.json"
    assert take_lease(path, "a", 0) and not take_lease(path, "b", 60) and take_lease(path, "b", 200)
    release_lease(path, "b")
    assert not path.exists()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("the red fox")
    (tmp_path / "docs/b.txt").write_text("nothing")
    assert main(["index", str(tmp_path / "docs"), str(tmp_path / "t")]) == 0
    assert main(["search", "red", str(tmp_path / "t"), "--format", "jsonl"]) == 0
    row = json.loads(capsys.readouterr().out)
    assert row["name"] == "a.txt" and row["snippet"] == "1: the ⟦red⟧ fox"
    assert main(["scan", "fox", str(tmp_path / "docs"), "--format", "csv"]) == 0 and main(["search", "zebra", str(tmp_path / "t")]) == 1
    assert main(["search", "/(/", str(tmp_path / "t")]) == 2
