"""The folder tree against prefixes of paths."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.sources import folders
from textloom.sources.extract import SEPARATOR


def paths(seed, n=120):
    pick = random.Random(seed)
    names = ["a", "A", "b", "b-c", "b c", "é", "ab"]
    return ["/".join(pick.choices(names, k=pick.randrange(0, 4)) + [f"f{i}"]) for i in range(n)] + [f"a/x.zip{SEPARATOR}q/r", "C:\\Data\\f", "/root/f", None]


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, p, "x", "x") for i, p in enumerate(paths(1))], "doc_id long, path string, key string, low string").repartition(3)
    tree = folders.folder_tree(docs)
    out = f"{tmp_path_factory.mktemp('folders')}/docs"
    folders.place_documents(docs, tree).write.parquet(out)
    return tree, spark.read.parquet(out)


@pytest.mark.parametrize("folder", ["a", "A/", "b", "b/b-c", "B C", "é", "ab", "", "c:\\data", "/root", "nothing", "a/x.zip"])
def test_within_a_folder(placed, folder):
    tree, docs = placed
    asked = folder.replace("\\", "/").rstrip("/").lower()
    file = lambda p: p.split(SEPARATOR)[0].replace("\\", "/").lower()
    known = {"/".join(file(p).split("/")[:n]) for p in paths(1) if p for n in range(len(file(p).split("/")))}
    want = [i for i, p in enumerate(paths(1)) if p and asked in known and (asked == "" or file(p).startswith(asked + "/"))]
    assert sorted(r["doc_id"] for r in docs.where(folders.within(tree, folder)).collect()) == want


def test_paths_come_back_and_move(placed):
    tree, docs = placed
    got = {r["doc_id"]: (r["path"], r["key"]) for r in folders.full_paths(docs, tree).collect()}
    assert got == {i: (p and p.replace("\\", "/"), "x") for i, p in enumerate(paths(1))}
    after = folders.moved(tree, "b", "E:/new$1")
    want = {i: "E:/new$1" + p[1:] if p and p.lower().startswith("b/") else p and p.replace("\\", "/") for i, p in enumerate(paths(1))}
    assert {r["doc_id"]: r["path"] for r in folders.full_paths(docs, after).collect()} == want
    inside = docs.where(folders.within(after, "e:/NEW$1/B-C"))
    assert {r["doc_id"] for r in inside.collect()} == {i for i, p in enumerate(paths(1)) if p and p.lower().startswith("b/b-c/")}


def test_the_range_is_pushed_down(spark, placed):
    tree, docs = placed
    plan = docs.where(folders.within(tree, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(folder," in plan and "LessThanOrEqual(folder," in plan


def test_no_documents(spark):
    empty = spark.createDataFrame([], "path string")
    assert folders.folder_tree(empty).count() == 0
    assert folders.full_paths(folders.place_documents(empty, folders.folder_tree(empty)), folders.folder_tree(empty)).count() == 0
    assert folders.folder_tree(spark.createDataFrame([("f",)], "path string")).select(F.col("folder")).collect()[0][0] == ""
