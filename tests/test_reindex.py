"""An index that follows its files equals one built anew; file events lead to the re-index of their projects."""

import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import codegraph, extraction
from loomgraph.operators.chunking import char_chunks
from loomgraph.operators.reindex import Index, changes, manifest, owners, snapshot
from loomgraph.sources.files import source_files
from loomgraph.streaming.watch import file_events, follow, quiet_projects

SCHEMA = "project string, path string, text string"


def pieces(files):
    whole = files.select(F.struct("project", "path").alias("doc_id"), "text")
    return char_chunks(whole, 60, 10, 70).select("doc_id.project", "doc_id.path", "idx", "content")


def beans(files):
    return extraction.beans(extraction.java_members(extraction.java_statements(files)))


def edges(tables):
    out = codegraph.depends_on(tables["beans"])
    return out.withColumn("project", F.split("src", "::")[1])


def index(spark, root):
    return Index(spark, str(root), local={"pieces": pieces}, project={"beans": beans}, derived={"edges": edges})


def java(name, wants):
    fields = "\n".join(f"  private final {w} {w.lower()};" for w in wants)
    return f"@Service\npublic class {name} {{\n{fields}\n  public void run() {{ go(); }}\n}}\n"


def first_tree():
    rows = [(p, f"{p}/src/{n}.java", java(n, [w])) for p in ("shop", "stock=1 %", "007") for n, w in (("AService", "BService"), ("BService", "CService"))]
    return rows + [("old", "old/Only.java", java("CService", [])), ("shop", "shop/empty.java", None), (None, "x.java", "class X {}"), ("shop", None, "class Y {}")]


def second_tree():
    rows = [r for r in first_tree() if r[0] != "old" and r[1] != "shop/src/BService.java"]
    rows = [(p, x, java("AService", ["DService", "BService"]) if x == "007/src/AService.java" else t) for p, x, t in rows]
    return rows + [("new", "new/DService.java", java("DService", ["AService"])), ("shop", "shop/src/D.java", java("DService", []))]


def content(spark, at, names=("manifest", "pieces", "beans", "edges")):
    own = index(spark, at)
    return {n: sorted(map(str, own.table(n).collect())) for n in names}


@pytest.mark.parametrize("seed", [0, 1])
def test_update_equals_rebuild(spark, tmp_path, seed):
    """Adds, changes and deletes, whole projects among them; a second update with nothing to do; random further edits."""
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    own = index(spark, tmp_path / "live")
    own.build(frame(first_tree()))
    rows = second_tree()
    r = random.Random(seed)
    for step in range(2):
        found = own.update(frame(rows))
        assert found.count() > 0 and own.update(frame(rows)).count() == 0
        index(spark, tmp_path / f"anew{step}").build(frame(rows))
        assert content(spark, tmp_path / "live") == content(spark, tmp_path / f"anew{step}")
        rows = [x if r.random() < 0.6 else (x[0], x[1], java("BService", ["CService"])) for x in rows if r.random() < 0.8] + [("more", f"more/E{step}.java", java("EService", ["AService"]))]


def test_changes_of_odd_rows(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("a", "y", None), ("a", "z", "3"), ("a", "z", "4")], SCHEMA)
    new = spark.createDataFrame([("a", "x", "2"), ("a", "y", ""), ("b", "x", "1"), (None, "q", "1")], SCHEMA)
    got = changes(manifest(snapshot(old)), manifest(snapshot(new)))
    assert sorted(map(tuple, got.collect())) == [("a", "x", "changed"), ("a", "z", "deleted"), ("b", "x", "added")]
    assert changes(manifest(snapshot(old)), manifest(snapshot(old))).count() == 0


def test_update_of_some_projects_leaves_the_others(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    own = index(spark, tmp_path / "live")
    own.build(frame(first_tree()))
    only = spark.createDataFrame([("shop",)], "project string")
    own.update(frame(second_tree()), only)
    mixed = [x for x in first_tree() if x[0] != "shop"] + [x for x in second_tree() if x[0] == "shop"]
    index(spark, tmp_path / "anew").build(frame(mixed))
    assert content(spark, tmp_path / "live") == content(spark, tmp_path / "anew")


def test_owner_is_the_first_registered_root(spark):
    registry = spark.createDataFrame([("front", "/w/app", 0), ("inner", "/w/app/lib/", 1), ("back", "/w/back", 2), ("outer", "/w", 3)], "project string, root string, ord int")
    paths = spark.createDataFrame([("/w/app/a.ts",), ("/w/app/lib/b.ts",), ("/w/back/C.java",), ("/w/application/x.ts",), ("/v/x.ts",), (None,)], "path string")
    assert sorted(map(tuple, owners(paths, registry).collect())) == [("/w/app/a.ts", "front"), ("/w/app/lib/b.ts", "front"), ("/w/application/x.ts", "outer"), ("/w/back/C.java", "back")]


def write(root: pathlib.Path, path: str, text: str | None):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.unlink() if text is None else at.write_text(text)


def test_from_folder_to_index(spark, tmp_path):
    """Change logs in a folder, bursts by project, and an index equal to one built from the tree as it then is."""
    tree, logs = tmp_path / "tree", tmp_path / "logs"
    for p, x, t in [("shop", "src/AService.java", java("AService", ["BService"])), ("shop", "src/BService.java", java("BService", [])), ("stock", "src/C.java", java("CService", ["AService"])), ("quiet", "src/Q.java", java("QService", []))]:
        write(tree / p, x, t)
    roots = {p: f"{tree}/{p}" for p in ("shop", "stock", "quiet")}
    registry = spark.createDataFrame([(p, r, i) for i, (p, r) in enumerate(roots.items())], "project string, root string, ord int")

    def read(projects):
        files = source_files(spark, str(tree)).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
        return owners(files, registry).where(F.col("project").isin(projects))

    own = index(spark, tmp_path / "live")
    own.build(read(list(roots)))
    write(tree / "shop", "src/BService.java", None)
    write(tree / "stock", "src/C.java", java("CService", ["DService"]))
    write(tree / "stock", "src/D.java", java("DService", []))
    write(tree / "quiet", "src/Q.java", java("QService", ["AService"]))  # changed, but nobody said so
    logs.mkdir()
    events = [("shop/src/BService.java", "deleted", "10:00:00.0"), ("stock/src/C.java", "modified", "10:00:00.5"), ("stock/src/D.java", "created", "10:00:01.5"), ("stock/readme.md", "modified", "10:00:02"), ("elsewhere/x.java", "modified", "10:00:03")]
    (logs / "1.json").write_text("\n".join(json.dumps({"path": f"{tree}/{p}", "kind": k, "ts": f"2024-05-01T{t}Z"}) for p, k, t in events))
    (logs / "2.json").write_text(json.dumps({"path": f"{tree}/quiet/none.java", "kind": "modified", "ts": "2024-05-01T11:00:00Z"}))
    said = []
    bursts = quiet_projects(file_events(spark, str(logs), 1), registry)
    query = follow(bursts, own, read, str(tmp_path / "check"), lambda found: said.extend(map(tuple, found.collect())))
    query.awaitTermination(180)
    assert query.exception() is None
    rel = sorted((p, x.split("/src/")[1], c) for p, x, c in said)
    assert rel == [("shop", "BService.java", "deleted"), ("stock", "C.java", "changed"), ("stock", "D.java", "added")]
    index(spark, tmp_path / "anew").build(read(["shop", "stock"]))
    live = content(spark, tmp_path / "live", ("pieces",))["pieces"]
    assert [x for x in live if "quiet" not in x] == content(spark, tmp_path / "anew", ("pieces",))["pieces"]
    batch = quiet_projects(spark.createDataFrame([(f"{tree}/{p}", f"2024-05-01 {t}") for p, _, t in events], "path string, ts string").select("path", F.col("ts").cast("timestamp").alias("ts")), registry)
    assert sorted((r["project"], r["n"]) for r in batch.collect()) == [("shop", 1), ("stock", 3)]
