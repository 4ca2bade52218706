"""Source trees on a small fixture."""

from loomgraph.sources.files import properties, replace_partition, source_files


def test_files_properties_and_partitions(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a/App.java": "class App {}", "a/application.properties": "# note\nport = 80\nname: x y\nport=81\n", "node_modules/x.ts": "no", ".git/y.ts": "no", "b/readme.md": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = source_files(spark, str(root))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["App.java", "application.properties"]
    assert {(r.key, r.value) for r in properties(files.where("path like '%properties'")).collect()} == {("port", "81"), ("name", "x y")}
    out = str(tmp_path / "out")
    replace_partition(spark.createDataFrame([("p", 1), ("q", 2)], "project string, v int"), out, "project")
    replace_partition(spark.createDataFrame([("q", 3)], "project string, v int"), out, "project")
    assert sorted((r.project, r.v) for r in spark.read.parquet(out).collect()) == [("p", 1), ("q", 3)]
