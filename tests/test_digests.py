"""Facts as JSON and back, digests of others, the registry, and changelogs."""

from loomgraph.operators import extraction as X
from loomgraph.sources.digests import read_digest, registry, scan_digests, write_digests

REGISTRY = """workspace: /w   # where
projects:
  frontend:
    - name: portal
      type: angular
      path: /w/fe/portal
  services:
    - name: "orders"
      type: spring-boot
      path: /w/be/orders
      port: 8081
    # - name: old
    - type: spring-boot
      path: /w/nameless
    - name: stock
      path: '/w/be/stock'
other:
  - name: never
"""
LOG = """<databaseChangeLog xmlns="x"><changeSet id="1" author="a"><createTable tableName="items"><column name="id" type="int"/></createTable></changeSet>
<changeSet id="2" author="a"><addColumn tableName="orders"><column name="note" type="text"/><column name="at" type="date"/></addColumn><dropTable tableName='gone'/></changeSet>
<changeSet id="3" author="a"><addColumn tableName="items"><column name="n" type="int"/></addColumn></changeSet></databaseChangeLog>"""


def test_facts_round_trip(spark, tmp_path):
    rows = [("007", "a", ["x", "y"], None), ("b=1 %", "q\"\n", [], 5), ("c", None, None, 1)]
    facts = spark.createDataFrame(rows, "project string, name string, uses array<string>, n int")
    for _ in range(2):
        write_digests({"beans": facts}, str(tmp_path))
    (tmp_path / "beans" / "project=c" / "part-bad.json").write_text('{"name": "broken\n{"name": "fine"}\n')
    got = sorted(map(tuple, read_digest(spark, str(tmp_path), "beans", facts.schema).collect()), key=str)
    assert [(p, n, list(u) if u is not None else None, k) for p, n, u, k in got] == sorted([*rows, ("c", "fine", None, None)], key=str)


def test_digests_of_others(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.digest.json").write_text('{\n "type": "spring-boot", "project": "a",\n "endpoints": [{"path": "/x", "method": "GET"}]\n}')
    (tmp_path / "sub" / "w.digest.json").write_text('{"type": "angular", "project": "w"}')
    (tmp_path / "master.digest.json").write_text('{"system": "all"}')
    (tmp_path / "bad.digest.json").write_text('{"type": ')
    (tmp_path / "other.json").write_text('{"type": "angular"}')
    got = {r["file"]: (r["kind"], r["project"], len(r["endpoints"] or [])) for r in scan_digests(spark, str(tmp_path), "type string, project string, system string, endpoints array<struct<path string, method string>>").collect()}
    assert got == {"a.digest.json": ("spring-boot", "a", 1), "w.digest.json": ("angular", "w", 0), "master.digest.json": ("master", None, 0)}


def test_registry_in_order(spark):
    files = spark.createDataFrame([("p.yaml", REGISTRY), ("none.yaml", None)], "path string, text string")
    assert sorted(map(tuple, registry(files).collect()), key=lambda r: r[-1]) == [("portal", "angular", "/w/fe/portal", None, 0), ("orders", "spring-boot", "/w/be/orders", 8081, 1), ("stock", None, "/w/be/stock", None, 2)]


def test_changelogs(spark):
    files = spark.createDataFrame([("p", "db/db.changelog-1.xml", LOG), ("p", "db/db.changelog-bad.xml", "<a tableName=\"half\" <"), ("p", "db/db.changelog-none.xml", "<databaseChangeLog/>"), ("p", "db/V1__x.sql", "DROP TABLE IF EXISTS t; create table u (a int)"), ("p", "x.xml", LOG)], "project string, path string, text string")
    got = {r["file"]: (r["tables"], r["columns"]) for r in X.migrations(files).collect()}
    assert got == {"db.changelog-1.xml": (["items", "orders", "gone"], ["note:text", "at:date", "n:int"]), "db.changelog-bad.xml": (["half"], []), "V1__x.sql": (["t", "u"], [])}
