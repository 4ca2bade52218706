"""Queries over what changes: sessions that end, file events, an index that follows its files, and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import patches, reindex
from ..operators.chunking import char_chunks
from ..session import scratch, table
from ..streaming import sessions, watch
from .catalogue import query


@query("""with e as (select user_id::varchar as s, ts, event_id as q, event_type = 'error' as c from events where user_id is not null and ts is not null),
 b as (select *, lag(ts) over w as pt, lag(c) over w as pc from e window w as (partition by s order by ts, q, c)),
 l as (select *, sum(case when pt is null or pc or ts > pt + interval 120 minute then 1 else 0 end) over (partition by s order by ts, q, c rows unbounded preceding) as n from b)
 select s as session_id, min(ts) filter (not c) as started, max(ts) filter (not c) as last_active, count(*) filter (not c) as turns,
 case when bool_or(c) then 'cleared' when max(ts) filter (not c) + interval 120 minute < (select max(ts) from e) then 'expired' else 'live' end as cause,
 array_to_string((list(q order by ts, q) filter (not c))[-6:], ',') as recent from l group by s, n having count(*) filter (not c) > 0""")
def session_lives(spark, d):
    """Users' sessions, which an error clears."""
    e = table(spark, d, "events")
    turns = e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "clear").alias("kind"), F.col("event_type").alias("question"), F.col("props").alias("answer"))
    lives = sessions.session_lives(turns)
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("started", "last_active")}
    return lives.withColumns(plain | {"recent": F.array_join(F.transform("recent", lambda x: x["seq"].cast("string")), ",")})


_SUFFIX = "['java', 'ts', 'md', 'yml', 'png'][event_id % 5 + 1]"


@query(f"""with named as (select n_name as project, ts, '/work/app-' || n_nationkey || '/src/f' || event_id % 97 || '.' || {_SUFFIX} as path from events join nation on user_id % 25 = n_nationkey where event_id % 5 not in (2, 4)),
 b as (select *, case when ts >= lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end as fresh from named window w as (partition by project order by ts, path)),
 s as (select *, sum(fresh) over (partition by project order by ts, path rows unbounded preceding) as g from b)
 select project, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n, arg_max(path, (ts, path)) as last_path from s group by project, g""")
def quiet_projects(spark, d):
    """Events as changes of files in projects that nations register; suffixes that are not watched do not count."""
    e = table(spark, d, "events")
    suffix = F.element_at(F.array(*map(F.lit, ["java", "ts", "md", "yml", "png"])), (F.col("event_id") % 5 + 1).cast("int"))
    events = e.select(F.concat(F.format_string("/work/app-%d/src/f%d.", F.col("user_id") % 25, F.col("event_id") % 97), suffix).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    registry = table(spark, d, "nation").select(F.col("n_name").alias("project"), F.format_string("/work/app-%d/", "n_nationkey").alias("root"), F.col("n_nationkey").alias("ord"))
    out = watch.quiet_projects(watch.watched(events), registry, gap="30 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """The documents as files of their sources, and an older state: some texts differ, some files are missing or too many."""
    docs = table(spark, d, "documents").where("doc_id is not null and source is not null")
    files = docs.select("doc_id", F.col("source").alias("project"), F.format_string("doc-%d.txt", "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    old = files.where("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    gone = files.where("doc_id % 10 = 7").withColumn("path", F.concat(F.lit("gone-"), "path"))
    return old.unionByName(gone).drop("doc_id"), files.drop("doc_id")


@query("""with f as (select source as project, 'doc-' || doc_id || '.txt' as path, doc_id as k from documents where doc_id is not null and source is not null)
 select distinct project, path, 'added' as change from f where k % 10 = 3 union all select distinct project, path, 'changed' from f where k % 5 = 0
 union all select distinct project, 'gone-' || path, 'deleted' from f where k % 10 = 7""")
def reindex_changes(spark, d):
    old, new = (reindex.manifest(reindex.snapshot(x)) for x in _snapshots(spark, d))
    return reindex.changes(old, new)


def _pieces(files: DataFrame) -> DataFrame:
    cut = char_chunks(files.select(F.struct("project", "path").alias("doc_id"), "text"))
    return cut.select("doc_id.project", "doc_id.path", "idx", F.sha2("content", 256).alias("sha256"))


@query("""select source as project, 'doc-' || doc_id || '.txt' as path, i as idx, sha256(case when length(text) <= 2200 then text else substring(text, i * 1800 + 1, 2000) end) as sha256
 from (select *, unnest(range(case when length(text) <= 2200 then 1 else ceil((length(text) - 2000) / 1800.0)::bigint + 1 end)) as i from documents where doc_id is not null and source is not null and text <> '')""")
def reindex_pieces(spark, d):
    """An index of the older state follows the documents: its pieces are those of an index built anew."""
    old, new = _snapshots(spark, d)
    index = reindex.Index(spark, scratch(spark, "index"), local={"pieces": _pieces})
    index.build(old)
    index.update(new)
    return index.table("pieces").select("project", "path", F.col("idx").cast("long").alias("idx"), "sha256")


def _diffs(spark, d) -> DataFrame:
    """A patch for each customer, with a file for each of their orders."""
    o = table(spark, d, "orders")
    path = F.format_string("customer-%d/order-%d.txt", "o_custkey", "o_orderkey")
    text = F.format_string("--- a/%s\n+++ b/%s\n@@ -1,3 +1,4 @@ order\n status %s\n--- key %d\n+-- key %d\n+priority %s\n end\n@@ -9,0 +11,1 @@\n+tail %d", path, path, "o_orderstatus", "o_orderkey", F.col("o_orderkey") + 1, "o_orderpriority", "o_custkey")
    each = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("t")))).alias("x"))
    return each.select(F.col("o_custkey").alias("id"), F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("diff"))


_PATH = "'customer-' || o_custkey || '/order-' || o_orderkey || '.txt'"


@query(f"""select o_custkey as id, {_PATH} as path, kind, old_no, new_no, text from orders, unnest([
 {{'kind': 'context', 'old_no': 1, 'new_no': 1, 'text': 'status ' || o_orderstatus}}, {{'kind': 'remove', 'old_no': 2, 'new_no': 0, 'text': '-- key ' || o_orderkey}},
 {{'kind': 'add', 'old_no': 0, 'new_no': 2, 'text': '-- key ' || (o_orderkey + 1)}}, {{'kind': 'add', 'old_no': 0, 'new_no': 3, 'text': 'priority ' || o_orderpriority}},
 {{'kind': 'context', 'old_no': 3, 'new_no': 4, 'text': 'end'}}, {{'kind': 'add', 'old_no': 0, 'new_no': 11, 'text': 'tail ' || o_custkey}}]) as u(x), lateral (select x.kind, x.old_no, x.new_no, x.text)""")
def patch_lines(spark, d):
    place = [F.coalesce(c, F.lit(0)).alias(c) for c in ("old_no", "new_no")]
    return patches.diff_lines(_diffs(spark, d)).select("id", "path", "kind", *place, "text")


@query(f"""select {_PATH} as path, 'status ' || o_orderstatus || chr(10) || '-- key ' || (o_orderkey + 1) || chr(10) || 'priority ' || o_orderpriority || chr(10) || 'end' || chr(10)
 || array_to_string(list_transform(range(4, 10), lambda n: 'l' || n || ' ' || o_orderkey), chr(10)) || chr(10) || 'tail ' || o_custkey || chr(10) || 'l10' as text from orders""")
def patched_files(spark, d):
    o = table(spark, d, "orders")
    rest = F.array_join(F.transform(F.sequence(F.lit(4), F.lit(9)), lambda n: F.format_string("l%d %d", n, "o_orderkey")), "\n")
    files = o.select(F.format_string("customer-%d/order-%d.txt", "o_custkey", "o_orderkey").alias("path"), F.concat(F.format_string("status %s\n-- key %d\nend\n", "o_orderstatus", "o_orderkey"), rest, F.lit("\nl10")).alias("text"))
    return patches.patched(files, patches.diff_lines(_diffs(spark, d)))
