"""A Merkle manifest of documents: a leaf for each row, a tree of eights for each language, a tree over the languages.

Rows get gapless positions by a range partition and the counts of its parts. On each level a window over short blocks of
consecutive nodes offers fixed-offset lag and lead columns; a node's slot and the length of its run mask those that are its
siblings, and the first child of each run hashes the parent. From the root down, each node then takes its parent's list of
siblings behind its own, so that a document folds its proof without reading the tree.

Nothing gathers a language: blocks have `BLOCK` nodes. Null fields are marked as such; a null id comes first and is never
tampered with, as it has no decimals; equal rows stand side by side; equal ids are ordered by their leaves; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Children of a node, and nodes that one window holds: a power of FAN.
FAN, BLOCK = 8, 512
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*(_field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def lower_latin(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def positions(df: DataFrame, cls: list[str], order: list[str], name: str) -> DataFrame:
    """Add pos, gapless from 0 in each class by the order, and n, the size of the class.

    Rows are dealt by ranges of class and order (equal ones by where they were read), so a class spreads over many parts;
    one row for each class and part carries the counts.
    """
    by = [*cls, *order, "_from"]
    dealt = df.withColumn("_from", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_from")
    rows = cut(dealt.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)), name)
    parts = rows.groupBy(*cls, "_p").agg(F.min("_m").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    each = Window.partitionBy(*cls)
    before = F.coalesce(F.sum("_n").over(each.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*cls, "_p", (before - F.col("_lo")).alias("_first"), F.sum("_n").over(each).alias("n"))
    return rows.join(parts, [*cls, "_p"]).withColumn("pos", F.col("_m") + F.col("_first")).drop("_m", "_p", "_first")


def with_siblings(nodes: DataFrame, cls: list[str]) -> DataFrame:
    """nodes(cls, pos, n, h) with left and right: the digests of a node's siblings before and behind it."""
    slot = F.col("pos") % FAN
    run = F.least(F.lit(FAN), F.col("n") - F.col("pos") + slot)
    w = Window.partitionBy(*cls, F.expr(f"pos div {BLOCK}")).orderBy("pos")
    before = [F.when(slot >= k, F.lag("h", k).over(w)) for k in range(FAN - 1, 0, -1)]
    behind = [F.when(slot + k < run, F.lead("h", k).over(w)) for k in range(1, FAN)]
    return nodes.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *behind)})


def tree(nodes: DataFrame, cls: list[str], name: str) -> list[DataFrame]:
    """Levels from the leaves up; a class ends on the level where its n is 1."""
    levels = [cut(with_siblings(nodes, cls), f"{name}0")]
    most = levels[0].agg(F.max("n").alias("n")).first()["n"] or 1
    while most > 1:
        first = levels[-1].where(F.col("n") > 1).where(F.col("pos") % FAN == 0)
        up = first.select(*cls, F.expr(f"pos div {FAN}").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2(F.concat("h", "right"), 256).alias("h"))
        levels.append(cut(with_siblings(up, cls), f"{name}{len(levels)}"))
        most = -(-most // FAN)
    return levels


def proofs(levels: list[DataFrame], cls: list[str], ends: DataFrame) -> DataFrame:
    """The lowest level with path, the (left, right) of each level up to the root of all, and what else ends holds.

    ends(cls, path, ...) has a row for each class: what comes behind its own top.
    """
    more = [c for c in ends.columns if c not in [*cls, "path"]]
    own = F.array(F.struct("left", "right"))
    above = None
    for i, level in reversed(list(enumerate(levels))):
        keep = [*cls, "pos", *more, "path"] if i else [*[c for c in level.columns if c not in ("left", "right", "n")], *more, "path"]
        out = level.where("n = 1").join(ends, cls).select(*keep)
        if above is not None:
            up = above.select(*cls, F.col("pos").alias("_up"), *more, F.col("path").alias("_path"))
            inner = level.where("n > 1").withColumn("_up", F.expr(f"pos div {FAN}")).join(up, [*cls, "_up"])
            out = inner.withColumn("path", F.concat(own, "_path")).select(*keep).unionByName(out)
        above = cut(out, "proofs") if i == 1 else out
    return above


def manifest(docs: DataFrame, modulus: int = 3) -> DataFrame:
    """documents -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The documents for whose id modulus divides crc32 are tampered with (A-Z lower-cased in the text) before folding.
    """
    text = F.col("text")
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == 0
    leaves = docs.select(
        "doc_id", F.isnotnull("lang").alias("known"), F.coalesce("lang", F.lit("")).alias("lang_"), leaf_hash(text).alias("h"), F.when(hit, leaf_hash(lower_latin(text))).alias("other")
    )
    cls = ["known", "lang_"]
    low = tree(positions(leaves, cls, ["doc_id", "h"], "leaves"), cls, "level")
    tops = low[0].where("n = 1").select(*cls, "h")
    for level in low[1:]:
        tops = tops.unionByName(level.where("n = 1").select(*cls, "h"))
    high = tree(positions(tops.withColumn("all", F.lit(0)), ["all"], cls, "subroots"), ["all"], "high")
    end = high[-1].where("n = 1").select("all", F.col("h").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    ends = cut(proofs(high, ["all"], end).select(*cls, F.col("h").alias("subroot"), "root", "path"), "ends")
    rows = proofs(low, cls, ends)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("other", "h"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
