"""Changes of files out of answers in prose: named blocks and unified diffs as rows, and their application.

A text becomes lines, and running sums over its lines tell where a block or hunk begins and whether a line is still inside:
a fence opens and closes by turns; a hunk lasts as long as the counts in its own header allow, so a removed `-- x` is not
taken for the next file. Only the lines of one text (or one file) meet. Null texts give no rows; a block that is never
closed and a diff without a target path are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How a change is announced, and how a hunk begins.
ANNOUNCED = r"(?i)###\s+FILE:\s*[`\"]?([^\s`\"]+)[`\"]?\s*\[?(create|modify)\b"
FENCE = r"^```(\w*)\s*$"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
TARGET = r"^\+\+\+\s+(?:b/)?([^\t]+)"


def _lines(texts: DataFrame, column: str) -> DataFrame:
    return texts.select("id", F.posexplode(F.split(column, r"\r?\n")).alias("no", "line"))


def _so_far() -> tuple:
    by_text = Window.partitionBy("id").orderBy("no")
    return by_text.rowsBetween(Window.unboundedPreceding, 0), by_text.rowsBetween(Window.unboundedPreceding, -1)


def file_changes(answers: DataFrame) -> DataFrame:
    """answers(id, text) -> id, block, path, action (create, modify), body.

    An announced file takes the next fenced block: a diff modifies it, anything else is its new content. Diffs that no
    announcement takes name their file themselves.
    """
    here, before = _so_far()
    fence = F.rlike("line", F.lit(FENCE))
    rows = _lines(answers, "text").withColumn("fences", F.sum(fence.cast("int")).over(here))
    # the n-th block is opened by fence 2n - 1 and closed by fence 2n
    rows = rows.withColumns({"block": ((F.col("fences") + 1) / 2).cast("int"), "inside": (F.col("fences") % 2 == 1) & ~fence})
    closed = rows.groupBy("id").agg((F.max("fences") / 2).cast("int").alias("closed"))
    told = rows.where("block > 0").groupBy("id", "block").agg(
        F.max(F.when(fence & (F.col("fences") % 2 == 1), F.lower(F.regexp_extract("line", FENCE, 1)))).alias("lang"),
        F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("no", "line")))).alias("x"),
    )
    blocks = told.join(closed, "id").where("block <= closed").select("id", "block", "lang", F.array_join(F.transform("x", lambda s: F.concat(s["line"], F.lit("\n"))), "").alias("body"))
    heads = rows.where(F.rlike("line", F.lit(ANNOUNCED))).select("id", (((F.col("fences") + 1) / 2).cast("int") + 1).alias("block"), "line")
    heads = heads.select("id", "block", F.regexp_extract("line", ANNOUNCED, 1).alias("path"), F.lower(F.regexp_extract("line", ANNOUNCED, 2)).alias("said"))
    named = blocks.join(heads, ["id", "block"], "left")
    own = F.regexp_extract("body", rf"(?m){TARGET}", 1)
    path = F.coalesce("path", F.when((F.col("lang") == "diff") & (own != ""), F.trim(own)))
    action = F.when((F.col("lang") == "diff") & F.coalesce(F.col("said") == "modify", F.lit(True)), "modify").otherwise("create")
    return named.select("id", "block", path.alias("path"), action.alias("action"), "body").where("path is not null")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diffs(id, diff), of one file or several -> id, path, hunk (from 1 in each diff), old_start, old_count, no, kind (context,
    add, remove), old_no, new_no, text; old_no or new_no is null where the line is not on that side."""
    here, before = _so_far()
    number = lambda g, other: F.coalesce(F.nullif(F.regexp_extract("line", HUNK, g), F.lit("")).cast("int"), F.lit(other))
    starts = F.rlike("line", F.lit(HUNK))
    head = F.when(starts, F.struct(number(1, 0).alias("old"), number(2, 1).alias("olds"), number(3, 0).alias("new"), number(4, 1).alias("news")))
    rows = _lines(diffs, "diff").withColumns({"hunk": F.sum(starts.cast("int")).over(here), "h": F.last(head, True).over(here)})
    first = F.substring("line", 1, 1)
    kind = F.when(starts | (first == "\\"), None).when(first == "+", "add").when(first == "-", "remove").otherwise("context")
    in_hunk = Window.partitionBy("id", "hunk").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(in_hunk), F.lit(0))
    rows = rows.withColumn("kind", kind).withColumns({"olds": seen("context", "remove"), "news": seen("context", "add")})
    inside = F.col("kind").isNotNull() & (F.col("hunk") > 0) & ((F.col("olds") < F.col("h.olds")) | (F.col("news") < F.col("h.news")))
    rows = rows.withColumn("inside", inside)
    target = F.when(~F.col("inside") & F.rlike("line", F.lit(TARGET)), F.trim(F.regexp_extract("line", TARGET, 1)))
    rows = rows.withColumn("path", F.last(target, True).over(before))
    at = lambda side, shown: F.when(F.col("kind").isin("context", shown), F.col(f"h.{side}") + F.col(f"{side}s"))
    marked = F.rlike("line", F.lit("^[-+ ]"))
    text = F.when(marked, F.expr("substring(line, 2)")).otherwise(F.col("line"))
    return rows.where("inside and path is not null").select(
        "id", "path", "hunk", F.col("h.old").alias("old_start"), F.col("h.olds").alias("old_count"), "no", "kind", at("old", "remove").alias("old_no"), at("new", "add").alias("new_no"), text.alias("text")
    )


def patched(files: DataFrame, lines: DataFrame) -> DataFrame:
    """files(path, text), rows of diff_lines for each path -> path, text with all hunks applied; files without hunks are left
    out. Hunks replace the lines that their headers name, counted in the old text; one that takes no line comes behind its
    start. The lines of one file meet in one row."""
    hunks = lines.select("path", "id", "hunk", "old_start", "old_count").distinct()
    taken = hunks.where("old_count > 0").select("path", F.explode(F.sequence("old_start", F.col("old_start") + F.col("old_count") - 1)).alias("n")).distinct()
    old = files.join(hunks.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    kept = old.join(taken, ["path", "n"], "left_anti").select("path", "n", F.lit(0).alias("after"), F.lit(0).alias("no"), "line")
    place = F.col("old_start"), F.when(F.col("old_count") == 0, 1).otherwise(0)
    new = lines.where("kind <> 'remove'").join(files.select("path"), "path", "left_semi").select("path", place[0].alias("n"), place[1].alias("after"), F.col("no").alias("no"), F.col("text").alias("line"))
    whole = kept.unionByName(new).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "after", "no", "line"))).alias("x"))
    out = hunks.select("path").distinct().join(files.select("path"), "path", "left_semi").join(whole, "path", "left")
    return out.select("path", F.coalesce(F.array_join(F.transform("x", lambda s: s["line"]), "\n"), F.lit("")).alias("text"))


def safe_target(path: Column, root: Column) -> Column:
    """The path below root, without the sides' prefixes; null for one that leaves it."""
    clean = F.regexp_replace(F.regexp_replace(path, "^/+", ""), "^[ab]/", "")
    return F.when(~F.rlike(clean, F.lit(r"(?:^|/)\.\.(?:/|$)")) & (clean != ""), F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), clean))
