"""Source code cut into its methods, by a scan of lines.

Strings and comments are taken out of each line, and running sums of braces give its depth. A new unit begins where, inside a
type or outside everything, the code before has ended in `;`, `{` or `}`; blank lines, comments and annotations above a member
so belong to it. A unit with a parameter list before its opening brace is a method. What lies between methods stays with the
method before; what lies before the first one is the head. Only the lines of one file meet; code on a single line is not
divided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunking import char_chunks

# Words before parentheses that begin no method.
NO_METHODS = ["if", "for", "while", "switch", "catch", "try", "synchronized", "return", "new", "function", "else", "do", "with", "throw"]
_LITERAL = r"\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`"
_PARAMS = r"\((?:[^(){}]|\([^(){}]*\))*+\)"
_MARK = r"@\w+(?:\.\w+)*(?:\s*\((?:[^()]|\([^()]*\))*+\))?"


def _units(files: DataFrame) -> DataFrame:
    """path, unit, depth, code (without strings and comments), text of each unit."""
    lines = files.where("text <> ''").select("path", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", _LITERAL, '""'), r"/\*.*?\*/", ""), r"(?<!\*)//.*$", "")
    lines = lines.withColumn("c", c)
    opens, closes = F.contains("c", F.lit("/*")), F.contains("c", F.lit("*/"))
    by_file = Window.partitionBy("path").orderBy("no")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(opens.cast("int") - closes.cast("int")).over(before), F.lit(0)) > 0
    code = F.when(inside & ~closes, "").when(inside, F.regexp_extract("c", r"\*/(.*)$", 1)).otherwise(F.regexp_replace("c", r"/\*.*$", ""))
    lines = lines.select("path", "no", "line", F.trim(code).alias("code"))
    count = lambda b: F.length("code") - F.length(F.replace("code", F.lit(b), F.lit("")))
    depth = F.coalesce(F.sum(count("{") - count("}")).over(before), F.lit(0))
    ended = F.lag(F.rlike("code", F.lit(r"[;{}]$"))).over(by_file)
    lines = lines.withColumns({"depth": depth, "starts": F.coalesce(ended, F.lit(True))})
    lines = lines.withColumn("unit", F.sum((F.col("starts") & (F.col("depth") <= 1)).cast("int")).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    each = lines.groupBy("path", "unit").agg(F.min("depth").alias("least"), F.min_by("depth", "no").alias("depth"), F.array_sort(F.collect_list(F.struct("no", "line", "code"))).alias("x"))
    return each.select("path", "unit", "depth", F.array_join(F.transform("x", lambda s: s["code"]), " ").alias("code"), F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def _named(head: Column, script: Column) -> Column:
    """The method that a unit's head declares, else null."""
    java = F.regexp_extract(head, rf"^[^=]*?(\w+)\s*{_PARAMS}\s*(?:throws\s+[\w.,\s]+)?$", 1)
    method = F.regexp_extract(head, rf"(\w+)\s*(?:<[^<>]*>)?\s*{_PARAMS}\s*(?::\s*[^=(){{}}]+)?$", 1)
    arrow = F.regexp_extract(head, r"(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>$", 1)
    function = F.regexp_extract(head, r"\bfunction\s*\*?\s*(\w+)", 1)
    named = F.when(~script, java).when(function != "", function).when(arrow != "", arrow).otherwise(method)
    return F.when((named != "") & ~named.isin(NO_METHODS), named)


def _methods(files: DataFrame) -> DataFrame:
    """Units with their order, the class (cls) and method that they declare, and text."""
    script = F.endswith("path", F.lit(".ts"))
    head = F.regexp_extract(F.regexp_replace("code", _MARK, " "), r"^([^{]*)\{", 1)
    units = _units(files).withColumn("head", F.trim(F.regexp_replace(head, r"\s+", " ")))
    kind = F.regexp_extract("head", r"\b(?:class|interface|enum|record)\s+(\w+)", 1)
    allowed = F.when(script, F.col("depth") <= 1).otherwise(F.col("depth") == 1)
    return units.withColumn("cls", F.nullif(kind, F.lit(""))).withColumn("method", F.when(F.col("cls").isNull() & allowed, _named(F.col("head"), script)))


def method_texts(files: DataFrame) -> DataFrame:
    """files(path, text) -> path, class_name, method_name, no (its place in the file), text: each method of Java and script files,
    with what stands above it, however few there are."""
    order = Window.partitionBy("path").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    units = _methods(files.where(F.rlike("path", F.lit(r"\.(?:java|ts)$")))).withColumn("class_name", F.last("cls", True).over(order))
    return units.where("method is not null").select("path", "class_name", F.col("method").alias("method_name"), F.col("unit").alias("no"), "text")


def body(text: Column) -> Column:
    """A method's text from its opening brace on; braces in comments, strings and parentheses are passed over."""
    string = r"\"(?:[^\"\\]|\\.)*+\""
    above = rf"^(?:/\*(?:[^*]|\*(?!/))*+\*/|\((?:[^()\"]|{string}|\([^()]*\))*+\)|{string}|[^{{\"(/]|/(?!\*))*+(?=\{{)"
    return F.regexp_replace(F.regexp_replace(text, above, ""), r"\s+$", "")


def code_pieces(files: DataFrame, split: Callable[[DataFrame], DataFrame] = char_chunks) -> DataFrame:
    """files(path, text) -> path, idx, content, class_name, method_name.

    Java and script files of two methods or more give their head whole, and each method of more than twenty characters, long
    ones divided by `split` (doc_id, text -> doc_id, idx, content); other texts are divided by `split` only.
    """
    script = F.endswith("path", F.lit(".ts"))
    units = _methods(files.where(F.endswith("path", F.lit(".java")) | script))
    order = Window.partitionBy("path").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumns({"seg": F.count("method").over(order), "cls": F.last("cls", True).over(order)})
    last = F.max("unit").over(Window.partitionBy("path"))
    units = units.withColumn("text", F.when(F.col("unit") < last, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    segs = units.groupBy("path", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda s: s["text"]), "").alias("text"), F.min_by("cls", "unit").alias("own"), F.min_by("method", "unit").alias("method"), F.max_by("cls", "unit").alias("to"))
    # the head may declare the class that its methods lie in
    segs = segs.withColumns({"cls": F.when(F.col("seg") == 0, F.col("to")).otherwise(F.col("own")), "kept": F.when(F.col("seg") == 0, F.trim(F.regexp_replace("text", r"\s+", " ")) != "").otherwise(F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))) > 20)})
    every = Window.partitionBy("path")
    segs = segs.withColumns({"methods": F.max("seg").over(every), "any": F.max("kept").over(every)})
    cut = segs.where((F.col("methods") >= 2) & F.col("any"))
    name = lambda seg, cls, method: F.struct(F.col("path").alias("path"), seg.alias("seg"), cls.alias("cls"), method.alias("method")).alias("doc_id")
    heads = cut.where("seg = 0 and kept").select(name(F.col("seg"), F.col("cls"), F.col("method")), F.lit(0).alias("idx"), F.col("text").alias("content"))
    methods = cut.where("seg > 0 and kept").select(name(F.col("seg"), F.col("cls"), F.col("method")), "text")
    none = F.lit(None).cast("string")
    plain = segs.where((F.col("methods") < 2) | ~F.col("any")).groupBy("path").agg(F.max_by("to", "seg").alias("cls")).withColumn("coded", F.lit(True))
    rest = files.where("text <> ''").join(plain, "path", "left").where(F.col("coded") | ~(F.endswith("path", F.lit(".java")) | script))
    rest = rest.select(name(F.lit(0).cast("long"), F.col("cls"), none), "text")
    pieces = heads.unionByName(split(methods.unionByName(rest)).select("doc_id", F.col("idx").cast("int").alias("idx"), "content"))
    nth = F.row_number().over(Window.partitionBy("doc_id.path").orderBy("doc_id.seg", "idx")) - 1
    return pieces.select("doc_id.path", nth.alias("idx"), "content", F.coalesce("doc_id.cls", F.lit("")).alias("class_name"), F.coalesce("doc_id.method", F.lit("")).alias("method_name"))
