"""Blocks and diffs against plain readings, and patches against the texts they were made from."""

import difflib
import random

from loomgraph.operators.patches import diff_lines, file_changes, patched, safe_target
from pyspark.sql import functions as F

ANSWER = """Here is the plan.
### FILE: `src/A.java` [CREATE]
Some words.
```java
class A {}
```
### FILE: src/B.java [MODIFY]
```diff
--- a/src/B.java
+++ b/src/B.java
@@ -1,2 +1,2 @@
 x
-y
+z
```
### FILE: src/C.ts [modify]
```ts
let c = 1;
```
And one more:
```diff
--- a/d.sql
+++ b/d.sql\t2024-01-01
@@ -3 +3 @@
-old
+new
```
```diff
no target here
```
```text
not a change
```
```java
never closed
"""


def test_changes_of_an_answer(spark):
    answers = spark.createDataFrame([(1, ANSWER), (2, None), (3, "no code"), (4, "### FILE: x.py [CREATE]\n")], "id long, text string")
    got = {(r["id"], r["path"]): (r["action"], r["body"]) for r in file_changes(answers).collect()}
    assert got == {
        (1, "src/A.java"): ("create", "class A {}\n"),
        (1, "src/B.java"): ("modify", "--- a/src/B.java\n+++ b/src/B.java\n@@ -1,2 +1,2 @@\n x\n-y\n+z\n"),
        (1, "src/C.ts"): ("create", "let c = 1;\n"),
        (1, "d.sql"): ("modify", "--- a/d.sql\n+++ b/d.sql\t2024-01-01\n@@ -3 +3 @@\n-old\n+new\n"),
    }


def test_lines_of_several_files(spark):
    """A removed line that looks like a header, a hunk without count, a note, an insertion, two files in one diff."""
    diff = "diff --git a/p b/p\nindex 1..2\n--- a/p\n+++ b/p\n@@ -1,3 +1,2 @@ fn\n a\n--- b\n-c\n+++ d\n\\ No newline at end of file\n@@ -9,0 +9,1 @@\n+i\n--- a/q\n+++ b/q\n@@ -2 +2 @@\n-x\n+y\nrest"
    got = sorted(diff_lines(spark.createDataFrame([("k", diff), ("n", None)], "id string, diff string")).select("path", "hunk", "no", "kind", "old_no", "new_no", "text").collect(), key=lambda r: r["no"])
    assert [tuple(r)[:2] + tuple(r)[3:] for r in got] == [
        ("p", 1, "context", 1, 1, "a"), ("p", 1, "remove", 2, None, "-- b"), ("p", 1, "remove", 3, None, "c"), ("p", 1, "add", None, 2, "++ d"),
        ("p", 2, "add", None, 9, "i"), ("q", 3, "remove", 2, None, "x"), ("q", 3, "add", None, 2, "y"),
    ]


def test_patches_give_the_new_texts(spark):
    """Random edits of several files, as unified diffs with few and no lines of context, in one text."""
    r = random.Random(11)
    old, new, diffs = {}, {}, []
    for k in range(14):
        a = [r.choice(["x", "y", "-- z", "++ w", "", "@ a"]) + str(r.randint(0, 9)) for _ in range(r.randint(0, 40))]
        b = [x for x in a if r.random() < 0.8]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), f"new{r.randint(0, 99)}")
        path = f"dir/f{k}.txt"
        # a text without lines has one empty line when split
        old[path], new[path] = "\n".join(["top", *a, "end"]), "\n".join(["top", *b, "end"])
        diffs.append("\n".join(difflib.unified_diff(old[path].split("\n"), new[path].split("\n"), f"a/{path}", f"b/{path}", lineterm="", n=k % 4)))
    lines = diff_lines(spark.createDataFrame([("all", "\n".join(d for d in diffs if d))], "id string, diff string"))
    files = spark.createDataFrame(list(old.items()) + [("other", "kept")], "path string, text string")
    got = {x["path"]: x["text"] for x in patched(files, lines).collect()}
    assert got == {p: t for p, t in new.items() if t != old[p]} and len(got) > 10


def test_targets_stay_below_their_root(spark):
    df = spark.createDataFrame([("a/src/x",), ("/b/y",), ("../z",), ("c/../../z",), ("a",), ("",), (None,)], "p string")
    assert [x[0] for x in df.select(safe_target(F.col("p"), F.lit("/r/"))).collect()] == ["/r/src/x", "/r/y", None, None, "/r/a", None, None]
