"""Code cut into methods, and windows of a vocabulary's tokens."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.operators.chunking import token_windows
from loomgraph.operators.pieces import code_pieces

JAVA = """package a;

import x.Y;

/** Class { with } braces. */
@Service
@RequestMapping(value = "/a{b}", method = { GET })
public class A extends B<C> {
    private static final String S = "} { /* no comment";
    private final Runnable r = () -> { run(); };

    public A(final X x) { this.x = x; go(x); }

    /* a block
       with } lines { */
    // and another }
    @Override
    public <T> List<T> two(
        @Named("q") String q,
        int n
    ) throws IOException, X {
        for (int i = 0; i < n; i++) { if (q.equals("{")) { return null; } }
        char c = '{';
        return list(q);
    }

    abstract int none(int x);
    int s() { return 12345678; }
    protected void three() {
        new Thread(new Runnable() {
            public void run() { }
        }).start();
    }

    enum Kind { ONE, TWO }
}
"""

SCRIPT = """import { a } from 'b';
@Component({
  selector: 'x',
})
export class P {
  constructor(private h: H) { this.h = h; }
  // one
  async load(id: number): Promise<X[]> {
    if (id > 1) {
      return this.h.get(`${id}{`);
    }
  }
  go = (x: number) => {
    while (true) { stop(); }
  };
}
export async function top(a = 1) {
  call(function () { return 1; });
}
export const arrow = async (a: string): Promise<void> => {
  await x(a);
};
"""


def pieces(spark, rows, **more):
    got = code_pieces(spark.createDataFrame(rows, "path string, text string"), **more).collect()
    return {p: sorted((r["idx"], r["method_name"], r["class_name"], r["content"]) for r in got if r["path"] == p) for p, _ in rows}


def test_methods_of_both_languages(spark):
    got = pieces(spark, [("A.java", JAVA), ("p.ts", SCRIPT)])
    assert [x[1] for x in got["A.java"]] == ["", "A", "two", "s", "three"]
    assert "".join(x[3] for x in got["A.java"]) == JAVA and {x[2] for x in got["A.java"]} == {"A"}
    assert got["A.java"][2][3].startswith("\n    /* a block") or got["A.java"][2][3].lstrip().startswith("/* a block")
    assert [x[1] for x in got["p.ts"]] == ["", "constructor", "load", "go", "top", "arrow"]
    assert "".join(x[3] for x in got["p.ts"]) == SCRIPT


def test_short_long_and_odd_texts(spark):
    long = "class L {\n  void a() {\n" + "    step();\n" * 400 + "  }\n  void bbbbbbbbbbbbbbbbbbbb() { }\n  void c(){}\n}\n"
    one = "class One {\n  void only() { }\n}\n"
    got = pieces(spark, [("L.java", long), ("One.java", one), ("n.java", None), ("e.ts", ""), ("x.sql", "select 1;"), ("bad.java", "}}}{{{ ( \"")])
    assert [x[1] for x in got["L.java"]] == ["", "a", "a", "a", "bbbbbbbbbbbbbbbbbbbb"] and [x[0] for x in got["L.java"]] == list(range(5))
    assert got["One.java"] == [(0, "", "One", one)] and got["x.sql"] == [(0, "", "", "select 1;")] and got["n.java"] == got["e.ts"] == []
    assert [x[3] for x in got["bad.java"]] == ["}}}{{{ ( \""]


def test_token_windows_equal_plain_windows(spark):
    r = random.Random(2)
    words = ["alpha", "Beta ", "\n\n", "été", "日本", "x1y2", "<|endoftext|>", "    ", "🙂"]
    texts = [None, "", "one", "".join(r.choice(words) for _ in range(100)), "".join(r.choice(words) + " " for _ in range(900)), "word " * 600, "word " * 601]
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    got = token_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for i, text in enumerate(texts):
        mine = sorted((x for x in got if x["doc_id"] == i), key=lambda x: x["idx"])
        if not text:
            assert mine == []
            continue
        n, at = len(plain.encode(text, add_special_tokens=False).ids), 0
        want = [n] if n <= 600 else []
        while n > 600:
            want.append(min(500, n - at))
            if at + 500 >= n:
                break
            at += 450
        assert [x["n_tokens"] for x in mine] == want
        rebuilt = ""
        for x in mine:
            assert text[x["start"] : x["start"] + len(x["content"])] == x["content"] and x["start"] <= len(rebuilt)
            rebuilt = rebuilt[: x["start"]] + x["content"]
        assert rebuilt == text
