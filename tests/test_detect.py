"""Lexing, masks, the sweep, reports and governance on small inputs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from echotrace.functions import governance as G
from echotrace.functions.lexer import NAME, STRING, fingerprint, functions, imports, lex
from echotrace.functions.report import FORMATS, render
from echotrace.operators.labels import smallest_labels
from echotrace.operators.matching import greedy_matching
from echotrace.plans.deadcode import dead_functions
from echotrace.plans.detect import dedup_overlapping, exact_clones, sweep

# Two programs of different shape.
HARVEST = '''def harvest_totals(stations, since):
    totals = {}
    for station in stations:
        if station.closed or station.opened < since:
            continue
        wet = sum(r.amount for r in station.readings if r.kind == 2)
        dry = max([0] + [r.gap for r in station.readings])
        totals[station.code] = (wet * 10, dry)
    totals["all"] = tuple(map(sum, zip(*totals.values())))
    return totals
'''
KETTLE = '''class Kettle:
    def boil(self, litres, degrees=20):
        while degrees < 100:
            degrees += self.power // (litres * 4)
            if self.lid is None and degrees > 90:
                raise RuntimeError("open lid")
        self.count -= 1
        return [degrees, self.count]
'''


def words(src, lang):
    return [t.text or t.orig for t in lex(src, lang)]


def fnv(tokens):
    h = 0xCBF29CE484222325
    for kind, text in tokens:
        for b in bytes((kind,)) + text.encode() + b"\0":
            h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def test_fingerprint():
    # Kinds: 0 keyword, 1 name, 2 number, 3 string, 4 operator; only keywords and operators keep their text.
    by_hand = [(0, "if"), (1, ""), (4, "."), (1, ""), (4, ">="), (2, ""), (4, ":"), (0, "return"), (3, ""), (4, "+"), (1, "")]
    assert fingerprint(lex('if a.size >= 10:\n    return "x" + b', "python")) == fnv(by_hand)
    assert fingerprint(lex("if q.n >= 7: return '' + zz", "python")) == fnv(by_hand)
    assert fingerprint(lex(HARVEST, "python")) == fingerprint(lex(HARVEST.replace("wet", "rain"), "python")) != fingerprint(lex(KETTLE, "python"))


@pytest.mark.parametrize(
    "lang,src,want",
    [
        ("javascript", "a = b / c / d", ["a", "=", "b", "/", "c", "/", "d"]),
        ("javascript", "x = /a[/]b/g.test(y)", ["x", "=", "/a[/]b/g", ".", "test", "(", "y", ")"]),
        ("rust", "fn f<'a>() { 'b' }", ["fn", "f", "<", "'", "a", ">", "(", ")", "{", "'b'", "}"]),
        ("lua", "--[[ x\ny ]] a -- b\nc", ["a", "c"]),
        ("csharp", '@"a""b" $"c"', ['@"a""b"', '$"c"']),
        ("go", "a := 1 // c\n/* d */ b", ["a", ":=", "1", "b"]),
        ("sql", "SELECT a -- b\n/* c */ FROM d", ["SELECT", "a", "FROM", "d"]),
        ("python", "x = 1e-5", ["x", "=", "1e", "-", "5"]),
        ("", "a # b", ["a", "#", "b"]),
    ],
)
def test_lex(lang, src, want):
    assert words(src, lang) == want


def test_lex_lines_and_odd_input():
    t = lex('a = """x\ny"""\nb', "python")
    assert [(x.line, x.end_line) for x in t] == [(1, 1), (1, 1), (1, 2), (3, 3)]
    t = lex("cat <<EOF\nhi there\nEOF\nls", "shell")
    assert [x.kind for x in t if x.kind == STRING] == [STRING] and t[-1].orig == "ls" and t[-1].line == 4
    assert lex(None, "go") == [] and lex("", "go") == []
    for lang in ("go", "python", "ruby", "javascript", "rust", "php", "csharp"):
        for s in ('"', "'", "/*", "`", '"""', "<<A\n", "\x00\xff", "é", "/", "@\""):
            lex(s, lang)
    rnd = random.Random(0)
    for lang in ("ruby", "shell", "typescript", "lua", "sql", "elixir", "java"):
        src = "".join(rnd.choice("ab1'\"`/*#<>{}()\n -=:;do end if \\") for _ in range(3000))
        tokens = lex(src, lang)
        for a, b, _ in functions(tokens, lang):
            assert 0 <= a <= b < len(tokens)


@pytest.mark.parametrize(
    "lang,src,names",
    [
        ("go", "package a\nfunc (s *T) Foo(a int) int {\n return 1 }\nfunc bar() { }\n func baz() { x() }", ["Foo", "baz"]),
        ("javascript", "const f = (a) => { return 1 }\nclass X { foo(a) { if (a) { b() } } }\nif (x) { y() }", ["f", "foo"]),
        ("java", "class A { int f(int a) { return a; } void g() { h(); } }", ["f", "g"]),
        ("ruby", "def a(x)\n  y if z\n  w.each do |q| q end\nend\ndef b\n 1\nend", ["a", "b"]),
        ("lua", "function a.b(x) if x then return 1 end end", ["a.b"]),
        ("python", "def a():\n    x = 1\n\n\ndef b():\n    y()\n", ["a", "b"]),
        ("sql", "CREATE FUNCTION f() RETURNS int BEGIN RETURN CASE WHEN 1 THEN 2 END; END", ["f"]),
        ("shell", "f() { ls; }", ["f"]),
        ("elixir", "def f(x) do\n x\nend", ["f"]),
        ("r", "f <- function(x) { x }", ["f"]),
    ],
)
def test_functions(lang, src, names):
    assert [n for _, _, n in functions(lex(src, lang), lang) if n] == names


def kept(src, lang):
    t = lex(src, lang)
    return [x.text + x.orig for x, i in zip(t, imports(t, lang, [False] * len(t))) if not i]


def test_imports():
    assert kept('package a\nimport (\n "x"\n "y"\n)\nvar b = 1\n', "go") == ["var", "b", "=", "1"]
    assert kept("import a; foo(x)\nfrom b import (c,\n d)\ne", "python") == ["foo", "(", "x", ")", "e"]
    assert kept("mod a;\nmod b { fn f() {} }\nuse c::{d,\n e};", "rust") == ["mod", "b", "{", "fn", "f", "(", ")", "{", "}", "}"]
    assert kept("#include <a>\n#define B 1\nusing namespace std;\nusing x = int;", "cpp") == ["#", "define", "B", "1", "using", "x", "=", "int", ";"]
    assert kept("namespace A;\nusing B;\nnamespace C {\n}", "csharp") == ["namespace", "C", "{", "}"]
    assert kept("pub use a;\nexport x", "rust") == ["export", "x"] and kept("a\nb", "none") == ["a", "b"]


def test_masks():
    from echotrace.functions.masks import masks, table_at

    src = "package a\nfunc T() {\n rows := []struct{ n int; f func() }{\n {1, func() { g(); h() }},\n {2, nil},\n }\n x := m[k]\n y := map[string]int{\"a\": 1}\n}\n"
    t = lex(src, "go")
    m = masks(t, "go", src)
    assert [(t[a].text, t[b].text) for a, b in m.tables] == [("[", "}"), ("map", "}")] and len(m.code_in_tables) == 1
    a, b = m.tables[0]
    assert table_at(m, b - 6, 5) == 0 and table_at(m, a, b - a + 1) == -1 and table_at(m, 0, 3) == -1
    for lang, code, n in (("python", "def f():\n    a = [1, [2]]\n    b = c[0]\n    d = {1: 2}\n", 2), ("rust", "fn f() { let a = vec![1]; b[0]; }", 1), ("java", "class A { int[] a = {1}; }", 0), ("lua", "x = {1, {2}}", 1), ("", "[1]", 0)):
        assert len(masks(lex(code, lang), lang, code).tables) == n
    js = "const es = { a: 'b' }\nfunction f() { g({ c: 1 }) }\nexport default { d: 2 }"
    t = lex(js, "javascript")
    assert len(masks(t, "javascript", js).objects) == 2
    java = "class A { int x = 1; int f(int a) throws E, F { return a; } enum B { C } Runnable r = () -> { go(); }; }"
    t = lex(java, "java")
    m = masks(t, "java", java)
    assert {x.text + x.orig for x, l in zip(t, m.logic) if l} == {"return", "a", ";", "go", "(", ")"} and all(m.inside[3:-1])
    py = "# tool:ignore\ndef f():\n    a = 1\n    b = 2\n\n\ndef g():\n    c = 3\n"
    t = lex(py, "python")
    m = masks(t, "python", py)
    assert {x.orig for x, i in zip(t, m.ignored) if i and x.orig} == {"a", "1", "b", "2"} and {x.orig for x, i in zip(t, m.inside) if i and x.orig} == {"c", "3"}
    assert masks([], "go", None).spans == [] and not any(masks(t, "python", py.replace("# tool", "x = 1 # tool")).ignored)


def files_df(spark, texts, k):
    rows = [(i, 0, p, t, k) for i, (p, t) in enumerate(sorted(texts.items(), key=lambda x: x[0].split("/")))]
    return spark.createDataFrame(rows, "file_id int, run_id int, path string, text string, k int")


def test_exact_clones(spark):
    texts = {"tests/test_a.py": KETTLE + "\ndef test_a():\n    assert True\n", "src/app.py": "import x\n\n" + KETTLE + "\n\n" + HARVEST, "src/other.py": HARVEST, "db/v/001.py": HARVEST.replace("wet", "rain"), "e.py": "", "n.py": None}
    df = files_df(spark, texts, 60).withColumn("hash", F.lit("x"))
    got = {r.hash: r for r in exact_clones(df).collect()}
    whole = got[fingerprint(lex(HARVEST, "python"))]
    assert (whole.token_count, whole.line_count, whole.clone_type) == (len(lex(HARVEST, "python")), 10, "type-2")
    assert [(i.path, i.start_line, i.end_line, i.function) for i in whole.instances] == [("db/v/001.py", 1, 10, "harvest_totals"), ("src/app.py", 13, 22, "harvest_totals"), ("src/other.py", 1, 10, "harvest_totals")]
    boil = next(r for h, r in got.items() if r is not whole)
    assert len(got) == 2 and boil.clone_type == "type-1" and [(i.path, i.function) for i in boil.instances] == [("src/app.py", "boil"), ("tests/test_a.py", "boil")]
    assert exact_clones(files_df(spark, {"a.py": "x = 1"}, 50)).count() == 0 and exact_clones(df.limit(0)).count() == 0
    assert exact_clones(df, in_scope=df.where("path = 'e.py'")).count() == 0 and exact_clones(df, in_scope=df.where("path like 'tests/%'")).count() == 1


def test_rows_of_one_table_are_no_clone(spark):
    row = '        {{"name": "{0}", "size": {1}, "tags": ["a", "{0}"], "next": None, "level": {1} + 2}},\n'
    table = "def test_cases():\n    cases = [\n" + "".join(row.format(f"n{i}", i) for i in range(12)) + "    ]\n    return cases\n"
    assert exact_clones(files_df(spark, {"a.py": table}, 40)).count() == 0
    assert exact_clones(files_df(spark, {"a.py": table, "b.py": table}, 40)).count() >= 1
    marked = "# echotrace:ignore\n" + HARVEST
    assert exact_clones(files_df(spark, {"a.py": marked, "b.py": HARVEST}, 50)).count() == 0


def test_files_spanned_by_many_copies_are_swept_fast():
    n, k = 400, 5
    rows = pd.DataFrame([(f, p, p % 50, k) for f in range(n) for p in range(100)], columns=["file_id", "pos", "h", "k"])
    assert sum(len(s) for _, s in sweep(rows)) == n


def test_sweep_by_part_equals_sweep_of_all(spark):
    rnd = random.Random(4)
    for _ in range(15):
        rows = [(f, p, rnd.randrange(12)) for f in range(4) for p in range(25) if rnd.random() < 0.8]
        df = pd.DataFrame(rows, columns=["file_id", "pos", "h"])
        df = df[df.groupby("h")["h"].transform("size") > 1].assign(k=3)
        df["path_order"] = df["file_id"].map(lambda f: (str(f),))
        whole = sorted(sweep(df))
        df = df.sort_values(["file_id", "pos"]).reset_index(drop=True)
        run = ((df["file_id"] != df["file_id"].shift()) | (df["pos"] != df["pos"].shift() + 1)).cumsum()
        parent = {r: r for r in run.unique()}
        find = lambda x: x if parent[x] == x else find(parent[x])  # noqa: B023,E731
        for _, g in df.groupby("h"):
            ids = run[g.index].tolist()
            for b in ids[1:]:
                parent[find(b)] = find(ids[0])
        parts = [c for _, g in df.groupby(run.map(find)) for c in sweep(g)]
        assert sorted(parts) == whole


def test_labels_and_matching(spark):
    rnd = random.Random(9)
    e = [(i, i + 1) for i in range(50)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(None, 1)]
    got = {r.id: r.label for r in smallest_labels(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[a] == got[b] for a, b in e if a is not None)
    pairs = [(rnd.randrange(40), rnd.randrange(40), rnd.choice([0.7, 0.8, 0.9, None])) for _ in range(120)] + [(None, 1, 0.9), (3, 3, 1.0)]
    best = {}
    for a, b, s in pairs:
        if None not in (a, b, s) and a != b:
            best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0))
    used, want = set(), set()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b, s))
    assert {tuple(r) for r in greedy_matching(spark.createDataFrame(pairs, "a bigint, b bigint, score double")).collect()} == want
    assert greedy_matching(spark.createDataFrame([], "a bigint, b bigint, score double")).count() == 0


def test_dedup(spark):
    t = "key int, hash string, line_count int, instances array<struct<file_id:string,start_line:int,end_line:int>>"
    rows = [(1, "a", 20, [("f", 1, 20), ("g", 1, 20)]), (2, "b", 10, [("f", 5, 14), ("g", 5, 14)]), (3, "c", 10, [("f", 18, 27), ("g", 18, 27)]), (4, "d", 9, [("f", 5, 13), ("h", 5, 13)])]
    assert sorted(r.key for r in dedup_overlapping(spark.createDataFrame(rows, t), "key").collect()) == [1, 3, 4]


def test_dead_functions(spark):
    texts = {"a/x.go": "package a\nfunc used() { y() }\nfunc Lost() { z() }\nfunc main() { used() }\nfunc loop() { loop() }", "b/y.go": "package b\nfunc other() { Lost2() }\n"}
    got = {(r.name, r.confidence) for r in dead_functions(files_df(spark, texts, 50)).collect()}
    assert got == {("Lost", "low"), ("loop", "high"), ("other", "high")}


def test_dead_members_and_scopes(spark):
    texts = {
        "a.js": "import x from 'y';\nclass P { gone() { q() } get size() { return 1 } constructor() { this.kept() } kept() { r() } }\nclass Q extends P { render() { s() } }\nconst lone = (a) => { return a }\nexport const open = () => { t() }\nfoo(function named() { u() })\n",
        "A.java": "class A { @Override public void run() { a(); } private void hidden() { b(); } void readObject() { c(); } }",
        "lib/x.rs": "fn below() { a() }\nfn unseen() { b() }\npub fn seen() { c() }", "lib/sub/y.rs": "fn d() { below() }\npub fn e() { d() }", "z.rs": "pub fn f() { unseen(); seen(); e(); f() }",
        "s.c": "static int local(int a) { return a; }\nstatic int lost(int a) { return a; }", "t.c": '#include "s.c"\nint main(void) { return local(1); }',
    }
    df = files_df(spark, texts, 50)
    got = {(r.path, r.name, r.confidence) for r in dead_functions(df).collect()}
    assert got == {("a.js", "gone", "low"), ("a.js", "lone", "high"), ("a.js", "open", "low"), ("A.java", "hidden", "high"), ("lib/x.rs", "unseen", "high"), ("z.rs", "f", "low"), ("s.c", "lost", "low")}
    universe = files_df(spark, {**texts, "b.js": "p.gone(); open()"}, 50)
    less = {(r.path, r.name) for r in dead_functions(df, universe, spark.createDataFrame([(0, "f"), (0, "hidden")], "run_id int, name string")).collect()}
    assert {(p, n) for p, n, _ in got} - less == {("a.js", "gone"), ("a.js", "open"), ("z.rs", "f")}


REPORT = {
    "total_files": 2, "scanned_files": 2, "total_clones": 1, "total_lines": 40, "duplicate_lines": 20, "duplication_pct": 50.0, "saved_lines": 10,
    "file_stats": [{"file": "a<b>.go", "total_lines": 20, "duplicate_lines": 10, "duplication_pct": 50.0}],
    "clones": [{"hash": "00ff", "type": "type-1", "similarity": 1.0, "line_count": 10, "token_count": 60, "saved_lines": 10, "scope": "cross-file", "instances": [{"file": "a:b,c%.go", "start_line": 1, "end_line": 10, "lines": ["x"]}, {"file": "b_test.go", "start_line": 2, "end_line": 11, "is_test": True}]}],
    "dead_functions": [{"file": "a.go", "line": 3, "name": "f", "confidence": "high"}],
}


def test_reports():
    for f in FORMATS:
        assert "a" in render(REPORT, f)
    assert "file=a%3Ab%2Cc%25.go,line=1" in render(REPORT, "github")
    j = render(REPORT, "json")
    assert '"duplication_pct": 50,' in j and "a\\u003cb\\u003e.go" in j
    assert '"DUPE002"' in render(REPORT, "sarif")
    with pytest.raises(ValueError):
        render(REPORT, "xml")


def test_governance():
    rules = G.parse_ignore("# c\nabcdef12\nsrc/a.go:3-9\n**/gen/** # x\n\n")
    assert [bool(r.prefix) for r in rules] == [True, False, False]
    c = {"hash": "0", "instances": [{"file": "x/src/a.go", "start_line": 9, "end_line": 12}]}
    assert G.is_suppressed(c, rules) and not G.is_suppressed({"hash": "1", "instances": []}, rules)
    text = G.write_baseline([c, {**c, "suppressed": True, "hash": "s"}], 50)
    assert G.read_baseline(text) == {"0": 1} and G.mark_known([c], {"0": 1}) == (1, 0) and G.mark_known([c], {}) == (0, 1)
    with pytest.raises(ValueError):
        G.read_baseline('{"version": 2}')
    r = G.parse_rules([{"name": "t", "paths": ["**/*_test.py"], "min-tokens": 25}, {"name": "s", "paths": ["gen/**"], "skip": True}])
    assert G.rule_for("a_test.py", r).name == "t" and G.rule_for("x/a_test.py", r).name == "t" and G.rule_for("gen/x", r).skip and G.rule_for("q", r) is None
    for bad in ({"name": "x"}, {"name": "x", "paths": ["a"], "min-tokens": 0}, {"name": "x", "paths": ["a"], "similarity": 2}, {"name": "x", "paths": ["a"], "what": 1}):
        with pytest.raises(ValueError, match="x"):
            G.parse_rules([bad])
    assert G.parse_hunks("@@ -1,3 +4,2 @@ f\n@@ -9 +7 @@\n@@ -1 +0,0 @@\n") == [(4, 5), (7, 7)]
    with pytest.raises(ValueError):
        G.resolve_ref(".", "-x")


def test_scan_command(tmp_path, spark, capsys):
    from echotrace.cli import main

    for name, text in {"src/app.py": HARVEST, "src/other.py": HARVEST, "vendor/x.py": HARVEST, "bin.py": "a\x00b", "note.txt": HARVEST}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert main(["scan", "-p", str(tmp_path), "-f", "json", "--write-baseline", str(tmp_path / "base.json"), "--dead-code"]) == 1
    out = capsys.readouterr().out
    assert fingerprint(lex(HARVEST, "python")) in out and '"total_lines": 20' in out and "vendor" not in out
    assert main(["scan", "-p", str(tmp_path), "--baseline", str(tmp_path / "base.json"), "-o", str(tmp_path / "o.txt")]) == 0
    assert main(["scan", "-p", str(tmp_path / "none")]) == 2


def test_fuzzy_clones(spark):
    from echotrace.plans.fuzzy import fuzzy_clones, mini_width

    assert [mini_width(k) for k in (1, 12, 50)] == [2, 4, 17]
    body = "func a(x int) int {{\n y := x + 1\n z := y * 2\n {}\n for i := 0; i < z; i++ {{\n  y += call(i)\n  z -= other(y)\n }}\n return y + z\n}}\n"
    texts = {"a.go": "package a\n" + body.format("w := first(z)"), "b.go": "package b\n" + body.format("w := second(z)"), "c.go": "package c\nfunc q() { for { } }\n", "d.go": None}
    df = files_df(spark, texts, 30)
    got = fuzzy_clones(df, None, 0.5).collect()
    assert got and all(r.clone_type == "type-3" and len(r.instances) == 2 and 0.5 <= r.similarity < 1 for r in got)
    used = [(i.path, r.clone) for r in got for i in r.instances]
    assert {p for p, _ in used} == {"a.go", "b.go"}
    assert fuzzy_clones(df, None, 1.0).count() == 0 and fuzzy_clones(files_df(spark, texts, 9), None, 0.5).count() == 0
