"""The command line on small trees: rules, references, previews, generated files, configuration."""

import json
import subprocess

import pytest

from echotrace.cli import main, parser, scan, settle
from echotrace.functions import config as C
from echotrace.functions import governance as G

BODY = """def {name}(rows, limit):
    kept = []
    for row in rows:
        if row.weight > limit and not row.hidden:
            kept.append((row.code, row.weight * 3))
        elif row.weight == 0:
            raise ValueError("empty row %s" % row.code)
    kept.sort(key=lambda pair: pair[1])
    {mark} = sum(w for _, w in kept)
    return kept, {mark}
"""


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def report(spark, *args):
    return scan(spark, settle(parser().parse_args(["scan", *map(str, args)])))


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@x", *args], check=True, capture_output=True)


def test_scan_fills_tests_previews_and_generated(tmp_path, spark):
    body = BODY.format(name="weigh", mark="total")
    write(tmp_path, {"src/a.py": body, "src/test_b.py": body, "gen/x_pb2.py": body, "gen/y.py": "# Code generated by q. DO NOT EDIT.\n" + body, "m.min.js": "x"})
    r = report(spark, "-p", tmp_path, "--no-rules")
    assert r["total_clones"] == 1 and r["skipped_files"] == 3 and r["scanned_files"] == 2 and "partial" not in r
    (c,) = r["clones"]
    assert [(i["file"], i.get("is_test", False), i["function"]) for i in c["instances"]] == [("src/a.py", False, "weigh"), ("src/test_b.py", True, "weigh")]
    assert c["instances"][0]["lines"][0] == "def weigh(rows, limit):"
    from echotrace.functions.report import render

    assert '"DUPE002"' in render(r, "sarif") and "def weigh" in render(r, "md") and "Test and production" in render(r, "text")
    assert len(report(spark, "-p", tmp_path, "--no-rules", "--scan-generated")["clones"][0]["instances"]) == 4
    one = report(spark, "-p", tmp_path / "src" / "a.py", "--no-rules")
    assert one["scanned_files"] == 1 and one["total_clones"] == 0


def test_since_and_staged_from_a_subfolder(tmp_path, spark):
    a, b = BODY.format(name="weigh", mark="total"), BODY.format(name="other", mark="rest")
    write(tmp_path, {"sub/a.py": a, "sub/b.py": a, "top.py": "x = 1\n"})
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "one")
    write(tmp_path, {"sub/c.py": "import q\n" + b.replace("weight", "mass"), "sub/d.py": b.replace("weight", "mass")})
    git(tmp_path, "add", "sub/c.py", "sub/d.py")
    assert G.staged_files(str(tmp_path / "sub")) == ["c.py", "d.py"]
    git(tmp_path, "commit", "-qm", "two")
    assert set(G.changed_lines(str(tmp_path / "sub"), "HEAD~1")) == {"c.py", "d.py"}
    assert set(G.changed_lines(str(tmp_path), "HEAD~1")) == {"sub/c.py", "sub/d.py"}
    assert G.changed_lines(str(tmp_path / "sub" / "c.py"), "HEAD~1") == {"c.py": [(1, 11)]}
    r = report(spark, "-p", tmp_path / "sub", "--since", "HEAD~1", "--no-rules", "--git-churn")
    assert r["clones"] and all({"c.py", "d.py"} & {i["file"] for i in c["instances"]} for c in r["clones"]) and r["clones"][0]["churn"] >= 2
    assert report(spark, "-p", tmp_path / "sub", "--since", "HEAD", "--no-rules")["total_clones"] == 0


def test_rules_have_a_pass_each(tmp_path, spark):
    small = "def s{n}(a):\n    b = [x * 2 for x in a if x]\n    c = dict(zip(b, a))\n    d = max(c) - min(c)\n    return b, c, d\n"
    write(tmp_path, {"tests/a.py": small.format(n=1), "tests/b.py": small.format(n=2), "prod/a.py": small.format(n=3), "skip/a.py": small.format(n=4), "skip/b.py": small.format(n=5)})
    conf = tmp_path / "c.yml"
    conf.write_text('scan:\n  min-tokens: 70\nrules:\n  - name: tests\n    paths: ["**/tests/**"]\n    min-tokens: 30\n  - paths: ["skip/**"]\n    skip: true\n')
    r = report(spark, "-p", tmp_path, "-c", conf, "--min-clone-lines", 3)
    assert [(c["rule"], c["rule_min_tokens"], sorted(i["file"] for i in c["instances"])) for c in r["clones"]] == [("tests", 30, ["tests/a.py", "tests/b.py"])]
    r = report(spark, "-p", tmp_path, "-c", conf, "--no-rules", "-t", 30, "--min-clone-lines", 3)
    assert len(r["clones"][0]["instances"]) == 5


def test_caps_are_reported(tmp_path, spark):
    near = "def f(a, b):\n    x = a + b\n    y = call(x, b)\n    for i in range(y):\n        x {o}= other(i, a)\n        y -= third(x)\n        z = fourth(y, x)\n        use(z, {o2} y)\n        w = fifth(z, y)\n        keep(w, x)\n    return last(y, x)\n"
    ops = ["+", "-", "*", "/", "%"]
    write(tmp_path, {f"m{n}.py": near.format(o=o, o2="-~" [: n % 2 + 1] * (n + 1)) for n, o in enumerate(ops)})
    full = report(spark, "-p", tmp_path, "--no-rules", "-t", 30, "--similarity", 0.5, "--min-clone-lines", 2)
    cut = report(spark, "-p", tmp_path, "--no-rules", "-t", 30, "--similarity", 0.5, "--min-clone-lines", 2, "--max-bucket", 2)
    assert "partial" not in full and cut["partial"] and "--max-bucket" in cut["partial_reason"]
    cut = report(spark, "-p", tmp_path, "--no-rules", "-t", 30, "--similarity", 0.5, "--max-pairs", 1)
    assert "--max-pairs" in cut["partial_reason"]
    cut = report(spark, "-p", tmp_path, "--no-rules", "-t", 30, "--similarity", 0.5, "--max-memory", "10")
    assert "--max-memory" in cut["partial_reason"] and all(c["type"] != "type-3" for c in cut["clones"])


def test_config_reader():
    y = C.read_yaml('# c\na: 1 # d\nb:\n  - x\n  - "y: z"\n  - k: v\n    l: [p, "q,r", 2]\nc: {}\n'.replace("c: {}\n", "c: 'it''s'\n"))
    assert y == {"a": 1, "b": ["x", "y: z", {"k": "v", "l": ["p", "q,r", 2]}], "c": "it's"} and y.lines == {"a": 2, "b": 3, "c": 8}
    assert C.read_yaml("") is None and C.read_yaml("- 1.5\n- true\n- ~") == [1.5, True, None]
    for bad in ("a: 1\na: 2", "a: [1", "\ta: 1", "a: 1\n   b: 2", "x", "a: *b"):
        with pytest.raises(ValueError, match="line"):
            C.read_yaml(bad)
    assert C.read_yaml(C.STARTER)["scan"]["min-tokens"] == 50 and [C.bytes_of(s) for s in ("10", "1k", "1.5MiB", "2 GB")] == [10, 1024, 1572864, 2 << 30]
    with pytest.raises(ValueError):
        C.bytes_of("much")


def test_rules_name_rule_and_line(tmp_path):
    for text, why in {
        "rules: 3": "must be a list", "rules:\n  - name: x": "line 2.*paths", "rules:\n  - paths: []": "line 2.*at least one", "rules:\n  - paths: [a]\n    what: 1": "line 3.*what",
        "rules:\n  - paths: [a]\n    min-tokens: 0": "line 3.*greater", "rules:\n  - paths: [a]\n    similarity: 0.2": "line 3.*0.50", "rules:\n  - paths: [a]\n    skip: true\n    min-tokens: 5": "skips",
        "rules:\n  - paths: [a]\n    name: scan": "taken", "rules:\n  - paths: [a]\n    name: q\n  - paths: [b]\n    name: q": "line 5.*twice", 'rules:\n  - paths: [""]': "empty glob",
    }.items():
        (tmp_path / "c.yml").write_text(text)
        with pytest.raises(ValueError, match=why):
            settle(parser().parse_args(["scan", "-c", str(tmp_path / "c.yml")]))


def test_lookup_and_init(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert main(["init"]) == 0 and main(["init"]) == 2 and main(["init", "--force"]) == 0
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert C.find_upwards(str(tmp_path / "a" / "b")) == str(tmp_path / C.CONFIG_NAME)
    o = settle(parser().parse_args(["scan", "-l", "3"]))
    assert (o.min_tokens, o.path, o.top, o.exclude) == (30, ".", 10, [])
    (tmp_path / C.IGNORE_NAME).write_text("abcdef12\n")
    assert C.find_ignore_file("", str(tmp_path / "a")) == C.IGNORE_NAME and C.find_ignore_file("none", str(tmp_path / "a" / "b"))
    assert main(["scan", "-c", "none.yml"]) == 2
    capsys.readouterr()
