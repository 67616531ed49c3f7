"""Operators of the llm subpackage against brute force on small inputs with nulls, ties, repeated and clashing rows."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echotrace.llm import codefiles, components, mixing, neardup, packing, residue, spans


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["star", "chain", "random", "empty"])
def test_components(spark, shape):
    rnd = random.Random(5)
    edges = {
        "star": [(1000, i) for i in range(200)] + [(5, 5), (None, 3), (7, None)],
        "chain": [(i, i + 1) for i in range(0, 300)] + [(i + 1, i) for i in range(0, 300)],
        "random": [(rnd.randrange(-(2**62), 2**62) % 400, rnd.randrange(400)) for _ in range(250)],
        "empty": [(3, 3), (None, None)],
    }[shape]
    df = spark.createDataFrame(edges, "a bigint, b bigint").withColumn("id", F.lit(1))
    got = {r.id: r.group_id for r in components.components(df).collect()}
    assert got == union_find(edges)


def test_instance_links(spark):
    m = spark.createDataFrame([(1, 2, 0.5), (2, 1, None), (3, 3, 1.0), (None, 4, 1.0)], "a_idx bigint, b_idx bigint, similarity double")
    c = spark.createDataFrame([(1, [(5, "x"), None, (6, "y"), (5, "x"), (None, "z"), (9, "q")]), (2, None), (3, [])], "clone_id bigint, instances array<struct<instance_id:bigint,file_path:string>>")
    got = {r.id: r.group_id for r in components.components(components.instance_links(m, c)).collect()}
    assert got == {1: 1, 2: 1, 5: 5, 6: 5, 9: 5}


def brute_spans(files, k_of):
    out = set()
    for run in {r for _, r, _ in files}:
        own, k = {}, k_of.get(run, 50)
        mine = {}
        for f, r, t in files:
            if r == run and t is not None:
                mine[f] = t
        for f, t in mine.items():
            for p in range(len(t) - k + 1):
                own.setdefault(tuple(t[p : p + k]), set()).add(f)
        for f, t in mine.items():
            hit = [False] * len(t)
            for p in range(len(t) - k + 1):
                if len(own[tuple(t[p : p + k])]) > 1:
                    hit[p : p + k] = [True] * k
            p = 0
            while p < len(t):
                if hit[p]:
                    q = p
                    while q + 1 < len(t) and hit[q + 1]:
                        q += 1
                    out.add((f, p, q))
                    p = q
                p += 1
    return out


def test_spans(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4)] + [None]
    base = [rnd.choice(words) for _ in range(60)]
    files = []
    for f in range(30):
        t = [rnd.choice(words) for _ in range(rnd.randrange(0, 50))]
        for _ in range(rnd.randrange(3)):
            a = rnd.randrange(40)
            t += base[a : a + rnd.randrange(1, 20)]
        files.append((f, f % 3, t))
    files += [files[4], (99, 1, None), (100, 1, []), (101, 0, ["w1"] * 40), (102, 0, ["w1"] * 9)]
    runs = [(0, 7, "x"), (0, 7, "x"), (1, 10, "y"), (2, 0, "z")]
    df = spark.createDataFrame([(*x, "k") for x in files], "file_id int, run_id int, tokens array<string>, k string")
    got = spans.shared_spans(df, spark.createDataFrame(runs, "run_id int, min_tokens int, tokens string"))
    assert {tuple(r) for r in got.collect()} == brute_spans(files, {0: 7, 1: 10})


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 0.85])
def test_grid_has_enough_groups(t):
    """Whatever pair of sizes is similar: the larger one looks up more groups than the pair may differ in, where the smaller one lies."""
    for a in range(1, 90):
        own = neardup.lookups(t, a, neardup.bands(t, a) if t >= neardup.LOW else [])
        for b in range(1, a + 1):
            if b < t * a - 1e-9:
                continue
            home = next((k, g) for k, g, _, here in neardup.lookups(t, b, neardup.bands(t, b) if t >= neardup.LOW else []) if here)
            k, g, need, _ = next(x for x in own if x[0] == home[0])
            if t >= neardup.LOW:
                assert g == home[1] and g >= need > neardup.within(t, a, b)
            else:
                assert need + -(-t * a // 1) > a


@pytest.mark.parametrize("low", [0.6, 0.3, 0.9, 1.0])
def test_neardup(spark, low):
    rnd = random.Random(2)
    blocks, uni = [], list(range(1, 400))
    for i in range(120):
        if i % 3:
            s = set(blocks[rnd.randrange(len(blocks))][2] or [1])
            for _ in range(rnd.randrange(4)):
                s ^= {rnd.choice(uni)}
        else:
            s = set(rnd.sample(uni, rnd.randrange(1, 30)))
        s = [x for x in s if x]
        blocks.append((i, i % 2, s + [0, None] + s[:2], "t"))
    blocks += [(500, 0, None, "t"), (501, 0, [0, None], "t"), (3, 1, blocks[3][2], "t")]
    t = {0: low, 1: 0.7}
    runs = spark.createDataFrame([(0, low), (1, 0.0)], "run_id int, min_similarity double")
    reps, members = neardup.classes(neardup.block_sets(spark.createDataFrame(blocks, "block_id bigint, run_id int, mini array<bigint>, s string"), runs))
    pairs = {(r.rep_a, r.rep_b) for r in neardup.similar_classes(reps).collect()}
    rep = {r.block_id: r.rep for r in members.collect()}
    sets = {b: (r, frozenset(x for x in m or [] if x)) for b, r, m, _ in blocks}
    sets = {b: v for b, v in sets.items() if v[1]}
    assert set(rep) == set(sets)
    want = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a][0] == sets[b][0]:
                (r, x), (_, y) = sets[a], sets[b]
                if x == y:
                    assert rep[a] == rep[b]
                elif len(x & y) / len(x | y) >= t[r]:
                    want.add(tuple(sorted((rep[a], rep[b]))))
    assert pairs == want
    assert neardup.similar_classes(reps.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 50, 256])
    counts = {}
    for _ in range(rnd.randrange(1, 400)):
        s = rnd.randrange(1, cap + 1)
        counts[s] = counts.get(s, 0) + 1
    plan, bins = packing.plan_bins(counts, cap)
    load = np.zeros(bins, dtype=int)
    for s, n in counts.items():
        p = plan[plan["size"] == s].sort_values("r0")
        assert p["r0"].tolist() == [0, *p["r1"].tolist()[:-1]] and p["r1"].iloc[-1] == n
        for _, r in p.iterrows():
            for k in range(r.r0, r.r1):
                load[r.b0 + (k - r.r0) // r.q] += s
    assert load.max() <= cap and load.min() > 0
    assert bins <= 11 / 9 * -(-sum(s * n for s, n in counts.items()) // cap) + 1 + sum(n for s, n in counts.items() if s > cap // 2)


def test_packing_reduction_is_optimal_on_exact_pairs():
    assert packing.plan_bins({6: 3, 4: 3}, 10)[1] == 3
    assert packing.plan_bins({}, 10)[1] == 0


def test_pack(spark):
    docs = spark.createDataFrame([(1, 0), (2, 7), (3, 7), (4, 25), (5, 20), (6, None), (7, 3)], "doc_id bigint, n_tokens bigint").withColumn("capacity", F.lit("x"))
    specs = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, "b", 0)], "spec_id int, spec_name string, capacity_tokens int")
    rows = packing.pack(docs, specs).toPandas()
    assert rows.groupby("doc_id")["n_tokens"].sum().to_dict() == {1: 0, 2: 7, 3: 7, 4: 25, 5: 20, 7: 3}
    assert rows.groupby("bin_id")["n_tokens"].sum().max() <= 10
    assert packing.pack(docs.limit(0), specs).count() == 0


def test_rates():
    cells = pd.DataFrame({"source": list("aabbc"), "lang": ["x", "y", "x", "y", "x"], "topic": ["t", "u", "t", "u", "t"], "tokens": [100, 300, 50, 50, 9]})
    t = pd.DataFrame({"source": ["a", "b", "d"], "target_share": [0.5, 0.4, 0.1], "max_repeats": [1, 4, 2]})
    r = mixing.rates(cells, t)
    got = (r["rate"] * r["tokens"]).groupby(r["source"]).sum()
    assert set(got.index) == {"a", "b"} and abs(got["a"] / got.sum() - 5 / 9) < 1e-6
    assert (r["rate"] <= r["max_repeats"] + 1e-9).all()


def test_mix_meets_given_languages_and_topics(spark):
    rnd = random.Random(3)
    rows = [(i, f"s{i % 3}", rnd.choice(["en", "de", "fr"]), rnd.choice("tuv"), rnd.randrange(20, 60)) for i in range(9000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, n_tokens bigint")
    t = spark.createDataFrame([("s0", 0.5, 3), ("s1", 0.3, 3), ("s2", 0.2, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(sized, t, None, {"en": 0.6, "de": 0.3, "fr": 0.1}, {"t": 0.2, "u": 0.2, "v": 0.6}).toPandas()
    w = m["n_tokens"] * m["copies"]
    for k, want in (("source", {"s0": 0.5, "s1": 0.3, "s2": 0.2}), ("lang", {"en": 0.6, "de": 0.3, "fr": 0.1}), ("topic", {"t": 0.2, "u": 0.2, "v": 0.6})):
        got = w.groupby(m[k]).sum() / w.sum()
        assert all(abs(got[x] - y) < 0.02 for x, y in want.items()), (k, got)
    assert (m["copies"] <= 3).all()
    folded = mixing.fold(sized, 1, 2).select("topic", "lang").distinct().collect()
    assert {r.topic for r in folded} <= {"t", "u", "v", "other"} and len({r.topic for r in folded}) == 2 and len({r.lang for r in folded}) == 3


def test_mix(spark):
    rows = [(i, "Src-A " if i % 2 else "src_b", "en", f"{i % 3}. Topic {i % 3}", 50 + i % 7) for i in range(2000)] + [(9001, "none", "en", None, 5), (9002, "src_b", None, None, 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, n_tokens bigint").withColumn("source", mixing.clean_source(F.col("source")))
    t = spark.createDataFrame([("src_a", 0.75, 2), ("SRC_B", 0.25, 1), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(sized, t).toPandas()
    w = (m["n_tokens"] * m["copies"]).groupby(m["source"]).sum()
    assert abs(w["src_a"] / w.sum() - 0.75) < 0.02
    assert m[m["source"] == "src_a"]["copies"].max() <= 2 and m[m["source"] == "src_b"]["copies"].max() <= 1 and not m["doc_id"].duplicated().any()
    assert mixing.mix(sized.limit(0), t).count() == 0


def test_source_features():
    comments, code = codefiles.split_source("// Code generated by x. DO NOT EDIT.\r\nfunc f() { return 1 }\n\n# c\n")
    assert comments.startswith("// code generated") and code == ["func f() { return 1 }"]
    assert codefiles.split_source(None) == ("", [])
    assert len(codefiles.features("", "", [])[0]) == 0
    assert codefiles.clean_path(r".\Src\A.GO") == "src/a.go"


def test_code_classifier_separates(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(160):
        if i % 4 == 0:
            body = "\n".join(f"func {word()}() int {{\n  x := {word()}({rnd.randrange(99)})\n  return x\n}}" for _ in range(12))
            rows.append((i, f"api/{word()}.pb.go", body, i % 5))
        else:
            body = "\n".join(rnd.choice([f"if {word()} > {word()} {{ {word()}() }}", f"for i := 0; i < {rnd.randrange(9)}; i++ {{ {word()}(i) }}", f"{word()}.{word()} = {word()}", f"// {word()} {word()}", f"switch {word()} {{ case 1: {word()}() }}"]) for _ in range(14))
            rows.append((i, f"src/{word()}.go", body, i % 5))
    rows += [(1000, "src/plain.go", rows[0][2], 1), (1001, None, None, 1), (1002, "a.go", "", 1), (0, rows[0][1], rows[0][2], 0)]
    df = spark.createDataFrame(rows, "file_id int, file_path string, src_text string, run_id int").withColumn("content", F.lit(1))
    runs = spark.createDataFrame([(i, f" Repo-{i % 3} ", "x") for i in range(4)], "run_id int, repo string, src_text string")
    got = {r.file_id for r in codefiles.not_hand_written(df, runs).collect()}
    assert got == {i for i in range(160) if i % 4 == 0} | {1000}  # its code has the look of the marked ones
    assert codefiles.not_hand_written(df.limit(0), runs).count() == 0


def test_code_views_without_marks():
    for path, head in (("a/x.go", "// code generated by q. do not edit."), ("a/x.go", "// vendored from q"), ("third_party/a/x.go", "// plain")):
        row = path, head + "\n// more", ["x = 1"]
        kinds = codefiles.marked(*row)
        assert any(kinds.values())
        assert any(v[2] and not any(codefiles.marked(*v).values()) for v in codefiles._views(*row, kinds))
    assert codefiles.masked("gen/a/x.gen.pb.go", "// @generated\n// @license q\n// c", ["y"]) == ("a/x.go", "// c", ["y"])
    assert codefiles.masked("", "", []) == ("", "", [])


def test_code_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, "a.py", "x" * (10 if i % 5 else 5000), 1, "r") for i in range(100)]
    df = spark.createDataFrame(rows + rows[:3], "file_id int, file_path string, src_text string, run_id int, repo string")
    monkeypatch.setattr(codefiles, "SAMPLE_BYTES", 2000)
    s = codefiles.sample_of(df)
    assert len(s) > 50 and s["src_text"].str.len().sum() <= 2000


def test_third_party_copies_follow_by_content(spark):
    code = "\n".join(f"int f{i}(int a) {{ return a + {i}; }}" for i in range(30))
    rows = [(i, f"{'vendor/lib' if i % 3 == 0 else 'src'}/m{i}.c", code.replace("f", "fgh"[i % 3] + "q") + f"\nint own{i // 3 if i % 3 else 0};", i % 4) for i in range(120)]
    rows += [(900, "src/copy.c", "// note\n" + rows[0][2].replace(" ", "  "), 1), (901, "src/none.c", None, 1)]
    df = spark.createDataFrame(rows, "file_id int, file_path string, src_text string, run_id int")
    got = {r.file_id: r.kind for r in codefiles.not_hand_written(df, spark.createDataFrame([(0, "r")], "run_id int, repo string")).collect()}
    assert got.get(900) == "vendored" and got.get(0) == "vendored" and 901 not in got


def test_code_marks_are_public_banners_only():
    assert codefiles.GENERATED_MARKS.search("// code generated by protoc-gen-go. do not edit.") and codefiles.GENERATED_MARKS.search("# generated by the protocol buffer compiler.  do not edit!")
    assert not codefiles.GENERATED_MARKS.search("// writes the auto generated banner into every stub") and not codefiles.GENERATED_MARKS.search("// the key is generated by calling f")
    assert codefiles.VENDORED_MARKS.search("/* this file is part of gcc. */") and not codefiles.VENDORED_MARKS.search("// used to be vendored, rewritten here")


def test_code_validation_scores_all_held_out_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"api/m{i}.pb.go" if i % 3 == 0 else f"src/m{i}.go", f"func f{i}() {{\n  return {i}\n}}\n" * 3, i % 8) for i in range(160)]
    df = spark.createDataFrame(rows + rows[:40], "file_id int, file_path string, src_text string, run_id int")
    df.write.parquet(str(tmp_path / "tokenized_files.parquet"))
    spark.createDataFrame([(i, f"{'WEB' if i % 2 else 'web'}-{i // 2}") for i in range(7)], "run_id int, repo string").write.parquet(str(tmp_path / "detect_runs.parquet"))
    repo = lambda r: f"web-{r // 2}" if r < 7 else "run 7"
    monkeypatch.setattr(codefiles, "SAMPLE_ROWS", 24)
    held = [i for i in range(160) if codefiles.zlib.crc32(repo(i % 8).encode()) % 4 == 0]
    got = {r.kind: r for r in codefiles.p5_validation(spark, str(tmp_path)).collect()}
    assert held and got["generated"].marked == sum(i % 3 == 0 for i in held) and set(got) == set(codefiles.KINDS)


PROSE = [
    "The committee heard many witnesses and the report was adopted after a long debate.", "My council pays a great deal towards the harbour, and I say so with care.",
    "We shall divide the House on this question before the recess begins in summer. [Interruption.]", "The member for the northern towns spoke of schools (Hear, hear) and of the price of bread.",
]
BAD = [
    (1001, PROSE[0] + "\n\nPlease enable JavaScript to view this page."), (1002, "404 Not Found. The requested page was not found on this server."), (1003, "The committee heard {{speaker_name}} many witnesses."),
    (1004, "Lorem ipsum dolor sit amet, consectetur adipiscing elit."), (1005, '"Lorem ipsum dolor sit amet, consectetur adipiscing elit."'), (1006, "«Error 404: page not found. " + "The page you requested does not exist. " * 9 + "»"),
    (1007, 'I thank "{{ speaker_name }}" for the report.'), (1008, "Dies ist ein Blindtext, er füllt nur die Seite."), (1009, "My council pays [INSERT AMOUNT HERE] towards the harbour."), (1010, "404 Not Found"),
]
FINE = [
    (2001, 'The form says "please enable JavaScript" and my constituents are lost, which the committee heard from many witnesses.'), (2002, ""), (2003, None), (2004, 'The letter opened with the words "Dear {{first_name}}", which says it all.'),
    (2005, "[Interruption.]"), (2006, "   \n "), (2007, "The draft still has [name] on its second page."),
]


def test_residue(spark):
    rows = [(i, " ".join(random.Random(i).sample(PROSE, 2))) for i in range(2000)]
    df = spark.createDataFrame(rows + BAD + FINE + BAD[:1] + [(None, BAD[0][1])], "doc_id bigint, text string").withColumn("slot", F.lit("x"))
    got = {r.doc_id for r in residue.residue(df).collect()}
    assert got == {i for i, _ in BAD}
    assert residue.residue(df.limit(0)).count() == 0


def test_residue_does_not_depend_on_the_size_of_the_collection():
    texts = [" ".join(random.Random(i).sample(PROSE, 2)) for i in range(300)] + [t for _, t in BAD + FINE]
    chunk = residue._Chunk(texts)
    seeds, prose = residue.seed_counts(), chunk.prose()

    def found(times):
        counts = seeds | {k: c * times for k, c in prose.items()}
        empty = {k: np.zeros(s, dtype=np.int64) for k, s in residue._SHAPES.items()}
        sure = chunk.sure({k: m.astype(np.float32) for k, m in residue.models_of(counts).items()})
        counts = residue.learned(counts, empty | {k: c * times for k, c in sure.items()})
        return chunk.judged({k: m.astype(np.float32) for k, m in residue.models_of(counts).items()})[list(residue.KINDS)]

    small, large = found(1), found(100_000)
    assert small.equals(large) and small.to_numpy().any()


def test_residue_counts_survive_packing():
    t = np.zeros((2, 1 << 15), dtype=np.int64)
    t[0, 5], t[1, 40] = 2**40, 7
    back = np.zeros_like(t)
    for r in residue._packed({"x": t}, 3).itertuples():
        cells, n = residue._unpacked(r.counts)
        back.reshape(-1, residue._BLOCK)[r.block, cells] = n
    assert (back == t).all()


def test_residue_pieces_and_units():
    assert residue.pieces(None) == [] and residue.pieces(" \r\n ") == []
    assert residue.pieces('He said "a b. C d" twice.\nNext')[0] == ("a b.", 0, True) and residue.pieces("x\nNext line")[1] == ("Next line", 1, False)
    assert residue.pieces("a const-\nituent")[0][0] == "a constituent"
    assert residue.units("I {{Member Name}} [to be done] no no x_y.") == ["I", "{{Member Name}}", "[to be done]", "no no", "x_y."]
    assert "".join(p for p, _, _ in residue.pieces("z" * 250_000)) == "z" * 250_000


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_llm_queries_against_sql(spark):
    from echotrace.llm import registry
    from tests.oracle import compare

    sql = registry.oracle_sql()
    bad = {n: d for n, f in registry.queries().items() if n in sql and (d := compare(spark, "/root/testdata/sf0.001", n, f, sql[n]))}
    assert not bad
