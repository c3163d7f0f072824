import hashlib
import random

from pyspark.sql import functions as F

from factspan.operators import core, snapshots, spans
from factspan.sources import diffs

DIFF = """diff --git a/A.cs b/A.cs
--- a/A.cs
+++ b/A.cs
@@ -10,2 +10,3 @@ x
+++ not a header
diff --git a/N.cs b/N.cs
new file mode 100644
--- /dev/null
+++ b/N.cs
@@ -0,0 +1,2 @@
diff --git a/D.cs b/D.cs
deleted file mode 100644
--- a/D.cs
+++ /dev/null
@@ -1,2 +0,0 @@
diff --git a/O.cs b/P.cs
rename from O.cs
rename to P.cs
@@ -3 +3 @@
"""


def test_diff_text(spark):
    df = spark.createDataFrame([("c", DIFF), ("empty", "")], "change_id string, text string")
    files = {r.path: (r.old_path, r.status) for r in diffs.parse_diff_files(df).collect()}
    assert files == {"A.cs": (None, "modified"), "N.cs": (None, "added"), "D.cs": (None, "deleted"), "P.cs": ("O.cs", "renamed")}
    hunks = {r.path: (r.old_start, r.old_count, r.new_start, r.new_count) for r in diffs.parse_diff_hunks(df).collect()}
    assert hunks == {"A.cs": (10, 2, 10, 3), "N.cs": (0, 0, 1, 2), "D.cs": (1, 2, 0, 0), "P.cs": (3, 1, 3, 1)}


def _spans(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), f"s{i}", "Method", lo := rng.randint(1, 400), lo + rng.choice([0, 1, 15, 16, 17, 200, 5000, 70000])) for i in range(120)]
    return rows, spark.createDataFrame(rows, "path string, symbol_id string, kind string, line int, end_line int")


def test_innermost_matches_brute_force(spark):
    rows, decls = _spans(spark, 1)
    points = spark.createDataFrame([(i, p, l) for i, (p, l) in enumerate([(p, l) for p in "abc" for l in range(1, 500, 7)])], "id int, path string, line int")
    got = {r.id: r.containing_symbol_id for r in spans.enclosing_declaration(points, decls).collect()}
    for r in points.collect():
        around = [(hi - lo, s) for p, s, _, lo, hi in rows if p == r.path and lo <= r.line <= hi]
        assert got[r.id] == (min(around)[1] if around else None)


def test_overlaps_match_brute_force(spark):
    rows, left = _spans(spark, 2)
    other, right = _spans(spark, 3)
    right = right.select("path", F.col("symbol_id").alias("other"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    got = [(r.symbol_id, r.other) for r in spans.overlaps(left, right, ["path"], ("line", "end_line"), ("lo", "hi")).collect()]
    want = [(a[1], b[1]) for a in rows for b in other if a[0] == b[0] and a[3] <= b[4] and b[3] <= a[4]]
    assert sorted(got) == sorted(want)


def test_changed_line_gives_method_body(spark):
    decls = spark.createDataFrame([("A.cs", "T", "NamedType", 1, 30), ("A.cs", "M", "Method", 8, 14)], "path string, symbol_id string, kind string, line int, end_line int")
    hunks = spark.createDataFrame([("c", "A.cs", 10, 1), ("c", "A.cs", 20, 0)], "change_id string, path string, new_start int, new_count int")
    rows = spans.changed_symbol_rows(spans.changed_declarations(hunks, decls)).collect()
    assert [(r.symbol_id, r.change_kinds, r.changed_lines) for r in rows] == [("M", ["body"], [10])]


def test_hunk_without_new_lines_is_unresolved(spark):
    files = spark.createDataFrame([("c", "A.cs", "modified"), ("c", "read.me", "modified")], "change_id string, path string, status string")
    hunks = spark.createDataFrame([("c", "A.cs", 5, 0)], "change_id string, path string, new_start int, new_count int")
    docs = files.select("path")
    none = spark.createDataFrame([], "change_id string, path string")
    assert [r.reason for r in spans.unresolved_changes(files, hunks, docs, none).collect()] == ["deleted-or-not-in-current-workspace"]


def _symbol(doc_id, name="Format", kind="Method", signature="s", params=("int",), attrs=(), defaults=(), nullable=(), container="N.T"):
    params = [(f"p{i}", t) for i, t in enumerate(params)]
    return (doc_id, name, kind, container, signature, [], params, [], list(nullable), list(defaults), list(attrs), "a.cs", 1, 1)


API = (
    "doc_id string, name string, kind string, container string, signature string, modifiers array<string>, parameters array<struct<name:string,type:string>>, "
    "generic_constraints array<string>, nullable_annotations array<string>, default_values array<string>, attributes array<string>, path string, line int, column int"
)


def _diff(spark, base, head):
    make = lambda rows: snapshots.api_snapshot(spark.createDataFrame(rows, API))
    return {(r.code, r.source_risk, r.binary_risk) for r in snapshots.api_changes(make(base), make(head)).collect()}


def test_api_changes(spark):
    assert _diff(spark, [_symbol("M:Removed")], []) == {("public-member-removed", "breaking", "breaking")}
    assert _diff(spark, [_symbol("M:F(int)")], [_symbol("M:F(string)", params=("string",))]) == {("public-signature-changed", "breaking", "breaking")}
    iface = _symbol("T:N.IThing", name="IThing", kind="NamedType", signature="interface IThing", params=(), container="N")
    assert _diff(spark, [iface], [iface, _symbol("M:N.IThing.Go", container="N.IThing")]) == {("interface-member-added", "breaking", "breaking")}
    facets = _diff(spark, [_symbol("M:X", attrs=("A(1)",), defaults=("a=1",))], [_symbol("M:X", attrs=("A(2)",), defaults=("a=2",), nullable=("annotated",))])
    assert {c for c, _, _ in facets} == {"attribute-argument-changed", "default-parameter-changed", "nullable-annotation-changed"}


def test_pairing_of_a_hot_overload_set_matches_greedy_order(spark):
    base = [_symbol(f"M:F({i:05d})") for i in range(0, 3000, 2)]
    head = [_symbol(f"M:F({i:05d})") for i in range(1, 2000, 2)]
    make = lambda rows: spark.createDataFrame(rows, API)
    got = {(r.base_id, r.doc_id) for r in snapshots.pair_signature_changes(make(base), make(head)).collect()}
    assert got == set(zip(sorted(r[0] for r in base), sorted(r[0] for r in head)))


def test_running_total_over_one_hot_group(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    rows = core.running_total(df, ["k"], "v", F.col("v"), "t").collect()
    assert all(r.t == r.v * (r.v + 1) // 2 for r in rows) and len(rows) == 5000


def test_exact_quantiles_are_nearest_rank(spark):
    values = [random.Random(5).randint(0, 40) for _ in range(333)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7), ("c", None)], "k string, v int")
    got = {r.k: (r.m, r.p) for r in core.exact_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.95}).collect()}
    s = sorted(values)
    assert got == {"a": (s[(len(s) - 1) // 2], s[-(-len(s) * 95 // 100) - 1]), "b": (7, 7)}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    make = lambda rows: core.fingerprint(spark.createDataFrame(rows, "g string, v string"), ["g"], ["v"]).collect()[0].fingerprint
    assert make([("g", "a"), ("g", "b")]) == make([("g", "b"), ("g", "a")])
    assert make([("g", "a"), ("g", "b")]) != make([("g", "a"), ("g", "c")])
    assert make([("g", "a")]) != make([("g", "a"), ("g", "a")])


def _merkle(items, run):
    items = [hashlib.sha256(x.encode()).hexdigest() for x in items]
    while len(items) > 1:
        runs = [items[i : i + run] for i in range(0, len(items), run)]
        items = [r[0] if len(r) == 1 else hashlib.sha256("\n".join(r).encode()).hexdigest() for r in runs]
    return items[0]


def test_fingerprints_are_digests_of_the_ordered_lines(spark):
    draw = random.Random(2)
    rows = [(g, i, draw.choice(["x", "y|z", None, "w" * 50])) for g, n in (("a", 1), ("b", 7), ("c", 700), (None, 90)) for i in draw.sample(range(1000), n)]
    rows.append(rows[-1])
    make = lambda table, **how: {r.g: (r.form, r.fingerprint) for r in core.fingerprint(table, ["g"], ["v", "i"], order=["i"], head=["g"], **how).collect()}
    table = lambda rows: spark.createDataFrame(rows, "g string, i int, v string").repartition(3)
    lines = {g: [f"{v or ''}|{i}" for i, v in sorted((i, v or "") for k, i, v in rows if k == g)] for g in ("a", "b", "c", None)}
    sha = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    assert make(table(rows)) == {g: ("plain", sha(g or "", *own)) for g, own in lines.items()}
    # Groups beyond the bound get a root over runs of three; the others keep their plain digest.
    bound = sum(len(x) + 1 for x in lines[None]) - 1
    want = {g: ("merkle", sha(g or "", _merkle(own, 3))) if g in ("c", None) else ("plain", sha(g, *own)) for g, own in lines.items()}
    assert make(table(rows), plain_bytes=bound, run=3) == want


def test_a_swap_of_two_rows_changes_the_fingerprint(spark):
    rows = [(i, f"v{i}") for i in range(200)]
    swapped = [*rows[:100], (100, "v101"), (101, "v100"), *rows[102:]]
    for how in ({}, {"plain_bytes": 10, "run": 7}):
        one, two = (core.fingerprint(spark.createDataFrame(r, "i int, v string"), [], ["v"], order=["i"], **how).collect() for r in (rows, swapped))
        assert len(one) == len(two) == 1 and one[0].row_count == 200 and one[0].fingerprint != two[0].fingerprint
    assert core.fingerprint(spark.createDataFrame([], "i int, v string"), [], ["v"]).count() == 0


def test_snapshots_are_compared_in_one_pass(spark):
    """Against a plain comparison: matched facets, greedy pairs by place, the rest removed or added."""
    draw = random.Random(11)
    columns = (
        "repo string, doc_id string, kind string, container string, name string, signature string, modifiers array<string>, parameters array<string>, generic_constraints array<string>, "
        "nullable_annotations array<string>, default_values array<string>, attributes array<string>, path string, line int, column int"
    )

    def symbols(drop, seed):
        own, rows = random.Random(seed), []
        for i in range(400):
            kind, name = draw_of(i)
            if own.random() > drop:
                doc = f"M{i}" if i % 5 else f"M{i}.{seed}"
                rows.append((f"r{i % 2}", doc, kind, [None, "A.IThing", "B"][i % 3], name, "interface" if i % 50 == 0 else f"s{own.randrange(2)}", [own.choice(["virtual", "public"])], ["p"] * (i % 3), [], [], [], ["x"] * own.randrange(3), "a.cs", i, 1))
        return rows

    kinds = [(draw.choice(["Method", "NamedType", "EnumMember", None]), draw.choice(["f", "g", "IThing", None])) for _ in range(400)]
    draw_of = kinds.__getitem__
    base, head = symbols(0.1, 1), symbols(0.2, 2)
    got = snapshots.api_changes(spark.createDataFrame(base, columns), spark.createDataFrame(head, columns), keys=("repo",)).collect()
    of = lambda rows: {(r[0], r[1]): r for r in rows}
    b, h = of(base), of(head)
    shape = lambda r: (r[0], r[2], r[3], r[4], len(r[7]))
    queues = {}
    for k in sorted(b.keys() - h.keys()):
        queues.setdefault(shape(b[k]), []).append(k)
    pairs = {}
    for k in sorted(h.keys() - b.keys()):
        if h[k][2] and h[k][4] and queues.get(shape(h[k])):
            pairs[k] = queues[shape(h[k])].pop(0)
    count = lambda change: {(r.repo, r.doc_id) for r in got if r.change == change and r.code != "public-signature-changed"}
    assert {(r.repo, r.doc_id): r.base_line for r in got if r.code == "public-signature-changed"} == {k: b[v][13] for k, v in pairs.items()}
    assert count("removal") == b.keys() - h.keys() - set(pairs.values()) and count("addition") == h.keys() - b.keys() - pairs.keys()
    polymorphic = {k for k in b.keys() & h.keys() if ("virtual" in b[k][6]) != ("virtual" in h[k][6])}
    assert {(r.repo, r.doc_id) for r in got if r.code == "abstract-virtual-sealed-changed"} == polymorphic
