"""Trees, moves, running sums and directory imports against plain Python."""

import random

from trovelight.operators import hierarchy as H
from trovelight.sources import files


def brute(parents):
    out = {}
    for n in parents:
        at, seen = n, [n]
        while parents[at] in parents and parents[at] is not None and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        p = parents[at]
        out[n] = (None, None, "cycle") if p in seen else (at, len(seen) - 1, "rooted" if p is None else "orphan")
    return out


def test_roots_against_brute_force(spark):
    rnd = random.Random(3)
    parents = {i: rnd.choice([None, rnd.randrange(60), i - 1, i - 1, i - 1, 999]) for i in range(120)}
    parents |= {200: 200, 201: 202, 202: 203, 203: 201, 204: 203}
    rows = [(n, p, f"n{n}", "x") for n, p in parents.items()] + [(None, 1, "a", "x"), (5, parents[5], "n5", "y")]
    got = {r.node: r for r in H.resolve(spark.createDataFrame(rows, "node long, parent long, name string, depth string")).collect()}
    want = brute(parents)
    assert {n: (r.root, r.depth, r.state) for n, r in got.items()} == want
    for n, r in got.items():
        names, at = [], n
        while r.state != "cycle":
            names.append(f"n{at}")
            if at == r.root:
                break
            at = parents[at]
        assert r.path == ("/".join(reversed(names)) if names else None)


def test_deep_chain_and_hot_parent(spark):
    """2,000 levels in a dozen rounds; a third of all nodes below one parent."""
    rows = [(i, i - 1 if i else None, "") for i in range(2_000)] + [(10_000 + i, 1_999, "") for i in range(1_000)]
    got = H.resolve(spark.createDataFrame(rows, "node long, parent long, name string")).select("node", "root", "depth").collect()
    assert len(got) == 3_000 and all(r.root == 0 and r.depth == (r.node if r.node < 10_000 else 2_000) for r in got)


def test_moves(spark):
    nodes = spark.createDataFrame([("a", None, "a"), ("b", "a", "b"), ("c", "b", "c"), ("d", None, "d"), ("e", "d", None)], "node string, parent string, name string")
    moves = spark.createDataFrame([("a", "c"), ("d", "b"), ("e", None), ("c", "gone"), ("unknown", "a"), (None, "a"), ("e", "a")], "node string, target string")
    got = {r.node: (r.outcome, r.path, r.state) for r in H.move(nodes, moves).collect()}
    assert got == {"a": ("FOLDER_CYCLE", "a", "rooted"), "b": ("kept", "a/b", "rooted"), "c": ("PARENT_NOT_FOUND", "a/b/c", "rooted"), "d": ("FOLDER_CYCLE", "d", "rooted"), "e": ("moved", "", "rooted")}
    only = spark.createDataFrame([("d", "b")], "node string, target string")
    assert {r.node: r.path for r in H.move(nodes, only).collect()}["e"] == "a/b/d/"


def test_trace_roots(spark):
    rows = [(1, None, None), (2, 1, 1), (3, 2, 2), (4, 99, 4), (5, 6, 5), (6, 5, 5)]
    got = {r.trace: (r.found, r.depth, r.verdict) for r in H.trace_roots(spark.createDataFrame(rows, "trace long, parent long, root long")).collect()}
    assert got == {1: (1, 0, "sound"), 2: (1, 1, "sound"), 3: (1, 2, "wrong_root"), 4: (4, 0, "parent_gone"), 5: (None, None, "cycle"), 6: (None, None, "cycle")}


def test_empty(spark):
    nodes = spark.createDataFrame([], "node long, parent long, name string")
    assert H.resolve(nodes).collect() == [] == H.move(nodes, spark.createDataFrame([], "node long, target long")).collect()
    assert files.plan_import(spark.createDataFrame([], "root string, path string, size long")).collect() == []


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else random.Random(i).choice(["a", "b", "zz", None]), f"p{i * 7919 % 1000:04}", i % 11 or None) for i in range(1_000)]
    df = spark.createDataFrame(rows, "root string, path string, size long").repartition(9)
    got = sorted((r.root or "", r.path, r.position, r.bytes) for r in H.running(df, "root", ["path"], df["size"]).collect())
    want, count, total = [], {}, {}
    for root, path, size in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        count[root], total[root] = count.get(root, 0) + 1, total.get(root, 0) + (size or 0)
        want.append((root or "", path, count[root], total[root]))
    assert got == sorted(want)


def test_import_budgets_and_identity(spark):
    rows = [("r", "a.md", 10, 1), ("r", "b.zip", 10, 1), ("r", "c.txt", 90, 1), ("r", "d.csv", 10, 1), ("r", "e.md", 10, 1), ("r", "skip/a.md", 1, 1), ("s", "a.md", 80, 1), ("s", "b.md", 80, 1), ("t", "a.md", 5, 1), ("t", None, 5, 1)]
    listing = spark.createDataFrame(rows, "root string, path string, size long, inode long")
    plan = files.plan_import(listing, ["Skip/"], max_files=4, max_bytes=150, max_file_bytes=50)
    assert {(r.root, r.path): r.status for r in plan.collect()} == {("r", "a.md"): "selected", ("r", "b.zip"): "unsupported", ("r", "c.txt"): "resource_limit", ("r", "d.csv"): "selected", ("r", "e.md"): "beyond_files", ("s", "a.md"): "refused", ("s", "b.md"): "refused", ("t", "a.md"): "selected"}
    now = spark.createDataFrame([("r", "a.md", 10, 2), ("r", "c.txt", 90, 1), ("t", "a.md", 5, 1)], "root string, path string, size long, inode long")
    checked = files.checked_import(plan, now, ["size", "inode"])
    assert {(r.root, r.path) for r in checked.filter("code = 'DIRECTORY_FILE_CHANGED'").collect()} == {("r", "a.md"), ("r", "d.csv")}
    assert {tuple(r) for r in files.import_outcome(checked).collect()} == {("r", 4, 4, True, "partial"), ("s", 2, 0, False, "refused"), ("t", 1, 0, False, "succeeded")}
