"""Trees of levels against a plain walk."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import pytest

from fieldweave.operators import trees


def nested(n=37):
    """Levels whose groups have one to many members, with numbers that are not in order of nodes."""
    first = [(k * 7) % 11 if k % 5 else 11 for k in range(n)]
    second = [g // 3 if g < 9 else g for g in first]
    third = [g // 2 for g in second]
    return [first, second, third, [0] * n]


def linkage(levels):
    """Merges, one by one, as they are defined."""
    n = len(levels[0])
    z, at, top, below = {}, n - 1, {k: (k, 1) for k in range(n)}, list(range(n))
    for lv, groups in enumerate(levels, 1):
        members = {}
        for node, g in enumerate(groups):
            members.setdefault(g, set()).add(below[node])
        new = {}
        for g in sorted(members):
            m = sorted(members[g])
            now, size = top[m[0]]
            for i, c in enumerate(m[1:]):
                other, k = top[c]
                at += 1
                size += k
                z[at] = (now, other, lv, size, g) if i == 0 else (other, now, lv, size, g)
                now = at
            new[g] = (now, size)
        top, below = new, groups
    return z, [top[g][0] for g in sorted(top)]


def walk(z, root):
    out = [root]
    for c in z.get(root, ())[:2]:
        out += walk(z, c)
    return out


@pytest.mark.parametrize("levels", [nested(), nested()[:2], [[k % 3 for k in range(8)]], [[0, 1, 2], [0, 0, 1]]])
def test_trees(spark, levels):
    n = len(levels[0])
    table = spark.createDataFrame([(lv, node, g) for lv, gs in enumerate(levels) for node, g in enumerate(gs)], "level int, node int, grp int")
    t = trees.level_tree(table)
    z, roots = linkage(levels)
    assert {r["id"]: (r["lft"], r["rgt"], r["level"], r["n"]) for r in trees.merges(t).collect()} == {k: v[:4] for k, v in z.items()}
    order = [x for r in roots for x in walk(z, r)]
    rows = {r["id"]: r for r in t.collect()}
    assert sorted(rows, key=lambda k: rows[k]["pre"]) == order and sorted(r["pre"] for r in rows.values()) == list(range(len(order)))
    assert {k: rows[k]["grp"] for k in z} == {k: v[4] for k, v in z.items()}
    parent = {c: k for k, v in z.items() for c in v[:2]}
    assert {k: r["parent"] for k, r in rows.items()} == {k: parent.get(k) for k in rows}
    ids = spark.createDataFrame([(k,) for k in [*z][-3:] + [0]], "id int")
    got = {}
    for r in trees.subtree(t, ids).collect():
        got.setdefault(r["top"], []).append((r["pre"], r["id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {r[0]: walk(z, r[0]) for r in ids.collect()}

    def up(k):
        return [k] if k not in parent else [k, *up(parent[k])]

    level = lambda k: z[k][2] if k in z else 0
    leaves = [k for k in range(n) if k % 3 != 1]
    some = spark.createDataFrame([(k,) for k in leaves], "node int")
    paths = {}
    for k in leaves:
        for x in up(k):
            paths[k, level(x)] = x
    assert {(r["leaf"], r["level"]): r["id"] for r in trees.forward_path(t, some).collect()} == paths
    meets = Counter()
    for a, b in combinations(leaves, 2):
        both = [x for x in up(a) if x in set(up(b))]
        if both:
            meets[both[0]] += 1
    assert {r["id"]: r["pairs"] for r in trees.meeting_points(t, some).collect()} == dict(meets)
    most = trees.main_meeting_point(t, some).collect()
    best = [k for k, v in sorted(meets.items()) if v == max(meets.values()) and v > 2]
    assert [r["id"] for r in most] == best[:1]
    sets = [s for s in ([k for k in leaves if k % 2], [k for k in leaves if k % 2 == 0]) if s]
    for miss, share in ((2, 0.1), (0, 1.0), (n, 0.0)):
        common = sorted(set.intersection(*({x for k in s for x in up(k) if level(x) >= 1} for s in sets)))
        want = max(common, default=None)
        if common:
            for x in common:
                c = sum(x in up(k) for k in leaves)
                if len(leaves) - c <= miss and c / len(leaves) >= share:
                    want = x if level(x) < level(want) else want
                    break
        table2 = spark.createDataFrame([(p, k) for p, s in enumerate(sets) for k in s], "part int, node int")
        assert [r["id"] for r in trees.split_point(t, table2, miss, share, 1).collect()] == ([] if want is None else [want])


def test_ways_and_counts_meet_no_chain_of_merges(spark, monkeypatch):
    """Two groups of 200: a leaf has 100 merges above it on average, which were rows of a join."""
    n = 400
    table = spark.range(n).selectExpr("0 level", "cast(id as int) node", "cast(id % 2 as int) grp").union(spark.range(n).selectExpr("1", "cast(id as int)", "0"))
    t, some = trees.level_tree(table), spark.range(n).selectExpr("cast(id as int) node")
    monkeypatch.setattr(trees, "STRETCH", 7)
    seen, plain = [], trees.covering

    def counted(points, tree):
        out = plain(points, tree)
        seen.append(out.count())
        return out

    monkeypatch.setattr(trees, "covering", counted)
    assert trees.forward_path(t, some).count() == 3 * n and seen == [3 * n]
    few = spark.createDataFrame([(3,), (3,), (4,), (398,)], "node int")
    want = {r["id"]: r["chosen"] for r in plain(t.filter("level = 0").join(few.withColumnRenamed("node", "id"), "id").selectExpr("pre at"), t.select("id", "pre", "last")).groupBy("id").count().withColumnRenamed("count", "chosen").collect()}
    assert {r["id"]: r["chosen"] for r in trees.chosen_under(t, few).collect()} == want and len(seen) == 1


def test_chosen_levels(spark):
    table = spark.createDataFrame([(lv, node, g) for lv, gs in enumerate(nested(9)) for node, g in enumerate(gs)], "level int, node int, grp int")
    got = {(r["level"], r["node"]): r["grp"] for r in trees.chosen_levels(table, spark.createDataFrame([(2,), (7,), (8,)], "node int")).collect()}
    own = [[gs[k] for k in (2, 7, 8)] for gs in nested(9)]
    assert got == {(lv, i): sorted(set(gs)).index(g) for lv, gs in enumerate(own) for i, g in enumerate(gs)}
