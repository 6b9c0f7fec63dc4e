"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that hold them). A flow network routes the patterns' words to
source quotas: the first copy of a word costs 0, the second 1 and so on (convex), so nothing repeats while fresh words are left. Per pattern,
a seeded order then decides which documents carry the flow. Only pattern and source sums reach the driver; their number does not grow with the rows.

Cases: a null source is a source of its own and sorts last; null text has size 0 and takes nothing; repeated rows are rows of their own;
ties in the seeded order break by id, then by size; an empty table gives an empty result. Extra columns are not read."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

WEIGHTS, SHARE, REPEATS, SEED, BUCKETS = (3, 1, 2), 1.5, 2, "mix-1", 256


def n_words(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]: word starts are non-blanks that follow a blank or the start."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.filter(F.split(blank, " ", -1), lambda w: w != "")).cast("long")


def targets(sizes: list[int], weights: list[int], share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """Words per source: the whole by weight, capped at repeats times its size, the excess reshared by weight until none is above.

    Sorted by cap over weight, the capped sources are a prefix; the common rate of the rest follows from prefix sums."""
    total = share * sum(sizes)
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: (repeats * sizes[i] / weights[i], i))
    capped, open_weight, out = 0, sum(weights[i] for i in order), [0.0] * len(sizes)
    for at, i in enumerate(order):
        rate = (total - capped) / open_weight
        if repeats * sizes[i] / weights[i] > rate:
            for j in order[at:]:
                out[j] = rate * weights[j]
            break
        out[i] = float(repeats * sizes[i])
        capped, open_weight = capped + repeats * sizes[i], open_weight - weights[i]
    return out


def min_cost_flow(words: list[int], member: list[list[int]], quotas: list[int], repeats: int = REPEATS) -> list[list[int]]:
    """Flow[p][s]: words of pattern p that count for source s. Successive shortest paths; each path fills an arc, so their number
    is at most that of the arcs, which depends on patterns, sources and repeats alone."""
    P, S = len(words), len(quotas)
    n, graph = P + S + 2, [[] for _ in range(P + S + 2)]

    def arc(u: int, v: int, cap: int, cost: int) -> list[int]:
        a, b = [v, cap, cost, len(graph[v])], [u, 0, -cost, len(graph[u])]
        graph[u].append(a)
        graph[v].append(b)
        return a

    for p in range(P):
        for tier in range(repeats):
            arc(n - 2, p, words[p], tier)
    uses = [[(s, arc(p, P + s, repeats * words[p], 0)) for s in member[p]] for p in range(P)]
    for s in range(S):
        arc(P + s, n - 1, quotas[s], 0)
    while True:
        far, via, queue, inside = [None] * n, [None] * n, deque([n - 2]), [False] * n
        far[n - 2] = 0
        while queue:
            u = queue.popleft()
            inside[u] = False
            for a in graph[u]:
                if a[1] > 0 and (far[a[0]] is None or far[u] + a[2] < far[a[0]]):
                    far[a[0]], via[a[0]] = far[u] + a[2], (u, a)
                    if not inside[a[0]]:
                        inside[a[0]] = True
                        queue.append(a[0])
        if far[n - 1] is None:
            break
        push, v = None, n - 1
        while v != n - 2:
            u, a = via[v]
            push, v = a[1] if push is None else min(push, a[1]), u
        v = n - 1
        while v != n - 2:
            u, a = via[v]
            a[1] -= push
            graph[v][a[3]][1] += push
            v = u
    out = [[0] * S for _ in range(P)]
    for p in range(P):
        for s, a in uses[p]:
            out[p][s] = repeats * words[p] - a[1]
    return out


def seeded(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed_col: str | None = None) -> DataFrame:
    """id, size, source_size, target, taken per row. source_col may be one source or an array of sources; weights go to sources by code point, repeating. The seeded order goes by
    seed_col, which is the id unless another is named.

    A pattern's flow takes every document floor(flow / words) times; the rest is one more copy of the documents first in the seeded order, the last
    of which gives just the words that are missing. The order's prefix sums run in two levels: sums by hash bucket find the bucket in which a
    pattern's rest runs out, and only rows of that bucket are summed one by one, so no source is ever one task."""
    many = docs.schema[source_col].dataType.typeName() == "array"
    pattern = F.array_sort(F.array_distinct(F.col(source_col))) if many else F.array(F.col(source_col))
    rows = docs.select(F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("size"), pattern.alias("pattern"), seeded(F.col(seed_col or id_col), seed).alias("h"))
    rows = cut(rows.withColumn("bucket", F.conv(F.substring("h", 1, 2), 16, 10).cast("int")))
    by = cut(rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")))
    found = sorted(((tuple(r[0]) if r[0] is not None else (None,), int(r[1])) for r in by.groupBy("pattern").agg(F.sum("words")).collect()), key=lambda x: [(s is None, (s or "").encode("utf-32-be")) for s in x[0]])
    names = sorted({s for p, _ in found for s in p}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    at = {s: i for i, s in enumerate(names)}
    sizes = [sum(w for p, w in found if s in p) for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, repeats)
    flow = min_cost_flow([w for _, w in found], [[at[s] for s in p] for p, _ in found], [int(g) for g in goal], repeats)
    plan = []
    for (p, words), f in zip(found, flow, strict=True):
        full, rest = divmod(sum(f), words) if words else (0, 0)
        lead = max(range(len(names)), key=lambda s: (f[s], s in [at[x] for x in p], -s))
        plan.append((list(p), int(full), int(rest), sizes[lead], goal[lead]))
    table = F.broadcast(docs.sparkSession.createDataFrame(plan, "pattern array<string>, full long, rest long, source_size long, target double"))
    key = lambda c: F.transform(c, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("")))  # noqa: E731  nulls compare as values
    table = table.withColumn("key", key(F.col("pattern"))).drop("pattern")
    edge = by.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = edge.select(key(F.col("pattern")).alias("key"), "bucket", "before", "words").join(table.select("key", "rest"), "key")
    # Buckets: wholly within the rest, wholly beyond it, or the one in which it runs out.
    edge = edge.select("key", "bucket", "before", (F.col("before") + F.col("words") <= F.col("rest")).alias("inside"), ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))).alias("split"))
    keyed = rows.withColumn("key", key(F.col("pattern"))).drop("pattern").join(F.broadcast(edge), ["key", "bucket"]).join(table, "key")
    whole = keyed.filter(~F.col("split")).withColumn("more", F.when(F.col("inside"), F.col("size")).otherwise(F.lit(0)))
    run = F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    torn = keyed.filter("split").withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - run)))
    return whole.unionByName(torn).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("more")).cast("long").alias("taken"))
