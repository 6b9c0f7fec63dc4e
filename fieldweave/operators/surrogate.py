"""Surrogates and null models: IAAFT series, event-synchronisation nulls, and the low-pass filter of event counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .field import rolling_mean, shuffled
from .graph import spread
from .lineage import settle
from .similarity import event_sync

LEVELS = (0.25, 0.5, 0.75, 0.95, 0.98, 0.99, 0.995, 0.999)


def _seed(*parts: int) -> np.random.RandomState:
    return np.random.RandomState(np.array([p % (1 << 32) for p in parts], np.uint32))


def iaaft_series(x: np.ndarray, rng: np.random.RandomState, rounds: int = 1000) -> np.ndarray:
    """A permutation of x with nearly its power spectrum (Schreiber and Schmitz 1996); ends when the order of values settles."""
    target, ordered = np.abs(np.fft.rfft(x)), np.sort(x)
    now, last = rng.permutation(x), None
    for _ in range(rounds):
        f = np.fft.rfft(now)
        size = np.abs(f)
        shaped = np.fft.irfft(target * np.where(size > 0, f / np.where(size > 0, size, 1.0), 1.0), len(x))
        rank = np.argsort(np.argsort(shaped, kind="stable"), kind="stable")
        now = ordered[rank]
        if last is not None and np.array_equal(rank, last):
            break
        last = rank
    return now


def iaaft_ranks(x: np.ndarray, rngs: list[np.random.RandomState], rounds: int = 1000) -> np.ndarray:
    """Of each generator the series of iaaft_series, all in one, as places in the sorted x: generators x times."""
    target, ordered = np.abs(np.fft.rfft(x)), np.sort(x)
    now = np.stack([rng.permutation(x) for rng in rngs])
    out, last, live = np.empty(now.shape, np.int64), np.full(now.shape, -1), np.arange(len(rngs))
    for _ in range(rounds):
        f = np.fft.rfft(now)
        size = np.abs(f)
        shaped = np.fft.irfft(target * np.where(size > 0, f / np.where(size > 0, size, 1.0), 1.0), len(x))
        rank = np.empty(now.shape, np.int64)
        np.put_along_axis(rank, np.argsort(shaped, kind="stable"), np.arange(len(x))[None, :], 1)
        out[live] = rank
        moves = (rank != last).any(1)
        live, last, now = live[moves], rank[moves], ordered[rank[moves]]
        if not len(live):
            break
    return out


def iaaft(field: DataFrame, n: int, seed: int = 0, rounds: int = 1000) -> DataFrame:
    """(k, node, t, v): n surrogates of each node's series. Series are groups of one node and surrogate, so tasks hold one series each."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        pdf["v"] = iaaft_series(pdf["v"].to_numpy(float), _seed(seed, int(pdf["k"].iloc[0]), int(pdf["node"].iloc[0])), rounds)
        return pdf

    many = field.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "node", "t", F.col("v").cast("double").alias("v"))
    return many.groupBy("k", "node").applyInPandas(one, many.schema)


def null_limits(pairs: DataFrame, q: float) -> DataFrame:
    """(i, j, limit): the quantile of |r| over surrogates (k, i, j, r)."""
    return pairs.groupBy("i", "j").agg(F.percentile(F.abs("r"), q).alias("limit"))


def iaaft_limits(field: DataFrame, n: int, q: float, seed: int = 0, rounds: int = 1000, block: int = 200, only_over: bool = False) -> DataFrame:
    """(i, j, r, limit), i < j: the correlation of every pair of nodes and the quantile of |r| over n surrogate pairs, those of iaaft; with only_over, of the pairs whose |r| exceeds it alone. Nodes
    without variance are left out.

    Series are drawn once and written, a row a block of as many nodes at most, as places in the sorted series, one byte a time of up to 256 times. Pairs of blocks are a product of that table with itself without a
    shuffle: a task reads two of its parts, correlates matching series of two blocks at a time (the series themselves are the first) and gives numbers of pairs only."""
    spark = field.sparkSession
    series = field.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("t", F.col("v").cast("double").alias("v")))).alias("x")).select(F.col("node").cast("int").alias("node"), F.col("x.v").alias("v"))
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-field.select("node").distinct().count() // block))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, values, ranks = [], [], []

        def row() -> pd.DataFrame:
            return pd.DataFrame({"nodes": [nodes], "v": [np.concatenate(values)], "ranks": [b"".join(ranks)]})

        for b in batches:
            for node, v in zip(b["node"], b["v"], strict=True):
                x = np.asarray(v, float)
                if x.std() > 0:
                    own = np.argsort(np.argsort(x, kind="stable"), kind="stable")
                    every = np.concatenate([own[None], iaaft_ranks(x, [_seed(seed, k, int(node)) for k in range(n)], rounds)])
                    nodes.append(node)
                    values.append(np.sort(x))
                    ranks.append(every.astype(np.min_scalar_type(len(x) - 1)).tobytes())
                    if len(nodes) == block:
                        yield row()
                        nodes, values, ranks = [], [], []
        if nodes:
            yield row()

    drawn = settle(series.repartition(parts, "node").mapInPandas(draw, "nodes array<int>, v array<double>, ranks binary"))
    a, b = (drawn.select(*(F.col(c).alias(f"{c}_{side}") for c in drawn.columns)) for side in "ab")
    pairs = a.hint("shuffle_replicate_nl").join(b, F.col("nodes_a")[0] <= F.col("nodes_b")[0])  # a node is in one block

    def scores(nodes: np.ndarray, values: np.ndarray, raw: bytes) -> np.ndarray:
        """series (the nodes' own, then surrogates) x nodes x times"""
        values = np.asarray(values, float).reshape(len(nodes), -1)
        times = values.shape[1]
        ranks = np.frombuffer(raw, np.min_scalar_type(times - 1)).reshape(len(nodes), n + 1, times)
        out = np.empty((n + 1, len(nodes), times))
        for at, x in enumerate(values):
            out[:, at] = ((x - x.mean()) / x.std())[ranks[at]]
        return out

    def limits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, None
        for r in (r for batch in batches for r in batch.itertuples(index=False)):
            if last != r.nodes_a[0]:  # pairs come by the first of them
                last, x = r.nodes_a[0], scores(r.nodes_a, r.v_a, r.ranks_a)
            same, ids = r.nodes_a[0] == r.nodes_b[0], np.asarray(r.nodes_b)
            y = np.ascontiguousarray((x if same else scores(r.nodes_b, r.v_b, r.ranks_b)).transpose(0, 2, 1))
            step = max(1, 4_000_000 // (n * len(ids)))
            for at in range(0, x.shape[1], step):
                corr = np.round(x[:, at : at + step] @ y / x.shape[2], 6)
                own = corr[0]
                limit = np.quantile(np.ascontiguousarray(np.abs(corr[1:]).transpose(1, 2, 0)), q, axis=2, overwrite_input=True)
                one = np.repeat(np.asarray(r.nodes_a)[at : at + step], len(ids)).reshape(limit.shape)
                keep = one < ids if same else one != ids
                keep = keep & (np.abs(own) > limit) if only_over else keep
                two = np.broadcast_to(ids, limit.shape)
                yield pd.DataFrame({"i": np.minimum(one, two)[keep], "j": np.maximum(one, two)[keep], "r": own[keep], "limit": limit[keep]})

    return pairs.mapInPandas(limits, "i int, j int, r double, limit double")


def es_null(spark: SparkSession, counts: DataFrame, n_times: int, taumax: int, draws: int = 1000, levels: tuple[float, ...] = LEVELS, seed: int = 0, slices: int = 16) -> DataFrame:
    """(n1, n2, q array): quantiles of synchronised events when n1 and n2 events fall anywhere among n_times.

    counts: the distinct pairs (n1, n2) of event counts. Pairs and slices of draws are spread over tasks; a task holds the draws of one slice only, as numbers. Only the
    counts, one long a draw, are shuffled."""
    step = -(-draws // slices)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n1, n2, s in zip(b["n1"], b["n2"], b["s"], strict=True):
                rng = _seed(seed, int(n1), int(n2), int(s))
                here = min(step, draws - s * step)
                a, b = (np.sort(rng.random_sample((here, n_times)).argpartition(n - 1, axis=1)[:, :n], axis=1) for n in (n1, n2))
                yield pd.DataFrame({"n1": n1, "n2": n2, "es": np.concatenate([synchronised_each(a[k : k + 64], b[k : k + 64], taumax) for k in range(0, here, 64)])})

    tasks = counts.select(F.col("n1").cast("int"), F.col("n2").cast("int")).distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // step) - 1)))).repartition("n1", "n2", "s")
    return tasks.mapInPandas(draw, "n1 int, n2 int, es double").groupBy("n1", "n2").agg(F.percentile("es", F.array(*map(F.lit, levels))).alias("q"))


def synchronised_each(a: np.ndarray, b: np.ndarray, taumax: float) -> np.ndarray:
    """For each row of sorted times, events of a that follow one of b within tau: half the least gap around both events, at most taumax; equal times count one half."""
    gap = lambda t: np.minimum(np.diff(t, prepend=-np.inf, axis=1), np.diff(t, append=np.inf, axis=1))
    d = a[:, :, None] - b[:, None, :]
    tau = np.minimum(np.minimum(gap(a)[:, :, None], gap(b)[:, None, :]) / 2, taumax)
    return ((d > 0) & (d <= tau)).sum((1, 2)) + 0.5 * (d == 0).sum((1, 2))


def synchronised(a: np.ndarray, b: np.ndarray, taumax: float) -> float:
    """One row of synchronised_each."""
    return float(synchronised_each(a[None], b[None], taumax)[0])


def es_edges(es: DataFrame, events: DataFrame, null: DataFrame, levels: tuple[float, ...] = LEVELS, q_sig: float = 0.95, q_med: float = 0.5, lq: float = 0.25, hq: float = 0.75, at_least: float = 2) -> DataFrame:
    """(src, dst, es, weight): pairs whose count exceeds the null's q_sig quantile for their numbers of events; weight is (es - median) / (hq - lq), null where the spread is 0.

    Pairs stay where they are: numbers of events and the null, a row a pair of numbers, go to every task if they are small."""
    n, null = settle(events.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("n"))), settle(null)
    x = es.join(spread(n.select(F.col("node").alias("i"), F.col("n").alias("n1"))), "i").join(spread(n.select(F.col("node").alias("j"), F.col("n").alias("n2"))), "j").join(spread(null), ["n1", "n2"])
    q = lambda level: F.col("q")[levels.index(level)]
    weight = F.try_divide(F.col("es") - q(q_med), q(hq) - q(lq))
    return x.filter((F.col("es") > q(q_sig)) & (F.col("es") >= at_least)).select(F.col("i").alias("src"), F.col("j").alias("dst"), "es", weight.alias("weight"))


def control_events(events: DataFrame, **windows) -> DataFrame:
    """(node, t): days of the events of (node, t, event) after shuffled(), whose windows may be given."""
    mixed = shuffled(events.select("node", "t", F.col("event").alias("v")), **windows)
    return mixed.filter("v = 1").select("node", F.unix_date("t").alias("t"))


def control_network(events: DataFrame, taumax: int, draws: int = 3000, **windows) -> DataFrame:
    """(src, dst, es, weight): the network of shuffled events. Shuffling within windows keeps each node's number of events, and so the null that a pair is held against."""
    ev = settle(control_events(events, **windows))
    n = ev.groupBy("node").agg(F.count(F.lit(1)).alias("n")).select("n").distinct()
    steps = events.select("t").distinct().count()
    counts = n.withColumnRenamed("n", "n1").join(n.withColumnRenamed("n", "n2"))  # numbers of events, at most as many as times
    return es_edges(event_sync(ev, taumax, 2), ev, es_null(ev.sparkSession, counts, steps, taumax, draws))


def sync_series(a: DataFrame, b: DataFrame, taumax: int) -> DataFrame:
    """(t, n): how many events (node, t) of region a at t follow an event of region b by more than nothing and at most taumax. An equi-join on time buckets."""
    x = a.select("t", F.floor(F.col("t") / taumax).alias("c"))
    y = b.select(F.col("t").alias("u"), F.explode(F.array(F.floor(F.col("t") / taumax), F.floor(F.col("t") / taumax) + 1)).alias("c"))
    return x.join(y, "c").filter((F.col("t") > F.col("u")) & (F.col("t") - F.col("u") <= taumax)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def local_maxima(series: DataFrame, q: float) -> DataFrame:
    """(t, v) above both neighbours and above the quantile of all values. The series is one region's, bounded by its times."""
    w = Window.orderBy("t")
    s = series.withColumn("before", F.lag("v").over(w)).withColumn("after", F.lead("v").over(w))
    limit = series.agg(F.percentile("v", q).alias("limit"))
    return s.join(F.broadcast(limit), F.lit(True)).filter("v > before AND v > after AND v > limit").select("t", "v")


def sync_times(a: DataFrame, b: DataFrame, times: DataFrame, taumax: int, q: float = 0.99, cutoff: float | None = None, mean_of: int | None = None) -> DataFrame:
    """(way, t, v, peak) of two regions' events (node, t) at all times (t), both ways: `a_after_b` counts events of a that follow one of b, `b_after_a` the reverse. The series may be low-pass filtered (cutoff as in
    low_pass; 0.475 leaves out what repeats within about four steps) and then averaged over the last times. A peak is above both neighbours and above the way's quantile, at nine places."""
    both = sync_series(a, b, taumax).withColumn("way", F.lit("a_after_b")).unionByName(sync_series(b, a, taumax).withColumn("way", F.lit("b_after_a")))
    every = times.select("t").distinct().withColumn("way", F.explode(F.array(F.lit("a_after_b"), F.lit("b_after_a"))))
    s = every.join(both, ["way", "t"], "left").select("way", "t", F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    s = s if cutoff is None else low_pass(s, "way", cutoff)
    s = s if mean_of is None else rolling_mean(s.withColumnRenamed("way", "node"), mean_of).withColumnRenamed("node", "way")
    w = Window.partitionBy("way").orderBy("t")
    s = s.withColumn("v", F.round("v", 9)).withColumns({"before": F.lag("v").over(w), "after": F.lead("v").over(w)})
    limit = s.groupBy("way").agg(F.round(F.percentile("v", q), 9).alias("limit"))
    peak = (F.col("v") > F.col("before")) & (F.col("v") > F.col("after")) & (F.col("v") > F.col("limit"))
    return s.join(F.broadcast(limit), "way").select("way", "t", "v", F.coalesce(peak, F.lit(False)).alias("peak"))


def chebyshev_sections(cutoff: float, order: int = 8, ripple: float = 0.05) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a type I low-pass: analogue poles on an ellipse, mapped by the bilinear transform. cutoff is a fraction of half the sampling rate; order is even."""
    e = np.sqrt(10 ** (ripple / 10) - 1)
    mu, warp = np.arcsinh(1 / e) / order, 2 * np.tan(np.pi * cutoff / 2)
    theta = np.pi * (2 * np.arange(1, order // 2 + 1) - 1) / (2 * order)
    poles = warp * (-np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta))
    z = (2 + poles) / (2 - poles)
    out = []
    for k, p in enumerate(z):
        a = np.array([1.0, -2 * p.real, abs(p) ** 2])
        gain = a.sum() / 4 * (10 ** (-ripple / 20) if k == 0 else 1.0)  # an even order has its ripple's low point at frequency 0
        out.append((gain * np.array([1.0, 2.0, 1.0]), a))
    return out


def chebyshev_filter(x: np.ndarray, cutoff: float, order: int = 8, ripple: float = 0.05) -> np.ndarray:
    """Filtered forward and backward, so without delay; ends are extended by point reflection."""
    pad = min(3 * (order + 1), len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x.astype(float)
    for _ in range(2):
        for b, a in chebyshev_sections(cutoff, order, ripple):
            s1 = y[0] * (b.sum() / a.sum() - b[0])  # the state that a constant input would have left
            s2 = y[0] * (b[2] - a[2] * b.sum() / a.sum())
            out = np.empty(len(y))
            for i, v in enumerate(y):
                out[i] = b[0] * v + s1
                s1, s2 = b[1] * v - a[1] * out[i] + s2, b[2] * v - a[2] * out[i]
            y = out
        y = y[::-1]
    return y[pad : pad + len(x)] if pad > 0 else y


def low_pass(series: DataFrame, key: str, cutoff: float, order: int = 8, ripple: float = 0.05) -> DataFrame:
    """(key, t, v) filtered per key. One series is one group: its length is the number of times, not of points."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        pdf["v"] = chebyshev_filter(pdf["v"].to_numpy(float), cutoff, order, ripple)
        return pdf

    s = series.select(key, "t", F.col("v").cast("double").alias("v"))
    return s.groupBy(key).applyInPandas(one, s.schema)


def events_at(field: DataFrame, qs: tuple[float, ...], at_least: float = 1.0, extreme: float = 15.0) -> DataFrame:
    """(q, node, t, event) for several quantiles in one pass over the field."""
    if any(not isinstance(q, float) for q in qs):
        raise ValueError("quantiles are floats")
    limits = field.filter(F.col("v") >= at_least).groupBy("node").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("limits"))
    pairs: Column = F.posexplode(F.coalesce("limits", F.array(*(F.lit(None).cast("double") for _ in qs))))
    x = field.join(limits, "node", "left").select("node", "t", "v", pairs.alias("at", "limit"))
    return x.select(F.array(*map(F.lit, qs))[F.col("at")].alias("q"), "node", "t", F.when((F.col("v") > F.col("limit")) & (F.col("v") >= extreme), 1).otherwise(0).alias("event"))
