"""What five filters remove, alone and in every order: a filter interaction audit.

1. Duplicates by sorting: rows are range-sorted by (fingerprint, full text, doc_id) and compared with their predecessor. Ranges are cut by 192 bits of fingerprint, id and row number, so that
   no range bound holds a text, and a group of copies of any size spreads over as many ranges as it needs. The same pass over a sorted range finds the other failures.
2. Boundaries: the runs of equal texts that touch an end of their range are put out with their text and first id (two a range or so) and met by text; the first rows of a range are decided by that.
3. A row is then a mask of five bits. Counts per part and mask add up, and everything asked about any order is a sum over the 32 masks.

Cases: a null text is empty and fails A alone (and E, if an empty text has a smaller id); a null id neither fails E nor makes another row fail; rows of one id and text do not fail E by each other,
as neither id is smaller; a null part is the empty string; of several labels of one id, any good (toxic) one makes it good (toxic); rows without a label are neither; an empty table has no part and
so no row. Only the named columns are read, so further columns cannot clash."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, slices

#: The filters' letters, in the order of their bits, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes that continue a code point in UTF-8.
INNER = bytes(range(0x80, 0xC0))
DUPLICATE = 16


def failures(raw: bytes) -> int:
    """Bits of A to D of one text. bytes.split() parts at [\\x20\\x09-\\x0D], as the words are defined."""
    words = raw.split()
    size = len(raw.translate(None, INNER))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1 | (100 * capitals > CAPITAL_PERCENT * size) << 2 | (symbols > 0) << 3


def _sorted_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range in, masks out. `at` and `run` name the range and the run of rows that its boundary leaves undecided; rows with `edge` are the runs at its ends."""
    at, key, text, first, run, head = TaskContext.get().partitionId(), None, None, None, -1, True
    edges: list[tuple[int, bytes, int | None]] = []
    names = ["part", "id", "mask", "at", "run", "edge"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    ends = lambda: [(None, i, None, at, k, t.decode()) for k, t, i in edges]
    for batch, texts in slices(batches, "text"):
        rows = []
        col = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
        for raw, fp, digest, i, part in zip(texts, col("fp"), col("digest"), col("id"), col("part"), strict=True):
            if (fp, digest) != key:
                if head and key is not None:  # the first key ends here, and others begin
                    rows += ends()
                    head = False
                key, text, edges = (fp, digest), None, []
            if raw != text:
                text, first, run = raw, i, run + 1
                edges.append((run, text, first))
                bits = failures(raw)
            copy = i is not None and first is not None and first < i
            undecided = head and not copy and i is not None
            rows.append((part, i, bits | DUPLICATE * copy, at if undecided else None, run if undecided else None, None))
        if rows:
            yield out(rows)
    if edges:
        yield out(ends())


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, id, mask) of every row: bit k of the mask says that the row fails FILTERS[k]."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.select("id", "text", "part", F.xxhash64("text").alias("fp"), F.unhex(F.md5("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    ranges = rows.repartitionByRange("fp", "digest", F.asc_nulls_last("id"), "row").sortWithinPartitions("fp", "digest", "text", F.asc_nulls_last("id"))
    found = cut(ranges.select("id", "text", "part", "fp", "digest").mapInArrow(_sorted_range, "part string, id long, mask int, at int, run int, edge string"))
    edges = found.filter("edge IS NOT NULL")
    least = edges.groupBy("edge").agg(F.min("id").alias("least"))
    ends = edges.join(least, "edge").select("at", "run", "least")
    own = found.filter("edge IS NULL").join(maybe_broadcast(ends, found.filter("edge IS NOT NULL").count()), ["at", "run"], "left")
    return own.select("part", "id", F.when(F.col("least") < F.col("id"), F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def counters(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): the additive counters of rows (part, id, mask)."""
    flags = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    known = rows.filter("id IS NOT NULL").join(maybe_broadcast(flags), "id", "left").select("part", "mask", "good", "toxic")
    every = known.unionByName(rows.filter("id IS NULL").select("part", "mask"), allowMissingColumns=True)
    return every.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def every_order() -> list[tuple]:
    """(filter_order, step, mask, kept, removed, redundant, alone, shapley): what a row of a mask counts as at a step of an order; 120 * 5 * 32 rows, whatever the data.

    A filter removes a row in the orders in which it is the first of those that the row fails: 120 over their number."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            bit = 1 << k
            for mask in range(1 << len(FILTERS)):
                fails, gone = mask & bit != 0, mask & before != 0
                out.append((name, step, mask, int(mask & (before | bit) == 0), int(fails and not gone), int(fails and gone), int(mask == bit), 120 // mask.bit_count() if fails else 0))
            before |= bit
    return out


def orders(counts: DataFrame) -> DataFrame:
    """One row per part, order and step of counters()."""
    table = counts.sparkSession.createDataFrame(every_order(), "filter_order string, step int, mask int, k long, r long, d long, u long, s long")
    total = lambda flag, of, name: F.sum(F.col(flag) * F.col(of)).alias(name)
    sums = [total("k", "n", "kept"), total("r", "n", "removed"), total("d", "n", "redundant"), total("u", "n", "unique_fails"), total("r", "good", "good_lost"), total("r", "toxic", "toxic_lost"), total("s", "n", "shapley")]
    return counts.join(F.broadcast(table), "mask").groupBy("part", "filter_order", "step").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(counters(masks(docs, id_col, text_col, part_col), labels, id_col))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
m AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) good, max((toxic = 1)::INT) toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) n, coalesce(sum(good), 0) good, coalesce(sum(toxic), 0) toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter o FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT o, k step, f.bit, coalesce((SELECT sum(g.bit) FROM f g WHERE strpos(o, g.letter) < k), 0) before FROM o, range(1, 6) r(k), f WHERE f.letter = o[k])
SELECT part, o filter_order, step::INT step, sum(CASE WHEN mask & (before::INT | bit) = 0 THEN n ELSE 0 END)::BIGINT kept,
  sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN n ELSE 0 END)::BIGINT removed, sum(CASE WHEN mask & bit > 0 AND mask & before::INT > 0 THEN n ELSE 0 END)::BIGINT redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN good ELSE 0 END)::BIGINT good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN toxic ELSE 0 END)::BIGINT toxic_lost, sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT shapley
FROM c, s GROUP BY ALL
"""
