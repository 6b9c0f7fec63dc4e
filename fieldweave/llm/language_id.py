"""Language ID by cross-parsing entropy.

Per language, labelled text builds a suffix automaton. A text is parsed greedily against it: the longest match from where the last phrase ended, again and again.
Few phrases mean that the language's text explains it well; phrases are normalised to bits a character by the size of the labelled text, and the language that needs fewest wins.

The automaton with its failure rule ("a match that cannot go on ends a phrase, the next begins here") is laid out as one dense table of state x symbol, so whole batches
of texts step through it in lockstep with NumPy. The table has the most frequent characters; transitions by others are kept sparse, so that different characters never match. Texts are cut into lanes of LANE symbols, each parsed on its own (one phrase more per lane, for every language alike);
every symbol of a text is read.

Cases: null text, or text without a letter, is `und` with score 0; ties go to the language first by code point; repeated rows get equal answers; with no labelled rows every
text is `und`; an empty table gives an empty result."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

LANE, SYMBOLS, UNDETERMINED = 256, 64, "und"
#: Bounds of the labelled sample: documents and normalised characters a language.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 24_000


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: the folded one (lower-cased; anything but letters and marks is a blank), and whether it is a letter."""
    fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha() or unicodedata.category(ch).startswith("M"):
            low = ch.lower()
            fold[c] = ord(low) if len(low) == 1 else c
            letter[c] = ch.isalpha()
    fold[0x20000:0x32000], letter[0x20000:0x32000] = np.arange(0x20000, 0x32000), True
    return fold, letter


_CACHE: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    if not _CACHE:
        _CACHE.append(_tables())
    return _CACHE[0]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeeze(folded: np.ndarray) -> np.ndarray:
    """Runs of blanks become one."""
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    return folded[keep]


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one sequence; state 0 is the root."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in seq:
        cur = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] != size[p] + 1:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                link[q] = clone
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                q = clone
            link[cur] = q
        last = cur
    return go


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # symbol of every code point; the greatest is that of characters in no labelled text
    parse: list[np.ndarray]  # per language: state * SYMBOLS + symbol -> next state * SYMBOLS * 2 + (1 if a phrase began)
    bits: list[float]  # bits that a phrase costs: log2 of the labelled length
    rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per language, symbols from SYMBOLS - 1 on: sorted state << 32 | symbol, what parse would hold there, and per symbol where a phrase that begins with it goes

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases per language and lane. lanes: position x lane, lanes sorted by falling length."""
        live = np.searchsorted(-lengths, -np.arange(lanes.shape[0]), side="left")
        out = np.zeros((len(self.langs), lanes.shape[1]), np.int32)
        dense, odd = np.minimum(lanes, SYMBOLS - 1).astype(np.uint8), [np.flatnonzero(row >= SYMBOLS - 1) for row in lanes]
        for k, table in enumerate(self.parse):
            keys, goes, begin = self.rare[k]
            v = np.zeros(lanes.shape[1], np.int32)
            n = np.ones(lanes.shape[1], np.int32)  # the first phrase
            for i in range(lanes.shape[0]):
                m = live[i]
                x = table[(v[:m] >> 1) + dense[i, :m]]
                if len(odd[i]):
                    at = odd[i][odd[i] < m]
                    c = lanes[i, at].astype(np.int64)
                    key = ((v[at] >> 1) // SYMBOLS).astype(np.int64) << 32 | c
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    x[at] = np.where(keys[place] == key, goes[place], begin[c - SYMBOLS + 1])
                v[:m] = x
                n[:m] += x & 1
            out[k] = n
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        fold, letter = tables()
        raw = [points(t) if t else np.zeros(0, np.uint32) for t in texts]
        known = np.array([bool(len(r)) and bool(letter[r].any()) for r in raw]) & bool(self.langs)
        seqs = [self.symbol[squeeze(fold[r])] if k else r[:0] for r, k in zip(raw, known, strict=True)]
        counts = np.array([-(-len(s) // LANE) for s in seqs])
        size = np.array([len(s) for s in seqs])
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not counts.sum():
            return langs, scores
        owner = np.repeat(np.arange(len(seqs)), counts)
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        part = np.arange(len(owner)) - first[owner]
        lengths = np.minimum(LANE, size[owner] - part * LANE)
        buf = np.zeros((len(owner), LANE), self.symbol.dtype)
        for i, s in enumerate(seqs):
            if counts[i]:
                buf[first[i] : first[i] + counts[i]].reshape(-1)[: len(s)] = s
        order = np.argsort(-lengths, kind="stable")
        per = self.phrases(np.ascontiguousarray(buf[order].T), lengths[order])
        bits = np.stack([np.bincount(owner[order], row, len(seqs)) * b for row, b in zip(per, self.bits, strict=True)])
        bits = bits / np.maximum(size, 1)
        best = bits.argmin(0)
        # Share of the best under weights 2^(-bits), the evidence held to 16 characters so that it stays a graded score.
        weight = np.exp2(-(bits - bits.min(0)) * np.minimum(size, 16))
        share = 1 / weight.sum(0)
        for i in np.flatnonzero(known):
            langs[i], scores[i] = self.langs[best[i]], float(share[i])
        return langs, scores


def build(samples: dict[str, list[str]], most_chars: int = SAMPLE_CHARS) -> Model:
    fold, _ = tables()
    text = {}
    for lang in sorted(samples):
        seq, left = [], most_chars
        for t in samples[lang]:
            x = squeeze(fold[points(t)])[: max(left, 0)]
            seq.append(x)
            left -= len(x)
        joined = np.concatenate(seq) if seq else np.zeros(0, np.uint32)
        if len(joined):
            text[lang] = joined
    known = [c for c, _ in sorted(Counter(int(c) for x in text.values() for c in x).items(), key=lambda p: (-p[1], p[0]))]
    absent = max(len(known), SYMBOLS - 1)
    symbol = np.full(0x110000, absent, np.min_scalar_type(absent))
    symbol[known] = np.arange(len(known))
    parse, bits, rare = [], [], []
    for x in text.values():
        go = suffix_automaton(symbol[x].tolist())
        begin = np.array([go[0].get(c, 0) * SYMBOLS * 2 + 1 for c in range(absent + 1)], np.int32)
        start = begin[:SYMBOLS]
        table = np.tile(start, (len(go), 1))
        for s, edges in enumerate(go):
            if often := [c for c in edges if c < SYMBOLS - 1]:
                table[s, often] = np.fromiter((edges[c] for c in often), np.int32, len(often)) * SYMBOLS * 2
        odd = sorted((s << 32 | c, v * SYMBOLS * 2) for s, edges in enumerate(go) if s for c, v in edges.items() if c >= SYMBOLS - 1) or [(-1, 0)]
        rare.append((np.array([k for k, _ in odd], np.int64), np.array([v for _, v in odd], np.int32), begin[SYMBOLS - 1 :]))
        table[0] = start  # a phrase that begins at the root is counted as it begins
        parse.append(table.reshape(-1))
        bits.append(float(np.log2(len(x) + 1)))
    return Model(list(text), symbol, parse, bits, rare)


def train(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars_per_lang: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from labelled rows outside the held-out fold: of each language those first in a hash order, up to the bounds.

    Counts per language (names only) set a hash cutoff that leaves about twice the wanted rows; only those rows' texts are read and numbered."""
    from pyspark.sql.window import Window

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    spread = F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1_000_000))
    counts = {r[0]: r[1] for r in docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(lang_col).count().collect()}
    if not counts:
        return build({})
    spark = docs.sparkSession
    cutoff = spark.createDataFrame([(k, int(min(1_000_000, 3_000_000 * docs_per_lang / n + 1))) for k, n in counts.items()], "__lang string, __cut long")
    near = rows.select(F.col(lang_col).alias("__lang"), spread.alias("__h"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(cutoff), "__lang").filter("__h < __cut")
    first = near.withColumn("__n", F.row_number().over(Window.partitionBy("__lang").orderBy("__h", "__id", "__text"))).filter(F.col("__n") <= docs_per_lang)
    samples: dict[str, list[str]] = {}
    for r in first.select("__lang", "__n", F.substring("__text", 1, chars_per_lang).alias("__text")).orderBy("__lang", "__n").toLocalIterator():
        samples.setdefault(r[0], []).append(r[2])
    return build(samples, chars_per_lang)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __lang and __score appended; every symbol of every text is read."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col):
            langs, scores = held.value.predict([t if t is None else t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "__lang", "__score"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "__lang string, __score double"])
    return docs.mapInArrow(scan, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score."""
    found = predict(docs.select(id_col, text_col), train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
