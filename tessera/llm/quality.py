"""Quality rules: exact rule statistics, and an isolation forest over them whose threshold labelled rows calibrate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import overlay, packed, written

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: Trees of the forest, and documents that each is grown from: the forest's own parameters, the same at every size.
TREES, GROWN_FROM = 100, 256
#: Share of the labelled good documents that pass the base rules and must keep passing.
GOOD_KEPT = 0.999
#: Scores lie in (0, 1); the threshold is one of so many steps.
STEPS = 2000

#: Documents are compared with those of their length: bands of word counts by powers of two, the last one open.
LAST_BAND = 12

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_word", "f_symbol", "f_dup", "f_repeat", "f_upper", "f_punct", "f_short")
WINDOW = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes]) -> int:
    """Words within windows of WINDOW words that the list holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    # words are numbered within the document, so that equal windows have equal numbers
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    ranks = codes[:n]
    for k in range(1, WINDOW):  # rank pairs: each step's ranks stay below n, so a pair fits a long
        _, ranks = np.unique(ranks * (len(seen) + 1) + codes[k : k + n], return_inverse=True)
        if k == 1 and len(ranks) == (ranks.max() + 1):
            return 0
    again = np.bincount(ranks)[ranks] > 1
    if not again.any():
        return 0
    hit = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + WINDOW, -1)
    return int((np.cumsum(hit) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base statistics of a text, and the features of the forest."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    punct = len(raw) - len(raw.translate(None, b"!?.,;:"))
    m, c = max(n, 1), max(chars, 1)
    features = [
        chars / m, symbols / c, dup / max(len(lines), 1), repeat / m, upper / c, punct / m,
        sum(len(w) < 3 for w in words) / m,
    ]
    return [n, chars, symbols, dup, repeat], [float(x) for x in features]


def with_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, BASE and FEATURES for each row."""
    schema = T.StructType(
        [docs.schema[k] for k in keep]
        + [T.StructField(k, T.LongType()) for k in BASE]
        + [T.StructField(k, T.DoubleType()) for k in FEATURES]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py() or "") for x in batch.column(text)]
            cols = [batch.column(k) for k in keep]
            cols += [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(BASE))]
            cols += [pa.array([r[1][i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *BASE, *FEATURES])

    return docs.select(*keep, text).mapInArrow(run, schema)


class Forest:
    """An isolation forest in arrays: node k of a tree has the children left[k] and left[k] + 1, or is a leaf (-1)."""

    def __init__(self, rows: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = min(GROWN_FROM, len(rows))
        self.norm = self.expected(size)
        self.trees = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng, size) for _ in range(TREES)]

    @staticmethod
    def expected(n: int) -> float:
        """The mean path length of an unsuccessful search among n keys."""
        return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator, size: int) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(size, 2))))
        feature, cut, left, depth = [-1], [0.0], [-1], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            k, part, d = todo.pop()
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
            if d >= limit or len(spread) == 0:
                depth[k] = d + self.expected(len(part))
                continue
            f = int(rng.choice(spread))
            at = rng.uniform(part[:, f].min(), part[:, f].max())
            feature[k], cut[k], left[k] = f, at, len(left)
            low = part[:, f] <= at
            for side in (part[low], part[~low]):
                feature.append(-1), cut.append(0.0), left.append(-1), depth.append(0.0)
                todo.append((len(left) - 1, side, d + 1))
        return np.array(feature), np.array(cut), np.array(left), np.array(depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for rows that random splits isolate early."""
        total = np.zeros(len(rows))
        for feature, cut, left, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := left[at] >= 0).any():
                f = feature[at]
                right = rows[np.arange(len(rows)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, left[at] + right, at)
            total += depth[at]
        return np.exp2(-total / TREES / max(self.norm, 1e-9))


def _scored(stats: DataFrame, forest: Forest | None) -> DataFrame:
    keep = [c for c in stats.columns if c not in FEATURES]
    schema = T.StructType([stats.schema[k] for k in keep] + [T.StructField("__score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in FEATURES])
            score = forest.score(rows) if forest and len(rows) else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(score)], names=[*keep, "__score"])

    return stats.mapInArrow(run, schema)


def threshold(counts: list[tuple[int, int, int]]) -> int:
    """The step from which on documents go, from (step, good rows, bad rows) of labelled rows that pass the base rules.

    Of the steps that keep GOOD_KEPT of the good rows, the lowest; none goes unless most labelled rows above it are bad.
    """
    allowed = (1 - GOOD_KEPT) * sum(g for _, g, _ in counts)
    above_good = above_bad = 0
    best = STEPS + 1
    for step, g, b in sorted(counts, reverse=True):
        above_good, above_bad = above_good + g, above_bad + b
        if above_good > allowed:
            break
        if above_bad > above_good:
            best = step
    return best


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", filtering: bool = False
) -> DataFrame:
    """Rule statistics of every whole text, and whether the document is kept.

    A document fails the base rules with under 10 words, or with over 20 % of its words in repeated windows. Of the rest,
    those with an isolation score from their length band's threshold on go. The forest is grown from TREES x GROWN_FROM documents at most,
    taken in the order of a hash of their ids; every document is scored; all labelled rows (label 1: good) calibrate.
    Statistics are computed once, written, and joined back where the documents themselves are asked for.

    Returns the id and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean)
    and anomaly (double); with `filtering`, the rows of docs that are kept, with their own columns. A null text has no
    words and fails. Null ids or labels calibrate nothing. Without labels nobody is rejected by the forest. Rows are
    judged one by one, repeated or not. An empty table gives an empty one.
    """
    base = packed(docs, id_col, text_col)
    stats = written(with_statistics(base, "__text", ["__id", "__th"]), "quality-statistics")
    # tasks send about twice the sample in all, not each the whole of it
    want, n = TREES * GROWN_FROM, stats.count()
    share = min(2**31, 2**32 * want // max(n, 1))
    sample = stats.where((F.col("n_words") >= 10) & (F.pmod(F.xxhash64(F.lit(1), "__id", "__th"), F.lit(2**31)) < share))
    sample = sample.orderBy(F.xxhash64("__id", "__th"), "__id", "__th").limit(want).select(*FEATURES).toPandas()
    forest = Forest(sample.to_numpy()) if len(sample) > 1 else None
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = written(_scored(stats, forest).withColumn("__failed", failed), "quality-scores")
    said = labels.select(F.col(f"`{id_col}`").alias("__lid"), F.col(f"`{label_col}`").alias("__label")).where("__label IN (0, 1)")
    band = F.least(F.floor(F.log2(F.greatest("n_words", F.lit(1)))), F.lit(LAST_BAND)).cast("int")
    counts = (
        scored.where(~F.col("__failed"))
        .join(said, F.col("__id") == F.col("__lid"))
        .groupBy(band.alias("band"), F.floor(F.col("__score") * STEPS).cast("int").alias("step"))
        .agg(F.sum("__label").cast("long").alias("good"), F.sum(1 - F.col("__label")).cast("long").alias("bad"))
        .collect()
    )
    # a score goes if its step is its band's threshold or above it
    limits = [threshold([(r.step, r.good, r.bad) for r in counts if r.band == k]) for k in range(LAST_BAND + 1)]
    limit = F.get(F.array(*[F.lit(x) for x in limits]), band)
    kept = ~F.col("__failed") & (F.floor(F.col("__score") * STEPS) < limit)
    if not filtering:
        return scored.select(
            F.col("__id").alias(id_col), *BASE, F.col("__failed").alias("base_failed"), kept.alias("kept"), F.col("__score").alias("anomaly")
        )
    ok = scored.where(kept).select(F.col("__id").alias("__kid"), F.col("__th").alias("__kth"))
    rows = base.join(ok, F.col("__id").eqNullSafe(F.col("__kid")) & (F.col("__th") == F.col("__kth")), "left_semi")
    return overlay(rows, "__row", {})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
