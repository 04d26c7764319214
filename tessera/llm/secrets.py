"""Secret scans: patterns, and long runs whose characters pass a battery of randomness tests."""

from __future__ import annotations

from functools import reduce
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import overlay, packed, written
from .spans import find_spans, joined

#: Fixed values of the base scan. Possessive loops match the same and don't recurse.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]++", "hex": r"[0-9a-f]{16,}+"}
#: The same, for a whole match: group 1 is the value.
ASSIGN_PARTS = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Candidates of the battery.
RUN = r"[A-Za-z0-9+/_=-]{20,}+"
#: Pieces of a run that no alphabet holds: what stands between inner "=", and of these the ones that mix signs of two
#: alphabets, cut at those of one, of the other and of both.
VALUE = {"value": r"[^=]{20,}+(?:=++\z)?"}
PARTS = {"url": r"[^/+]{20,}+", "std": r"[^_-]{20,}+", "word": r"[^/+_-]{20,}+"}
ORDER = ["assign", "access", "hex", "random"]
#: What ordinary runs are put together from.
SYLLABLES = ("the", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "ung", "ver", "sch", "ion", "que")

#: Encodings, from the narrowest, with their alphabets; a run belongs to the first that holds it.
ALPHABETS = {
    "digits": ("^[0-9]+$", "0123456789"),
    "upper_hex": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base26": ("^(?:[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    "base36": ("^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base52": ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": ("^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": ("^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
#: Lengths are compared within bands that start here.
BANDS = (20, 28, 40, 64, 128)
#: The share of false discoveries that a group may hold, the steps of its threshold, and the ordinary runs it is set by.
FALSE_SHARE, STEPS, ORDINARY = 0.1, 100, 400


def _normal_cdf(z: Column) -> Column:
    return 1 / (1 + F.exp(-1.5976 * z - 0.070565992 * z * z * z))


def _two_sided(z: Column) -> Column:
    return 2 * _normal_cdf(-F.abs(z))


def randomness(tokens: DataFrame) -> DataFrame:
    """p, the chance of so odd a token among uniform random ones of its encoding and length, for the column `match`.

    Fisher's combination of three tests of the symbols' places in the inferred alphabet: chi-squared uniformity, runs
    about the middle of the alphabet, and serial correlation at lag one. Tokens of no encoding are left out.
    """
    encoding = alphabet = None
    for name, (pattern, symbols) in ALPHABETS.items():
        hit = F.col("match").rlike(pattern)
        encoding = F.when(hit, F.lit(name)) if encoding is None else encoding.when(hit, F.lit(name))
        alphabet = F.when(hit, F.lit(symbols)) if alphabet is None else alphabet.when(hit, F.lit(symbols))
    rows = tokens.withColumn("encoding", encoding).withColumn("__abc", alphabet).where("encoding IS NOT NULL")
    body = F.when(F.col("encoding").isin("base26", "base36"), F.lower("match")).otherwise(F.col("match"))
    rows = rows.withColumn("__c", F.filter(F.split(F.rtrim(body, F.lit("=")), ""), lambda c: c != ""))
    rows = rows.withColumn("__v", F.expr("transform(__c, c -> locate(c, __abc) - 1)")).withColumn("__n", F.size("__v").cast("double"))
    rows = rows.withColumn("__a", F.length("__abc").cast("double"))
    # equal symbols are neighbours after sorting: their counts squared, in one pass
    start = F.struct(F.lit(-1).alias("v"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    squares = F.aggregate(
        F.array_sort("__v"),
        start,
        lambda x, v: F.struct(
            v.alias("v"), F.when(v == x["v"], x["c"] + 1.0).otherwise(F.lit(1.0)).alias("c"), (x["s"] + F.when(v == x["v"], 2 * x["c"] + 1.0).otherwise(F.lit(1.0))).alias("s")
        ),
        lambda x: x["s"],
    )
    chi, df = F.col("__a") / F.col("__n") * squares - F.col("__n"), F.col("__a") - 1
    # the statistic's own variance, 2 df (n - 1) / n, which matters where a token is shorter than its alphabet
    z_chi = (chi - df) / F.sqrt(2 * df * (F.col("__n") - 1) / F.col("__n"))
    half = F.transform("__v", lambda v: F.when(v * 2 >= F.length("__abc"), 1).otherwise(0))
    rows = rows.withColumn("__z1", z_chi).withColumn("__h", half)
    n1 = F.aggregate("__h", F.lit(0), lambda s, x: s + x).cast("double")
    runs = F.aggregate(
        "__h", F.struct(F.lit(-1).alias("h"), F.lit(0).alias("r")), lambda x, h: F.struct(h.alias("h"), (x["r"] + F.when(h == x["h"], 0).otherwise(1)).alias("r")), lambda x: x["r"]
    )
    rows = rows.withColumn("__n1", n1).withColumn("__r", runs.cast("double")).withColumn("__n0", F.col("__n") - F.col("__n1"))
    product = 2 * F.col("__n1") * F.col("__n0")
    mean_r, var_r = product / F.col("__n") + 1, product * (product - F.col("__n")) / (F.col("__n") * F.col("__n") * (F.col("__n") - 1))
    z_runs = F.when(var_r > 0, (F.col("__r") - mean_r) / F.sqrt(var_r)).otherwise(F.lit(9.0))
    m = F.aggregate("__v", F.lit(0.0), lambda s, v: s + v, lambda s: s / F.col("__n"))
    rows = rows.withColumn("__z2", z_runs).withColumn("__m", m)
    moments = F.aggregate(
        "__v",
        F.struct(F.lit(None).cast("double").alias("d"), F.lit(0.0).alias("c"), F.lit(0.0).alias("q")),
        lambda x, v: F.struct(
            (v - F.col("__m")).alias("d"),
            (x["c"] + F.coalesce(x["d"] * (v - F.col("__m")), F.lit(0.0))).alias("c"),
            (x["q"] + (v - F.col("__m")) * (v - F.col("__m"))).alias("q"),
        ),
    )
    rows = rows.withColumn("__k", moments)
    z_serial = F.when(F.col("__k.q") > 0, (F.col("__k.c") / F.col("__k.q") + 1 / (F.col("__n") - 1)) * F.sqrt("__n")).otherwise(F.lit(9.0))
    logs = [F.log(F.greatest(p, F.lit(1e-300))) for p in (1 - _normal_cdf(F.col("__z1")), _two_sided(F.col("__z2")), _two_sided(z_serial))]
    half_x = -(logs[0] + logs[1] + logs[2])
    p = F.exp(-half_x) * (1 + half_x + half_x * half_x / 2)
    return rows.withColumn("p", p).select(*tokens.columns, "encoding", "p")


def _pieces(runs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The matches of `kinds` within runs, with their places in the text."""
    inner = find_spans(runs.select(F.struct("__id", "s").alias("__id"), "__th", F.col("match").alias("__text")), kinds)
    at = F.col("__id.s")
    out = inner.select(F.col("__id.__id").alias("__id"), "__th", (at + F.col("s")).alias("s"), (at + F.col("e")).alias("e"), "match")
    return out.dropDuplicates(["__id", "__th", "s", "e"])


def candidates(runs: DataFrame) -> DataFrame:
    """What of the runs is tested: those that an alphabet holds, and the pieces of the others of 20 characters or more."""
    held = reduce(lambda a, b: a | b, [F.col("match").rlike(pattern) for pattern, _ in ALPHABETS.values()])
    runs = runs.select("__id", "__th", "s", "e", "match")
    values = _pieces(runs.where(~held), VALUE)
    parts = _pieces(values.where(~held), PARTS)
    return runs.where(held).unionByName(values.where(held)).unionByName(parts)


def ordinary(encoding: str, length: int, r: Random) -> str:
    """A run of an encoding's signs that nobody drew at random: words, names, paths, dates, counters put together."""

    def word() -> str:
        return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))

    def number() -> str:
        return r.choice((str(r.randint(0, 99)), f"{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}{r.randint(1, 12):02}{r.randint(1, 28):02}", f"{r.randint(0, 9999):06}", r.choice("0123456789") * r.randint(2, 6)))

    def part() -> str:
        if encoding == "digits":
            return number()
        if encoding == "upper_hex":
            return r.choice((number(), "0" * r.randint(2, 8), r.choice(("dead", "beef", "cafe", "face", "feed", "c0de", "ff" * r.randint(1, 4), "a0", "7f"))))
        if encoding == "base26":
            return word()
        if encoding == "base52":
            return word().capitalize()
        if encoding in ("base32", "base36"):
            return word() if r.random() < 0.7 else str(r.randint(2, 7)) * r.randint(1, 4)
        if encoding == "base62":
            return word().capitalize() if r.random() < 0.7 else number()
        sign = "/" if encoding == "base64" else r.choice("-_")
        return sign + (r.choice((word(), word().capitalize())) if r.random() < 0.75 else number())

    out = part()
    while len(out) < length:
        out += part()
    out = out[:length].lstrip("/-_").ljust(length, "a" if encoding not in ("digits", "upper_hex") else "0")
    return out.upper() if encoding in ("upper_hex", "base32") else out


_null: dict[tuple[str, int], list[int]] = {}


def ordinary_steps(spark: SparkSession) -> dict[tuple[str, int], list[int]]:
    """How many of the ordinary runs of an encoding and length band reach each step of p, or more."""
    if not _null:
        r = Random(3)
        made = [(k, e, ordinary(e, r.randint(BANDS[k], 2 * BANDS[k] if k + 1 == len(BANDS) else BANDS[k + 1] - 1), r)) for k in range(len(BANDS)) for e in ALPHABETS for _ in range(ORDINARY)]
        texts = spark.range(1).select(F.posexplode(F.split(F.lit(" ".join(t for *_, t in made)), " ")).alias("at", "match"))
        step = F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")
        steps: dict[tuple[str, int], list[int]] = {(e, k): [] for e in ALPHABETS for k in range(len(BANDS))}
        spread = texts.repartition(spark.sparkContext.defaultParallelism)  # one row of text would be one task's
        for row in randomness(spread).select("at", step).collect():  # as many rows as there are ordinary runs
            k, e, _ = made[row["at"]]  # judged with those it was made like, be its alphabet narrower by chance
            steps[e, k].append(row.step)
        _null.update({g: [sum(x >= s for x in found) for s in range(STEPS)] for g, found in steps.items()})
    return _null


def thresholds(counts: dict[tuple[str, int], dict[int, int]], null: dict[tuple[str, int], list[int]]) -> dict[tuple[str, int], int]:
    """The lowest step of p from which on a group's tokens are taken for random, by encoding and band.

    A token's chance of being ordinary all the same is the share of ordinary runs of its encoding and length that reach
    its step (with one more on their side, as for any rank test). Of a group's tokens so large a share is expected to be
    taken by mistake; the lowest step goes at which that is FALSE_SHARE of those taken, at most (Benjamini and
    Hochberg). This holds for a group of one as for any other: it is taken if fewer than a tenth of ordinary runs look
    as random. The tests need not be independent, as nothing but the ordinary runs' own p is used.
    """
    out = {}
    for group, by_step in counts.items():
        reach, total = null[group], sum(by_step.values())
        for step in range(1, STEPS):
            taken = sum(n for s, n in by_step.items() if s >= step)
            if taken and total * (reach[step] + 1) / (reach[0] + 1) <= FALSE_SHARE * taken:
                out[group] = step
                break
    return out


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text: assignments, access keys, hexadecimal runs, and random-looking runs.

    The base spans are the matches of PATTERNS that are long enough. Other runs of 20 characters or more, be they letters,
    digits or both, go through randomness(), in pieces where no alphabet holds them (candidates()); the p of all of them,
    counted by encoding, length band and step, set a threshold for each group (thresholds()), so that short runs, which
    tests tell apart less well, answer for themselves. Those that lie in a base span are found already and don't count.
    Pieces found random that overlap are one span. SQL functions only; matches are few against the text, and only they
    are shuffled.

    Returns the columns of docs, and n_assign, n_access, n_hex (long), base_spans and spans (strings of kind:start:end,
    code points, by start and kind); columns of these names are replaced. A null text is empty and has no spans. Repeated
    rows get the same spans each; null ids are served like others. An empty table gives an empty one.
    """
    base = packed(docs, id_col, text_col)
    rows = written(find_spans(base, PATTERNS | {"run": RUN}), "secret-spans")
    value = F.regexp_extract("match", ASSIGN_PARTS, 1)
    long_enough = (
        F.when(F.col("kind") == "assign", F.length(value) >= 12)
        .when(F.col("kind") == "access", F.length("match") >= 18)
        .otherwise(F.col("kind") == "hex")
    )
    sure = rows.where(long_enough).select("__id", "__th", "kind", "s", "e")
    band = F.lit(0)
    for k in BANDS[1:]:
        band = band + F.when(F.col("e") - F.col("s") >= k, 1).otherwise(0)
    pieces = candidates(rows.where(F.col("kind") == "run")).unionByName(sure.select("__id", "__th", "s", "e", F.lit(None).cast("string").alias("match")))
    # the furthest end of base spans that start no later: what ends there or before lies in one
    base_end = F.max(F.when(F.col("match").isNull(), F.col("e"))).over(Window.partitionBy("__id", "__th").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = pieces.withColumn("__in", F.coalesce(base_end >= F.col("e"), F.lit(False))).where("match IS NOT NULL AND NOT __in").drop("__in")
    tested = randomness(pieces).withColumn("band", band)
    tested = written(tested.withColumn("step", F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)).cast("int")).withColumn("token", F.xxhash64("match")).drop("match"), "secret-tests")
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in tested.groupBy("encoding", "band", "step").agg(F.count_distinct("token").alias("n")).collect():  # encodings x bands x steps
        counts.setdefault((r.encoding, r.band), {})[r.step] = r.n
    limit = F.lit(STEPS)
    for (encoding, k), step in thresholds(counts, ordinary_steps(docs.sparkSession)).items():
        limit = F.when((F.col("encoding") == encoding) & (F.col("band") == k), F.lit(step)).otherwise(limit)
    # pieces of a run can overlap: those become one
    by_start = Window.partitionBy("__id", "__th").orderBy("s", "e")
    reach = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    added = tested.where(F.col("step") >= limit).withColumn("__new", F.when(reach > F.col("s"), 0).otherwise(1))
    added = added.withColumn("__group", F.sum("__new").over(by_start)).groupBy("__id", "__th", "__group").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    added = added.select("__id", "__th", F.lit("random").alias("kind"), "s", "e")
    both = sure.unionByName(added).groupBy(F.col("__id").alias("__sid"), F.col("__th").alias("__sth"))
    per_doc = sure.groupBy(F.col("__id").alias("__bid"), F.col("__th").alias("__bth")).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PATTERNS], joined(sure, ORDER).alias("base_spans")
    )
    every = both.agg(joined(sure, ORDER).alias("spans"))
    out = base.join(per_doc, F.col("__id").eqNullSafe(F.col("__bid")) & (F.col("__th") == F.col("__bth")), "left")
    out = out.join(every, F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__th") == F.col("__sth")), "left")
    new = {f"n_{k}": F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long") for k in PATTERNS}
    return overlay(out, "__row", new | {k: F.coalesce(k, F.lit("")) for k in ("base_spans", "spans")})


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")
