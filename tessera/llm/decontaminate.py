"""Benchmark decontamination: words of documents that lie in a word window of a benchmark item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, maybe_broadcast, overlay, packed, text_of, wide_hash, written

#: Words of lower-cased text, and the same words of a text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column, n: Column | int) -> Column:
    """128 bits of n words from the 0-based place `at` on; words hold no space, so joined words are the window itself."""
    return wide_hash(F.array_join(F.slice(words, at + 1, n), " "))


def _grams(words: str, n: int, step: int) -> Column:
    """The hashes of n words at every step-th place; null for fewer words."""
    w = F.col(words)
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n, F.lit(step)), lambda i: _gram(w, i, n)))


def _places(words: str, n: int) -> Column:
    """Each place of n words: start, end, hash; null for fewer words."""
    w = F.col(words)
    return F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("s"), (i + n).alias("e"), _gram(w, i, n).alias("h"))),
    )


def _windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """Windows of the items: item (string), n (words), words (their array)."""
    words = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), words_of(text_of(F.col(f"`{text_col}`"))).alias("w"))
    words = words.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    return words.select("item", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.slice("w", i + 1, F.col("n")))).alias("words"))


def _kept_text(text: Column, hits: Column) -> Column:
    """The text without its hit words and what stands before each of them."""
    # split() gives what lies between words; piece i goes before word i
    gaps, own = F.split(text, RAW_WORD, -1), F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))
    spans = F.concat(F.array(F.lit(0)), F.transform(hits, lambda s: s["e"]))
    ends = F.concat(F.transform(hits, lambda s: s["s"]), F.array(F.size(own)))
    runs = F.transform(
        F.arrays_zip(spans.alias("a"), ends.alias("b")),
        lambda r: F.array_join(
            F.transform(
                F.arrays_zip(F.slice(gaps, r["a"] + 1, r["b"] - r["a"]).alias("g"), F.slice(own, r["a"] + 1, r["b"] - r["a"]).alias("w")),
                lambda p: F.concat(p["g"], p["w"]),
            ),
            "",
        ),
    )
    return F.concat(F.array_join(runs, ""), F.element_at(gaps, -1))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    remove: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Find, in every whole document, the words inside any occurrence of a window of a benchmark item.

    Words are lower-cased runs of letters, digits and all beyond ASCII. A window is `size` consecutive words of an item,
    or the whole of a shorter one. Windows go by their lengths. For windows of n words a document is probed at every
    s-th place with the hashes of the items' g-grams, g = n // 2 + 1 and s = n - g + 1: any occurrence of a window holds
    such a place, so none is missed. Documents with a hit there are scanned at each place for whole windows, by 128-bit
    hashes. Words are counted on the way. Both sets of hashes are counted, in
    rows (`broadcast_rows`) and bytes, before they are broadcast; larger ones go by shuffled joins.

    Returns the columns of docs, and n_words, n_hit, n_items (long), items (sorted array of item ids as strings) and
    contaminated; columns of these names are replaced. With remove="spans" the hit words are cut out of the text, each with what stands before it; with
    remove="documents" contaminated rows go, and no columns are added. A null text has no words; items without words
    have no window; repeated items count once. Repeated rows get the same result each. Null ids are served like others.
    """
    spark = docs.sparkSession
    base = packed(docs, id_col, text_col)
    windows = written(_windows(items, item_col, item_text_col, size), "windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # `size` values at most

    def fits(df: DataFrame) -> DataFrame:
        return maybe_broadcast(df, broadcast_rows)

    cols = ["__id", "__th", "__text"]
    if lengths:
        probes, grams = [], []
        for n in lengths:
            g = n // 2 + 1
            s = n - g + 1
            probes.append(F.coalesce(_grams("__w", g, s), F.array().cast("array<struct<a:bigint,b:bigint>>")))
            grams.append(windows.where(F.col("n") == n).select(F.explode(_grams("words", g, 1)).alias("h")))
        some = grams[0]
        for x in grams[1:]:
            some = some.unionByName(x)
        some = written(some.select("h.a", "h.b").distinct(), "window-grams")
        probed = base.select("__id", "__th", words_of(F.col("__text")).alias("__w")).select(
            "__id", "__th", F.size("__w").alias("__n"), F.explode_outer(F.flatten(F.array(*probes))).alias("__h")
        )
        probed = probed.select("__id", "__th", "__n", F.col("__h.a").alias("__pa"), F.col("__h.b").alias("__pb"))
        known = some.select("a", "b", F.lit(True).alias("__hit"))
        probed = probed.join(fits(known), (F.col("__pa") == F.col("a")) & (F.col("__pb") == F.col("b")), "left")
        # words are counted where they are at hand; a row for each document leaves a task
        seen = probed.groupBy(F.col("__id").alias("__nid"), F.col("__th").alias("__nth")).agg(F.max("__n").cast("long").alias("__n_words"), F.count("__hit").alias("__probes"))
        seen = written(seen, "seen-documents")
        near = seen.where("__probes > 0").select("__nid", "__nth")
        few = fits(near)
        found = base.select(*cols).join(few, F.col("__id").eqNullSafe(F.col("__nid")) & (F.col("__th") == F.col("__nth")), "left_semi")
        found = found.dropDuplicates(["__id", "__th"])
        found = found.select("__id", "__th", words_of(F.col("__text")).alias("__w"))
        none = F.array().cast("array<struct<s:int,e:int,h:struct<a:bigint,b:bigint>>>")
        places = F.flatten(F.array(*[F.coalesce(_places("__w", n), none) for n in lengths]))
        by_hash = windows.select(wide_hash(F.array_join("words", " ")).alias("h"), "item").select(F.col("h.a").alias("a"), F.col("h.b").alias("b"), "item").distinct()
        by_hash = written(by_hash.groupBy("a", "b").agg(F.collect_set("item").alias("in_items")), "window-items")
        hits = (
            found.select("__id", "__th", F.explode(places).alias("__p"))
            .select("__id", "__th", F.col("__p.s").alias("s"), F.col("__p.e").alias("e"), F.col("__p.h.a").alias("a"), F.col("__p.h.b").alias("b"))
            .join(fits(by_hash), ["a", "b"])
        )
        # of each span what reaches beyond those before it: disjoint spans in their order
        before = Window.partitionBy("__id", "__th").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        hits = hits.withColumn("s", F.greatest("s", F.coalesce(F.max("e").over(before), F.lit(0))))
        hits = hits.groupBy(F.col("__id").alias("__hid"), F.col("__th").alias("__hth")).agg(
            F.array_sort(F.collect_list(F.when(F.col("e") > F.col("s"), F.struct("s", "e")))).alias("__spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("in_items")))).alias("__items"),
            F.sum(F.greatest(F.col("e") - F.col("s"), F.lit(0))).alias("__n_hit"),
        )
        hits = written(hits, "hits")
    else:
        hits = spark.createDataFrame([], "__hid string, __hth bigint, __items array<string>, __n_hit bigint, __spans array<struct<s:int,e:int>>")
        hits = hits.withColumn("__hid", F.col("__hid").cast(docs.schema[id_col].dataType))
        seen = base.select(F.col("__id").alias("__nid"), F.col("__th").alias("__nth"), F.size(words_of(F.col("__text"))).cast("long").alias("__n_words"))
        seen = seen.dropDuplicates(["__nid", "__nth"])
    same = F.col("__id").eqNullSafe(F.col("__hid")) & (F.col("__th") == F.col("__hth"))
    if remove == "documents":
        return overlay(base.join(fits(hits.select("__hid", "__hth")), same, "left_anti"), "__row", {})
    both = base.join(hits, same, "left")
    if remove == "spans":
        text = F.when(F.col("__n_hit") > 0, _kept_text(F.col("__text"), F.col("__spans"))).otherwise(F.col("__text"))
        return overlay(both, "__row", {text_col: text})
    both = both.join(seen, F.col("__id").eqNullSafe(F.col("__nid")) & (F.col("__th") == F.col("__nth")), "left")
    n_hit = F.coalesce("__n_hit", F.lit(0)).cast("long")
    found = F.coalesce("__items", F.array().cast("array<string>"))
    new = {
        "n_words": F.col("__n_words"),
        "n_hit": n_hit,
        "n_items": F.size(found).cast("long"),
        "items": found,
        "contaminated": n_hit > 0,
    }
    return overlay(both, "__row", new)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), i AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)
), places AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, p, places.n, item_id FROM places JOIN windows ON places.n = windows.n AND places.g = windows.g
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
