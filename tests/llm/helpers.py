import random
import re

from pyspark.sql import types as T

#: Names that operators use inside, and names of results: none may be in the way.
CLASHING = ["__id", "__text", "__row", "__th", "id", "th", "n", "a", "b", "cls", "kept", "ranges", "runs", "n_lines", "n_hit", "spans", "component_id", "start", "N_WORDS"]
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def docs_of(spark, rows, partitions=3):
    """A table of documents with clashing extra columns, from (doc_id, text)."""
    data = [(i, t, None, "s", None if t is None else len(t), *[f"{c}?" for c in CLASHING]) for i, t in rows]
    return spark.createDataFrame(data, DOCS).repartition(partitions)


def odd_rows(seed=0, n=60):
    """Documents of random words: nulls, blanks, long texts, copies, near copies, repeated rows, shared lines."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "déjà", "漢字", "x1", "don't", "#tag", "|", "zeta"] + [f"w{i}" for i in range(300)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(12) for _ in range(5)]
    rows = [(None, "text of no id " + shared[0]), (0, None), (1, ""), (2, " \n\t\n "), (3, "one"), (4, "\n".join([shared[1]] * 50))]
    base = line(120)
    for i in range(5, n):
        t = "\n".join([line(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))] + rng.sample(shared, rng.randint(0, 2)))
        if i % 6 == 0:
            w = base.split(" ")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        rows.append((i, t))
    rows += [rows[8], (n, rows[9][1]), (n + 1, rows[9][1]), (n + 2, line(4000)), (n + 3, "  " + shared[0].upper() + "\r"), (None, None)]
    return rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
