"""N-gram Jaccard join: groups of documents linked by the similarity of their shingle sets, exactly."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, overlay, packed, written
from .components import components

#: Counters of the sketch that orders shingles; any order gives exact results, a good one short lists.
SKETCH_BITS = 21
#: Index lists up to this length give pairs; longer ones are compared by blocks.
SHORT_LIST = 32
#: Shingles of a block of sets, about; each set counts as SET_LEAST at least, so that a block's sets are few as well.
BLOCK_SHINGLES, SET_LEAST = 400_000, 128
#: The same for the first look at long lists, where a block need only meet the list's first set.
FIRST_SHINGLES = 100_000
#: A counter at so many times the median marks shingles whose lists are not brought together (and at least HOT_LEAST).
HOT_TIMES, HOT_LEAST = 16, 8192

_POST = np.dtype([("tok", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("pos", "<u4")])
_PAIR = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("cnt", pa.int64()), ("la", pa.int64()), ("lb", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: str, size: int) -> np.ndarray:
    """The set of hashes of `size` consecutive words, sorted; of all words if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    x = h[:n].copy()
    for i in range(1, k):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += h[i : i + n]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def _counter(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Two sets of at least `percent` similarity share one of the first so many shingles of either, in any one order."""
    return n - -(-percent * n // 100) + 1


def least_overlap(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """100 x >= percent (na + nb - x), for whole x."""
    return -(-percent * (na + nb) // (100 + percent))


def _facts(docs: DataFrame, size: int) -> DataFrame:
    """For each row its set's size, digest and bitmap (none of an empty set), and for each task the sketch's counters."""
    schema = T.StructType.fromDDL("__id long, __th long, n long, dig binary, sig binary, part binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        kind = None
        for batch in batches:
            n, dig, sig = [], [], []
            kind = batch.column("__id").type
            for text in batch.column("__text"):
                s = shingles(text.as_py() or "", size)
                n.append(len(s))
                dig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s) if len(s) else None)
                np.add.at(counts, _counter(s), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__th"), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.binary()), pa.nulls(len(n), pa.binary())], names=schema.names
            )
        if kind is not None:
            part = zlib.compress(counts.astype("<i8").tobytes(), 1)
            none = [pa.nulls(1, x) for x in (kind, pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([part], pa.binary())], names=schema.names)

    return docs.select("__id", "__th", "__text").mapInArrow(run, schema)


def _sketch(facts: DataFrame) -> np.ndarray:
    """The counters of all documents: summed by tasks, by some of them, then once more; of a fixed size, so the driver may
    have them. Each task adds up about the root of their number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part"])

    sums = written(facts.where("part IS NOT NULL").select("part").mapInArrow(add, "part binary"), "jaccard-sketch")
    some = max(1, math.isqrt(sums.count()))
    rows = sums.repartition(some).mapInArrow(add, "part binary").coalesce(1).mapInArrow(add, "part binary").collect()
    return np.frombuffer(zlib.decompress(rows[0].part), "<i8") if rows else np.zeros(1 << SKETCH_BITS, np.int64)


def _postings(reps: DataFrame, size: int, percent: int, sketch: np.ndarray, parts: int) -> DataFrame:
    """Prefix shingles, dealt to `parts` by shingle and packed: rows (p, blob). Those of full counters are dealt by class,
    with p from `parts` on."""
    hot = max(HOT_LEAST, HOT_TIMES * int(np.median(sketch)))
    shared = reps.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            p = (rows["tok"] % np.uint64(parts)).astype(np.int64)
            full = counts[_counter(rows["tok"])] >= hot
            p[full] = parts + rows["cls"][full] % parts
            order = np.argsort(p, kind="stable")
            rows, p = rows[order], p[order]
            starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            blobs = [x.tobytes() for x in np.split(rows, starts[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(p[starts], pa.int64()), pa.array(blobs, pa.binary())], names=["p", "blob"])

        for batch in batches:
            for cls, text in zip(batch.column("cls").to_pylist(), batch.column("__text"), strict=True):
                s = shingles(text.as_py() or "", size)
                k = prefix_length(len(s), percent)
                first = np.lexsort((s, counts[_counter(s)]))[:k]
                rows = np.empty(len(first), _POST)
                rows["tok"], rows["cls"], rows["n"], rows["pos"] = s[first], cls, len(s), np.arange(len(first))
                held.append(rows)
                total += len(rows)
                if total >= 1_000_000:
                    yield flush()
                    total = 0
        if total:  # none in a task of empty texts
            yield flush()

    return reps.select("cls", "__text").mapInArrow(run, "p long, blob binary")


def _pairs_of(rows: np.ndarray, percent: int, short: int) -> tuple[np.ndarray, ...]:
    """Pairs from postings sorted by shingle and size, all of short lists: each with its neighbours 1, 2, ... further on.

    Lists are in the order of sizes, and a neighbour is passed over if it is of another list, too large, or if the two
    positions leave too few shingles: the positions let whole stretches of a list be skipped.
    """
    found = []
    n, pos = rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
    left = np.arange(len(rows))
    for step in range(1, short):
        left = left[left + step < len(rows)]
        other = left + step
        go = (rows["tok"][left] == rows["tok"][other]) & (100 * n[left] >= percent * n[other])
        left, other = left[go], other[go]  # sizes rise within a list: what is too large now is so further on
        if not len(left):
            break
        need = least_overlap(n[left], n[other], percent)
        most = np.minimum(pos[left], pos[other]) + 1 + np.minimum(n[left] - pos[left], n[other] - pos[other]) - 1
        ok = (most >= need) & (rows["cls"][left] != rows["cls"][other])
        found.append((left[ok], other[ok]))
    if not found:
        return (np.zeros(0, np.int64),) * 2
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _candidates(blobs: DataFrame, percent: int, parts: int, short: int) -> DataFrame:
    """kind 0: pairs of classes with how many prefix shingles they share and where the last stands; kind 1: postings of
    long lists and full counters (a: shingle, b: class, la: position, na: size)."""
    schema = "kind byte, a long, b long, cnt long, la long, lb long, na long, nb long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, full = [], []
        for batch in batches:
            for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob"), strict=True):
                (lists if p < parts else full).append(np.frombuffer(blob.as_py(), _POST))
        long_rows = list(full)
        if lists:
            rows = np.concatenate(lists)
            lists.clear()
            _, inverse, count = np.unique(rows["tok"], return_inverse=True, return_counts=True)
            count = count[inverse]
            long_rows.append(rows[count > short])
            rows = rows[(count > 1) & (count <= short)]
            rows = rows[np.lexsort((rows["cls"], rows["n"], rows["tok"]))]
            i, j = _pairs_of(rows, percent, short)
            if len(i):
                x, y = rows[i], rows[j]
                swap = x["cls"] > y["cls"]
                a, b = np.where(swap, y, x), np.where(swap, x, y)
                order = np.lexsort((b["cls"], a["cls"]))
                a, b = a[order], b[order]
                at = np.flatnonzero(np.concatenate(([True], (a["cls"][1:] != a["cls"][:-1]) | (b["cls"][1:] != b["cls"][:-1]))))
                cols = [
                    np.zeros(len(at), np.int8), a["cls"][at], b["cls"][at], np.diff(np.append(at, len(a))),
                    np.maximum.reduceat(a["pos"].astype(np.int64), at), np.maximum.reduceat(b["pos"].astype(np.int64), at),
                    a["n"][at].astype(np.int64), b["n"][at].astype(np.int64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PAIR)
        for rows in long_rows:
            if len(rows):
                zero = np.zeros(len(rows), np.int64)
                cols = [np.ones(len(rows), np.int8), rows["tok"].copy().view(np.int64), rows["cls"].astype(np.int64), zero, rows["pos"].astype(np.int64), zero, rows["n"].astype(np.int64), zero]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PAIR)

    return blobs.mapInArrow(run, schema)


def signature(s: np.ndarray) -> bytes:
    """A bitmap of a set: the bits of its hashes, four to eight times as many as it has members, within limits."""
    bits = 1 << min(max(int(4 * len(s)).bit_length(), 8), 17)
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_link(nx: int, x: bytes, ny: int, y: bytes, percent: int) -> bool:
    """False only if sets of these sizes and bitmaps can't link: a bit that only one has is a member that only it has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):  # a smaller bitmap is the larger one's halves laid over each other
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    most = min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= percent * (nx + ny - most)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def links_within(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join the groups of a block as all its links would; `labels` are groups known before.

    A set's overlaps with all others come from the block's inverted lists. For a set like the last fully counted one they
    are derived from that one's: minus the lists of shingles it lacks, plus those of shingles it adds.
    """
    size = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by_code = np.argsort(code, kind="stable")
    lists, start = owner[by_code], np.concatenate(([0], np.cumsum(np.bincount(code))))
    own = np.split(code, np.cumsum(size)[:-1])

    def count(codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(len(sets), np.int64)
        begin, length = start[codes], start[codes + 1] - start[codes]
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        return np.bincount(lists[at], minlength=len(sets))

    labels, edges = labels.copy(), []
    leader, base = None, None
    for i in np.lexsort((ids, size)):
        gone = added = None
        if leader is not None:
            gone, added = np.setdiff1d(own[leader], own[i], True), np.setdiff1d(own[i], own[leader], True)
        if gone is not None and 2 * (len(gone) + len(added)) < size[i]:
            overlap = base - count(gone) + count(added)
        else:
            leader, base = i, count(own[i])
            overlap = base
        hits = np.flatnonzero((100 * overlap >= percent * (size + size[i] - overlap)) & (labels != labels[i]))
        for other in np.unique(labels[hits]):
            j = hits[labels[hits] == other][0] if len(hits) else i
            edges.append((int(ids[i]), int(ids[j])))
            labels[labels == other] = labels[i]
            hits = hits[labels[hits] != labels[i]]
    return edges


def _close_pairs(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("na", "x", "nb", "y")]
            ok = [may_link(*row, percent) for row in zip(*cols, strict=True)]
            yield batch.select(["a", "b", "cnt"]).filter(pa.array(ok, pa.bool_()))

    x, y = bitmaps.select(F.col("cls").alias("a"), F.col("sig").alias("x")), bitmaps.select(F.col("cls").alias("b"), F.col("sig").alias("y"))
    return pairs.select("a", "b", "cnt", "na", "nb").join(x, "a").join(y, "b").mapInArrow(run, "a long, b long, cnt long")


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = [linked(np.frombuffer(p.as_py(), "<u8"), np.frombuffer(q.as_py(), "<u8"), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("cls").alias("a"), F.col("blob").alias("x")), sets.select(F.col("cls").alias("b"), F.col("blob").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verify_units(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """units: (u1, u2, u3, cls, label), a block or a pair of blocks for each u; labels are groups known before."""

    def run(table: pa.Table) -> pa.Table:
        edges = links_within(
            table["cls"].to_numpy(), np.unique(table["label"].to_numpy(), return_inverse=True)[1], [np.frombuffer(x.as_py(), "<u8") for x in table["blob"]], percent
        )
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return units.join(sets.select("cls", "blob"), "cls").groupBy("u1", "u2", "u3").applyInArrow(run, "a long, b long")


def _weight() -> Column:
    return F.greatest("n", F.lit(SET_LEAST))


def _block(n_total: str, size: int) -> Column:
    """Which of the blocks of `size` of n_total shingles a class falls into."""
    return F.pmod(F.xxhash64("cls"), F.ceil(F.col(n_total) / size).cast("long"))


def _first_units(posts: DataFrame) -> DataFrame:
    """Each class of the long lists with the others of its longest list, by blocks; the list's first class is in each."""
    lists = posts.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    best = posts.join(lists, "tok").groupBy("cls").agg(F.max(F.struct("c", "tok")).alias("m"), F.max("n").alias("n"))
    best = written(best.select("cls", "n", F.col("m.tok").alias("tok")), "jaccard-first")
    of = best.groupBy("tok").agg(F.sum(_weight()).alias("w"), F.min("cls").alias("lead"))
    rows = best.join(of, "tok").select("tok", "cls", _block("w", FIRST_SHINGLES).alias("block"), "lead", "w")
    lead = of.select("tok", F.col("lead").alias("cls"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / FIRST_SHINGLES).cast("long") - 1)).alias("block"))
    both = rows.select("tok", "cls", "block").unionByName(lead.select("tok", "cls", "block")).distinct()
    return both.select(F.col("tok").alias("u1"), F.col("block").alias("u2"), F.lit(0).cast("long").alias("u3"), "cls", F.col("cls").alias("label"))


def block_kind(n: Column, pos: Column, percent: int) -> tuple[Column, Column]:
    """The band of a posting's size, and whether it stands deep in its set.

    Sets that link are of one band or of neighbouring ones. They meet in the list of their first common shingle, where all
    they share is yet to come: each must have as many shingles left there as least_overlap() asks for. What has too few for
    a set of its own size is deep: it can only link with a smaller set, and that one isn't deep then.
    """
    band = F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("long") if percent < 100 else n.cast("long")
    return band, (n - pos) * (100 + percent) < percent * 2 * n


def _rest_units(posts: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """What long lists still ask for: blocks outside a list's largest group with each other and with that group's.

    A list is cut into blocks by size band, by position (deep or not) and by class. Pairs of blocks are skipped as wholes
    whose sizes or positions allow no link; and those of the largest group among themselves, as what they add is known.
    """
    known = posts.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("tok", "cls", "n", "pos", F.coalesce("root", "cls").alias("label"))
    known = written(known, "jaccard-lists")
    groups = known.groupBy("tok", "label").agg(F.sum(_weight()).alias("w"))
    top = groups.groupBy("tok").agg(F.max(F.struct("w", "label")).alias("m"), F.count("*").alias("g")).where("g > 1")
    top = written(top.select("tok", F.col("m.label").alias("top")), "jaccard-tops")
    band, deep = block_kind(F.col("n"), F.col("pos"), percent)
    rows = known.join(top, "tok").select("tok", "cls", "n", "label", band.alias("band"), deep.alias("deep"), (F.col("label") == F.col("top")).alias("main"))
    kinds = rows.groupBy("tok", "band", "deep", "main").agg(F.sum(_weight()).alias("w"))
    blocks = kinds.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("w") / BLOCK_SHINGLES).cast("long") - 1)))
    blocks = written(blocks.withColumn("at", F.struct("band", "deep", "main", "k")), "jaccard-blocks").select("tok", "at")
    x, y = blocks.select(F.col("tok").alias("xt"), F.col("at").alias("x")), blocks.select("tok", F.col("at").alias("y"))
    x_small, step = F.col("x.band") <= F.col("y.band"), F.abs(F.col("x.band") - F.col("y.band"))
    may = (step <= 1) & ~(F.col("x.main") & F.col("y.main")) & ~(F.col("x.deep") & F.col("y.deep"))
    # a deep one is the larger of its pair
    may &= ~(F.col("x.deep") & x_small & (step == 1)) & ~(F.col("y.deep") & ~x_small)
    pairs = y.join(x, (F.col("tok") == F.col("xt")) & (F.col("x") <= F.col("y")) & may)
    pairs = pairs.select("tok", "x", "y", F.xxhash64("x").alias("u2"), F.xxhash64("y").alias("u3"))
    units = pairs.select(F.col("tok").alias("u1"), "u2", "u3", F.col("x").alias("at")).unionByName(pairs.where("x <> y").select(F.col("tok").alias("u1"), "u2", "u3", F.col("y").alias("at")))
    rows = rows.join(kinds, ["tok", "band", "deep", "main"]).withColumn("k", _block("w", BLOCK_SHINGLES)).select("tok", "cls", "label", F.struct("band", "deep", "main", "k").alias("place"))
    return units.join(rows, (F.col("u1") == F.col("tok")) & (F.col("at") == F.col("place"))).select("u1", "u2", "u3", "cls", "label")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that links join: two link when their sets of `size`-word shingles have Jaccard >= percent/100.

    Documents of equal sets are one class, from here on. A sketch of shingle counts (of fixed size) puts shingles in one
    order, rare ones first; sets that link share one of their first shingles. Lists of such shingles up to SHORT_LIST
    give pairs, skipped by size and position and pruned by what the shared prefix leaves possible. First each class is
    verified with its likeliest partner, and long lists by blocks around a common member; groups found are known from
    then on, and only pairs and blocks between different groups are verified next, blocks skipped by size and position
    (block_kind()). Within a block a set's overlaps are derived from those of a set like it. Exact: every link between different texts is within a group found.

    Returns the columns of docs, and n_shingles and component_id (the least id of the group); columns of these names
    are replaced. Ids are whole numbers. A null or empty text has no shingles and is its own group. A row of null id is in no
    group (component_id null). Rows of one id are one document, with the links of each. An empty table gives an empty one.
    """
    base, rows = _grouped(docs, id_col, text_col, size, percent)
    out = base.join(rows, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__th") == F.col("t")), "left")
    return overlay(out, "__row", {"n_shingles": F.col("n"), "component_id": F.col("c")})


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The packed rows of docs, and for each (id, text's hash) its set's size and group: (i, t, n, c), without texts."""
    spark = docs.sparkSession
    base = packed(docs, id_col, text_col).withColumn("__id", F.col("__id").cast("long"))
    facts = written(_facts(base, size), "jaccard-facts")
    own = facts.where("part IS NULL")
    classes = written(own.where("n > 0 AND __id IS NOT NULL").groupBy("dig").agg(F.min("__id").alias("cls"), F.max("n").alias("n")), "jaccard-classes")
    counts = _sketch(facts)
    total = classes.agg(F.sum("n"), F.count("*")).first()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a part is to hold about a million postings
    parts = max(shuffles, int((total[0] or 0) * (100 - percent) / 100 + (total[1] or 0)) // 1_000_000 + 1)
    owned = own.where("n > 0 AND __id IS NOT NULL").join(classes.select(F.col("dig").alias("d"), "cls"), F.col("dig") == F.col("d"))
    owned = written(owned.select("__id", "__th", "cls").distinct(), "jaccard-owned")
    # rows that are not their class's first: few, or else joined by a shuffle like any other table
    copies = written(owned.where("__id <> cls").select(F.col("__id").alias("ci"), F.col("__th").alias("ct")), "jaccard-copies")
    # an id with texts of several classes links them
    several = owned.groupBy(F.col("__id").alias("i")).agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high")
    shared = owned.join(several, owned["__id"] == several["i"]).where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b"))
    # repeated rows are one here; a shuffle of texts only where there are any
    repeated = not own.groupBy("__id", "__th").count().where("count > 1").isEmpty()
    rows = base.dropDuplicates(["__id", "__th"]) if repeated else base
    rows = rows.join(maybe_broadcast(copies), F.col("__id").eqNullSafe(F.col("ci")) & (F.col("__th") == F.col("ct")), "left_anti")
    reps = rows.where("__id IS NOT NULL").select(F.col("__id").alias("cls"), "__text")
    blobs = _postings(reps, size, percent, counts, parts)
    found = written(_candidates(blobs.repartition(parts, "p"), percent, parts, SHORT_LIST), "jaccard-candidates")
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("cnt").alias("cnt"), *[F.max(c).alias(c) for c in ("la", "lb", "na", "nb")])
    # all they share up to the last shared place is counted; beyond it either can give what it has left
    enough = 100 * (F.col("cnt") + F.least(F.col("na") - F.col("la") - 1, F.col("nb") - F.col("lb") - 1))
    pairs = written(pairs.where(enough * (100 + percent) >= 100 * percent * (F.col("na") + F.col("nb"))), "jaccard-pairs")
    posts = found.where("kind = 1").select(F.col("a").alias("tok"), F.col("b").alias("cls"), F.col("na").alias("n"), F.col("la").alias("pos"))
    posts = written(posts.join(posts.groupBy("tok").count().where("count > 1").select("tok"), "tok", "left_semi"), "jaccard-postings")

    # most pairs share a place by chance: bitmaps, made when the texts were read first, rule them out before a set is made
    def of_pairs() -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("c"))

    asked = written(of_pairs().distinct(), "jaccard-asked")
    bitmaps = own.where("n > 0 AND __id IS NOT NULL")
    bitmaps = bitmaps.dropDuplicates(["__id", "__th"]) if repeated else bitmaps
    bitmaps = bitmaps.join(maybe_broadcast(copies), (F.col("__id") == F.col("ci")) & (F.col("__th") == F.col("ct")), "left_anti")
    bitmaps = bitmaps.select(F.col("__id").alias("cls"), "sig").join(maybe_broadcast(asked), F.col("cls") == F.col("c"), "left_semi")
    pairs = written(_close_pairs(pairs, bitmaps, percent), "jaccard-close")

    def pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob = [shingles(t.as_py() or "", size).tobytes() for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(blob, pa.binary())], names=["cls", "blob"])

    needed = written(of_pairs().unionByName(posts.select(F.col("cls").alias("c"))).distinct(), "jaccard-needed")
    texts = reps.join(maybe_broadcast(needed), F.col("cls") == F.col("c"), "left_semi")
    sets = written(texts.mapInArrow(pack_sets, "cls long, blob binary"), "jaccard-sets")

    ways = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "cnt").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "cnt"))
    first = ways.groupBy("x").agg(F.max(F.struct("cnt", -F.col("y"))).alias("m")).select("x", (-F.col("m")["col2"]).alias("y"))
    first = first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    edges = _verify_pairs(first, sets, percent).unionByName(_verify_units(_first_units(posts), sets, percent))
    edges = written(edges.unionByName(shared), "jaccard-edges")
    roots = components(edges)
    at = roots.select(F.col("node").alias("n1"), F.col("root").alias("r1"))
    open_pairs = pairs.join(at, pairs["a"] == at["n1"], "left").withColumn("ra", F.coalesce("r1", "a")).drop("n1", "r1")
    open_pairs = open_pairs.join(at, open_pairs["b"] == at["n1"], "left").where(F.col("ra") != F.coalesce("r1", "b"))
    more = written(_verify_pairs(open_pairs, sets, percent).unionByName(_verify_units(_rest_units(posts, roots, percent), sets, percent)), "jaccard-edges")
    roots = components(edges.unionByName(more))

    group = classes.join(roots, classes["cls"] == roots["node"], "left").select("dig", F.coalesce("root", "cls").alias("component"))
    group = written(group.withColumnRenamed("dig", "d"), "jaccard-groups")
    rows = own.join(group, (F.col("dig") == F.col("d")) & (F.col("n") > 0), "left")
    # rows of one id whose sets differ are one document: the least of their groups
    rows = rows.select(F.col("__id").alias("i"), F.col("__th").alias("t"), "n", F.when(F.col("__id").isNotNull(), F.coalesce("component", "__id")).alias("c"))
    return base, rows.dropDuplicates(["i", "t"])


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of similar_groups() one document stays, once: the one of most shingles, of those the largest id.

    So what only one member of a group still holds, such as lines that line dedup left in the last document, is not lost
    to a shorter one. The choice is made among ids and sizes; texts are read once, without those that go. Of rows of equal
    id and text one stays; of one id's unlike texts the fullest. Rows of null id stay. Returns the columns of docs.
    """
    base, rows = _grouped(docs, id_col, text_col, size, percent)
    rows = written(rows.where("c IS NOT NULL"), "jaccard-members")
    best = rows.groupBy(F.col("c").alias("bc")).agg(F.max(F.struct("n", "i", "t")).alias("best"))
    gone = rows.join(best, (F.col("c") == F.col("bc")) & (F.struct("n", "i", "t") != F.col("best"))).select("i", "t")
    gone = written(gone, "jaccard-gone")
    left = base.join(maybe_broadcast(gone), (F.col("__id") == F.col("i")) & (F.col("__th") == F.col("t")), "left_anti")
    again = written(left.where("__id IS NOT NULL").groupBy("__id", "__th").count().where("count > 1"), "jaccard-again")
    if not again.isEmpty():
        left = left.where("__id IS NOT NULL").dropDuplicates(["__id", "__th"]).unionByName(left.where("__id IS NULL"))
    return overlay(left, "__row", {})


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")
