"""Suffix dedup: bytes that lie in a string of `length` bytes which also starts elsewhere in the corpus are removed.

Prefix doubling over sampled suffixes. A position's rank says which positions start alike; ranks are taken at growing
offsets, and what is unique at one offset is not looked at again. Ranking all positions densely would move some
16 bytes for each byte of text and round, so the first round ranks only anchors: in each window of `length` bytes the
leftmost of its least hashes of ANCHOR bytes. Equal windows have equal anchors at equal places, so a window whose anchor
is unique is unique. The second round ranks (anchor, all that the windows of the same anchor cover); the third ranks the
windows themselves, at offset `length`, for anchors that still have unlike surroundings. Ranks are fingerprints: of runs 64 bits
next to the 64 of their anchor, compared within one anchor's runs alone; of windows 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, overlay, packed, written

#: Bytes of an anchor. Longer texts are ranked in blocks of BLOCK bytes that overlap by a window.
ANCHOR, BLOCK = 32, 1 << 20
#: An anchor is frequent with one of so many runs or more (there are as many such anchors at most), and in a task with FREQUENT_LEAST.
FREQUENT_SHARE, FREQUENT_LEAST = 2000, 256

#: Runs, and stretches of text in question, that a task is dealt on average at most.
RUNS_IN_TASK, STRETCHES_IN_TASK = 1_000_000, 20_000
#: Rows that a task gathers before it passes them on; those of frequent anchors in blobs of so many.
FLUSH_ROWS, OFTEN_ROWS = 250_000, 100_000

#: Bases of the two families of fingerprints.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_RUN = np.dtype([("key", "<u8"), ("seg", "<u8"), ("id", "<i8"), ("th", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
_WIN = np.dtype([("wh", "<u8"), ("wl", "<u8"), ("id", "<i8"), ("th", "<i8"), ("at", "<i4"), ("times", "<i4")])
_LOW = np.uint64(0xFFFFF)
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), 2**64))))
    _tables[name] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prints:
    """Fingerprints of any stretch of some bytes, in constant time each, from sums of byte codes times powers."""

    def __init__(self, raw: np.ndarray, family: int = 0) -> None:
        codes = f"codes{family}"
        if codes not in _tables:
            _tables[codes] = np.random.default_rng(11 + family).integers(0, 2**64, 256, dtype=np.uint64)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_tables[codes][raw] * _powers(f"up{family}", _ODD[family], len(raw)), out=self.sums[1:])
        self.down = _powers(f"down{family}", pow(_ODD[family], -1, 2**64), len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from the least so far and yet to come within stretches of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    full = full.reshape(-1, w)
    so_far = np.minimum.accumulate(full, axis=1).ravel()
    to_come = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_come[: n - w + 1], so_far[w - 1 : n])


def anchored_runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: the anchor's print, the print of all they cover, first and last window."""
    out = []
    anchor = min(ANCHOR, length)
    for begin in range(0, max(len(raw) - length + 1, 0), BLOCK - length + 1):
        part = raw[begin : begin + BLOCK]
        n = len(part)
        prints = Prints(part)
        at = np.arange(n - anchor + 1)
        h = prints.of(at, at + anchor)
        least = _window_min((h & ~_LOW) | at.astype(np.uint64), length - anchor + 1) & _LOW
        lo = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        hi = np.append(lo[1:], len(least)) - 1
        # the anchor's place in the run belongs to the print: equal stretches have it at equal places
        out.append((h[least[lo].astype(np.int64)], prints.of(lo, hi + length), lo + begin, hi + begin))
    if not out:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the number of each row's group in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _frequent(base: DataFrame, length: int) -> tuple[set[int], int]:
    """Anchors of at least one in FREQUENT_SHARE of all runs (so many at most), and the number of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = []
        for batch in batches:
            keys += [anchored_runs(_raw(t.as_py()), length)[0] for t in batch.column(0)]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        u, n = np.unique(keys, return_counts=True)
        # a key below this in every task is below it in all
        many = n >= max(len(keys) / FREQUENT_SHARE / 2, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(u[many].view(np.int64), 0)), pa.array(np.append(n[many], 0)), pa.array([0] * int(many.sum()) + [len(keys)], pa.int64())], names=["key", "n", "all"])

    rows = written(base.select("__text").mapInArrow(run, "key long, n long, all long"), "suffix-frequent")
    total = rows.agg(F.sum("all")).first()[0] or 0
    often = rows.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(total / FREQUENT_SHARE, FREQUENT_LEAST))
    return {r.key for r in often.select("key").collect()}, total


def _dealt(rows: np.ndarray, key: np.ndarray, parts: int, kind: int) -> list[tuple[int, int, bytes]]:
    p = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    rows, p = rows[order], p[order]
    at = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else []
    return [(kind, int(p[a]), x.tobytes()) for a, x in zip(at, np.split(rows, at[1:]), strict=True)] if len(p) else []


def _blobs(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], names=["kind", "p", "blob"])


_VERDICT = "id long, th long, lo long, hi long, key long, kind long"


def _verdicts(rows: np.ndarray, kind: np.ndarray | int) -> pa.RecordBatch:
    kinds = np.full(len(rows), kind, np.int64) if np.isscalar(kind) else kind
    cols = [rows["id"].astype(np.int64), rows["th"].astype(np.int64), rows["lo"].astype(np.int64), rows["hi"].astype(np.int64), rows["key"].copy().view(np.int64), kinds]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "th", "lo", "hi", "key", "kind"])


def judge_runs(rows: np.ndarray, keys_known: bool) -> list[pa.RecordBatch]:
    """The second round, over all runs of their anchors (or, with keys_known, over a task's runs of frequent ones).

    kind 1: each window of the run is repeated. kind 2: the run stands for equal ones, others are to be held against it.
    kind 3: the run's own windows are in question.
    """
    if not len(rows):
        return []
    order, key_of = _groups(rows["key"], rows["seg"], rows["id"], rows["th"], rows["lo"])
    rows = rows[order]
    same_key = np.concatenate(([False], rows["key"][1:] == rows["key"][:-1]))
    key_no = np.cumsum(~same_key) - 1
    new_seg = ~(same_key & np.concatenate(([False], rows["seg"][1:] == rows["seg"][:-1])))
    seg_no = np.cumsum(new_seg) - 1
    times = np.bincount(seg_no)[seg_no]
    unlike = np.bincount(key_no[new_seg])[key_no] > 1
    out = [_verdicts(rows[times > 1], 1)]
    ask = new_seg & (unlike | keys_known)
    out.append(_verdicts(rows[ask], np.where(times[ask] > 1, 2, 3)))
    return [b for b in out if b.num_rows]


def _rank_runs(base: DataFrame, length: int, frequent: set[int], parts: int) -> DataFrame:
    """Runs with repeated anchors: _VERDICT rows; those of frequent anchors have kind 12 and 13."""
    known = np.array(sorted(x & (2**64 - 1) for x in frequent), np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, often, total, n_often = [], [], 0, 0

        def flush_often() -> pa.RecordBatch:
            # equal runs of a blob stand for each other here already: they meet nowhere else
            rows = np.concatenate(often)
            often.clear()
            return _blobs([(1, int(x["key"][0] % np.uint64(parts)), x.tobytes()) for x in np.array_split(rows, -(-len(rows) // OFTEN_ROWS))])

        for batch in batches:
            for i, th, text in zip(batch.column("__id").to_pylist(), batch.column("__th").to_pylist(), batch.column("__text"), strict=True):
                key, seg, lo, hi = anchored_runs(_raw(text.as_py()), length)
                rows = np.empty(len(key), _RUN)
                rows["key"], rows["seg"], rows["id"], rows["th"], rows["lo"], rows["hi"] = key, seg, i, th, lo, hi
                full = np.isin(key, known) if len(known) else np.zeros(len(key), bool)
                held.append(rows[~full])
                if full.any():
                    often.append(rows[full])
                    n_often += len(often[-1])
                if n_often >= OFTEN_ROWS:
                    yield flush_often()
                    n_often = 0
                total += len(held[-1])
                if total >= FLUSH_ROWS:
                    rows = np.concatenate(held)
                    yield _blobs(_dealt(rows, rows["key"] >> np.uint64(20), parts, 0))
                    held, total = [], 0
        if held:
            rows = np.concatenate(held)
            yield _blobs(_dealt(rows, rows["key"] >> np.uint64(20), parts, 0))
        if often:
            yield flush_often()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                rows = np.frombuffer(blob.as_py(), _RUN)
                if kind:
                    for b in judge_runs(rows, True):
                        k = b.column("kind").to_numpy()
                        yield b.set_column(5, "kind", pa.array(np.where(k == 1, 1, k + 10)))
                else:
                    held.append(rows)
        if held:
            yield from judge_runs(np.concatenate(held), False)

    return base.select("__id", "__th", "__text").mapInArrow(deal, "kind long, p long, blob binary").repartition(parts, "p").mapInArrow(judge, _VERDICT)


def _repeated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of values come twice or more."""
    order = np.argsort(x)
    s = x[order]
    same = s[1:] == s[:-1]
    if (same & (y[order][1:] != y[order][:-1])).any():  # equal in one half alone, or not next to each other
        order = np.lexsort((y, x))
        s = x[order]
        same = (s[1:] == s[:-1]) & (y[order][1:] == y[order][:-1])
    twice = np.zeros(len(x), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(x), bool)
    out[order] = twice
    return out


def _ranges(ids: np.ndarray, ths: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows of documents as ranges of neighbours."""
    order, _ = _groups(ids, ths, at)
    ids, ths, at = ids[order], ths[order], at[order].astype(np.int64)
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1]) | (at[1:] > at[:-1] + 1))) if len(at) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(at)) - 1 if len(start) else start
    return pa.RecordBatch.from_arrays([pa.array(ids[start]), pa.array(ths[start]), pa.array(at[start]), pa.array(at[end])], names=["id", "th", "lo", "hi"])


def _settle_windows(questions: DataFrame, length: int, parts: int) -> DataFrame:
    """The third round: ranges of repeated windows among the runs in question. questions: text and its runs for each
    document. Stretches of text are dealt by their anchor and ranked where they meet; windows of frequent anchors are
    ranked in each task first, and one of each goes on, dealt by its own print."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(often)
            order, group = _groups(rows["wh"], rows["wl"])
            rows, times = rows[order], np.bincount(group)[group]
            first = np.concatenate(([True], group[1:] != group[:-1]))
            rows["times"] = np.where(rows["times"] < 0, -times, times)
            # all but one copy know their answer, and so does that one; it still goes on to answer others
            mine = rows[(times > 1) & (rows["times"] > 0)]
            out = _dealt(rows[first], rows["wh"][first], parts, 1)
            often.clear()
            if len(mine):
                out.append((2, int(mine["wh"][0] % np.uint64(parts)), mine.tobytes()))
            return _blobs(out)

        size = 0
        for batch in batches:
            kinds, ps, blobs = [], [], []
            for i, th, text, runs in zip(batch.column("__id").to_pylist(), batch.column("__th").to_pylist(), batch.column("__text"), batch.column("runs").to_pylist(), strict=True):
                raw = _raw(text.as_py())
                for run in runs:
                    lo, hi, kind, key = run["lo"], run["hi"], run["kind"], run["key"] & (2**64 - 1)
                    if kind < 10:
                        head = np.array([(key, 0, i, th, lo, hi if kind == 3 else -1 - hi)], _RUN)
                        kinds.append(0)
                        ps.append((key >> 20) % parts)
                        blobs.append(head.tobytes() + raw[lo : hi + length].tobytes())
                    else:
                        part, n = raw[lo : hi + length], hi - lo + 1
                        at = np.arange(n)
                        rows = np.empty(n, _WIN)
                        rows["wh"], rows["wl"] = (Prints(part, family).of(at, at + length) for family in (0, 1))
                        rows["id"], rows["th"], rows["at"], rows["times"] = i, th, at + lo, 1 if kind == 13 else -1
                        often.append(rows)
                        size += n
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(ps, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "p", "blob"])
            if size >= 2 * FLUSH_ROWS:
                yield flush()
                size = 0
        if often:
            yield flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each window its prints (with its anchor mixed in), the stretch it is of, and its place there
        prints, more, stretches, places = [], [], [], []
        known: list[np.ndarray] = []
        heads, texts, size, count = [], [], 0, 0

        def rank() -> None:
            nonlocal count
            raw = np.frombuffer(b"".join(texts), np.uint8)
            head = np.concatenate(heads)
            n = np.where(head["hi"] >= 0, head["hi"], -1 - head["hi"]) - head["lo"] + 1
            begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
            of = np.repeat(np.arange(len(head)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = begin[of] + k
            prints.append(Prints(raw).of(at, at + length) ^ _mix(head["key"])[of])
            more.append(Prints(raw, 1).of(at, at + length))
            stretches.append((of + count).astype(np.int32))
            places.append(k.astype(np.int32))
            known.append(head)
            count += len(head)
            heads.clear()
            texts.clear()

        often = []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                blob = blob.as_py()
                if kind == 0:
                    heads.append(np.frombuffer(blob[: _RUN.itemsize], _RUN))
                    texts.append(blob[_RUN.itemsize :])
                    size += len(texts[-1])
                    if size >= BLOCK:
                        rank()
                        size = 0
                elif kind == 1:
                    often.append(np.frombuffer(blob, _WIN))
                else:
                    rows = np.frombuffer(blob, _WIN)
                    yield _ranges(rows["id"], rows["th"], rows["at"])
        if heads:
            rank()
        if prints:
            again = _repeated(np.concatenate(prints), np.concatenate(more))
            prints.clear()
            more.clear()
            head, of, k = np.concatenate(known), np.concatenate(stretches), np.concatenate(places)
            again &= (head["hi"] >= 0)[of]  # of the rest the answer is known
            head, k = head[of[again]], k[again]
            yield _ranges(head["id"], head["th"], head["lo"] + k)
        if often:
            rows = np.concatenate(often)
            rows = rows[_repeated(rows["wh"], rows["wl"]) & (rows["times"] == 1)]
            yield _ranges(rows["id"], rows["th"], rows["at"])

    return questions.mapInArrow(deal, "kind long, p long, blob binary").repartition(parts, "p").mapInArrow(settle, "id long, th long, lo long, hi long")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which starts at another place, in any document.

    See the module's text for the rounds. All rounds pass packed rows between tasks; anchors of a large share of all
    runs are found first (at most FREQUENT_SHARE of them) and are ranked in each task before anything of them is
    shuffled, so that no task gets more than a row for each task and distinct string of one anchor.

    Returns the columns of docs, and kept (binary: the rest may cut characters), n_bytes, n_removed and n_spans (long);
    columns of these names are replaced. Strings are judged on the input; matches don't cross documents; rows are
    documents, so a repeated row is a copy. Null or short texts lose nothing. Ids are whole numbers; null ones are served
    like others. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    base = packed(docs, id_col, text_col)
    null_id = -(2**63)  # packed rows hold no nulls; together with the text's hash it is as good as any id
    keyed = base.withColumn("__id", F.coalesce(F.col("__id").cast("long"), F.lit(null_id)))
    frequent, runs = _frequent(keyed, length)
    # a task holds what is dealt to it: so much of it, however few partitions the session asks for
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs // RUNS_IN_TASK + 1)
    verdicts = written(_rank_runs(keyed, length, frequent, parts), "suffix-runs")
    # a run that asks twice is of a row that is there twice, in tasks or blobs of its own: its windows are repeated
    asked = verdicts.where("kind > 1").groupBy("id", "th", "lo", "hi", "key").agg(F.min("kind").alias("kind"), F.count("*").alias("rows"))
    asked = written(asked.withColumn("kind", F.when(F.col("rows") > 1, 12).otherwise(F.col("kind"))), "suffix-asked")
    per_doc = asked.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi", "kind", "key")).alias("runs"))
    per_doc = written(per_doc, "suffix-questions")
    stretches = asked.count()
    same = (F.col("__id") == F.col("id")) & (F.col("__th") == F.col("th"))
    ids = per_doc.select("id", "th")
    texts = keyed.select("__id", "__th", "__text").join(maybe_broadcast(ids), same, "left_semi")
    # rows of equal id and text have asked once for all
    texts = texts.dropDuplicates(["__id", "__th"]).join(per_doc, same).select("__id", "__th", "__text", "runs")
    settled = _settle_windows(texts, length, max(parts, stretches // STRETCHES_IN_TASK + 1))
    known = verdicts.where("kind = 1").unionByName(asked.where("rows > 1"), allowMissingColumns=True)
    ranges = known.select("id", "th", "lo", "hi").unionByName(settled)
    per_doc = written(ranges.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "suffix-ranges")
    done = keyed.join(per_doc, same, "left").select("__row", "__text", "ranges")
    names = [f.name for f in done.schema["__row"].dataType.fields if f.name.lower() not in {"kept", "n_bytes", "n_removed", "n_spans"}]
    schema = ", ".join(f"`{k}` {done.schema['__row'].dataType[k].dataType.simpleString()}" for k in names)
    # numbered names: a column of docs may be called anything
    done = done.select(*[F.col("__row")[k].alias(f"c{i}") for i, k in enumerate(names)], F.col("__text").alias("t"), F.col("ranges").alias("r"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, cols = [], [[], [], []]
            for text, ranges in zip(batch.column("t"), batch.column("r"), strict=True):
                raw = _raw(text.as_py())
                ranges = ranges.as_py() or []
                change = np.zeros(len(raw) + 1, np.int32)
                np.add.at(change, [r["lo"] for r in ranges], 1)
                np.add.at(change, [r["hi"] + length for r in ranges], -1)
                gone = np.cumsum(change)[:-1] > 0
                kept.append(raw[~gone].tobytes())
                starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for c, v in zip(cols, (len(raw), int(gone.sum()), starts), strict=True):
                    c.append(v)
            new = [pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in cols]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return done.mapInArrow(cut, f"{schema}, kept binary, n_bytes long, n_removed long, n_spans long")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
