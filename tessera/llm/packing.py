"""Packing: documents become sequences of at most `window` tokens, in order, with cuts chosen by dynamic programming."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that a block of documents is packed from at once, at least; its last window goes on to the next block.
BLOCK_TOKENS = 1 << 20
#: Words whose ids a worker keeps, and as many again from before: words in use stay when the rest goes.
CACHED_WORDS = 500_000
#: Coders of this Python process by tokenizer path; tasks that run in one worker share their words.
_coders: dict[str, WordIds] = {}
#: What a cut costs, in tokens of padding: at the end of a sentence, and elsewhere within a document.
SENTENCE_CUT, INNER_CUT = 8, 32
#: Without the end of a sentence for so many tokens, a cut may fall there.
INNER_STEP = 64

COLUMNS = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


class WordIds:
    """Token ids of a text, as little-endian unsigned 32-bit bytes, from the ids of its words.

    Exact for tokenizers whose pieces never reach over ASCII white space and which drop it; tests hold it against the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if (s := t.removesuffix("</w>")) and not s.strip(".!?")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.last = np.zeros(len(self.ends), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def __call__(self, text: str) -> bytes:
        words = text.encode("utf-8", "surrogatepass").split()
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > CACHED_WORDS:
                self.before, self.known = self.known, {}
            at = [i for i, x in enumerate(found) if x is None]
            self.learn(list(dict.fromkeys(words[i] for i in at)))
            for i in at:
                found[i] = self.known[words[i]]
        return b"".join(found)

    def learn(self, words: list[bytes]) -> None:
        """The ids of words. Plain ones (letters, then at most a run of stops) are put together of the ids of their letters
        in lower case and of the stops; unknown letters go as one text, which is cut where last tokens end."""
        known, before = self.known, self.before
        plain: list[tuple[bytes, bytes, bytes]] = []
        letters: dict[bytes, None] = {}
        rest = []
        for w in words:
            if (ids := before.get(w)) is not None:
                known[w] = ids
                continue
            core = w.rstrip(b".,!?;:")
            if core.isalpha():  # ASCII
                low = core.lower()
            else:
                s = core.decode("utf-8", "surrogatepass")
                low = s.lower()
                # Python lower-cases a final sigma by its place, the tokenizer doesn't
                if not (s.isalpha() and "\u03a3" not in s and unicodedata.is_normalized("NFC", s) and len(low) == len(s)):
                    rest.append(w)
                    continue
                low = low.encode()
            plain.append((w, low, w[len(core) :]))
            if low not in known:
                if (ids := before.get(low)) is not None:
                    known[low] = ids
                else:
                    letters[low] = None
        if letters:
            new = list(letters)
            ids = np.asarray(self.encode([b" ".join(new).decode()])[0], "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(new):
                raw, begin = ids.tobytes(), 0
                for w, end in zip(new, (4 * ends).tolist(), strict=True):
                    known[w] = raw[begin:end]
                    begin = end
            else:  # a letter that the tokenizer takes for none
                self.whole(new)
        for w, low, stops in plain:
            if not stops:
                known[w] = known[low]
            else:
                if stops not in known:
                    self.whole([stops])
                known[w] = known[low] + known[stops]
        self.whole(rest)

    def whole(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            for w, ids in zip(part, self.encode([w.decode("utf-8", "surrogatepass") for w in part]), strict=True):
                self.known[w] = np.asarray(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def coder_of(path: str) -> WordIds:
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path]


def boundaries(ids: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Where a document of these ids may be cut, and what each cut costs. Its end comes last and costs nothing."""
    n = len(ids)
    at = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    at = at[at < n - 1]
    marks = np.concatenate(([0], at, [n]))
    gaps = np.diff(marks)
    if gaps.max() <= INNER_STEP:
        return [*at.tolist(), n], [SENTENCE_CUT] * len(at) + [0]
    places, costs = [], []
    for i, k in enumerate(marks[1:].tolist()):
        inner = range(int(marks[i]) + INNER_STEP, k, INNER_STEP)
        places += [*inner, k]
        costs += [INNER_CUT] * len(inner) + [SENTENCE_CUT if k < n else 0]
    return places, costs


def cuts(places: list[int], costs: list[int], window: int, rest: Callable[[int], int]) -> list[int]:
    """The cheapest cuts of a row of tokens, out of `places` (rising; the last is its end, and no cut).

    A window from i to j costs window - (j - i) of padding, and a cut its own costs. So the best cost up to j is
    window - j + cost(j) + the least of best(i) + i over the places within the window: the front of a queue of rising
    values, of which each place enters and leaves once. What stands after the last cut, a window at most, isn't padded:
    n tokens of it cost rest(n).
    """
    at, best, back = [0, *places], [0], [0]
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + place, number of the place)
    for j, (p, cost) in enumerate(zip(places, costs, strict=True), 1):
        while at[queue[0][1]] < p - window:
            queue.popleft()
        value, i = queue[0]
        best.append(value + window - p + cost)
        back.append(i)
        value = best[j] + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    end = at[-1]
    out, j = [], min((best[j] + rest(end - at[j]), -j) for j in range(bisect_left(at, end - window), len(at) - 1))[1] * -1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def tail(start: int, end: int, window: int) -> list[int]:
    """Cuts of what is left over, at powers of two: a sequence of such a length takes no padding."""
    out = []
    while (left := end - start) and left != window:
        start += 1 << (left.bit_length() - 1)
        out.append(start)
    return out or [end]


def pack_block(lengths: list[int], places: list[list[int]], costs: list[list[int]], window: int, final: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a block of documents: (document, start, length, sequence, offset); both numbers count from 0.

    What stands after the last full window is cut at powers of two in the final block, at the costs of inner cuts; it is
    left out of others, at no cost.
    """
    base = np.concatenate(([0], np.cumsum(lengths))).tolist()

    def rest(n: int) -> int:
        return INNER_CUT * (n.bit_count() - 1) if final and n != window else 0

    chosen = cuts([b + p for b, ps in zip(base, places, strict=False) for p in ps], [c for cs in costs for c in cs], window, rest)
    if final:
        chosen += tail(chosen[-1] if chosen else 0, base[-1], window)
    out, doc, at = [], 0, 0
    for sequence, end in enumerate(chosen):
        began = at
        while at < end:
            stop = min(end, base[doc + 1])
            out.append((doc, at - base[doc], stop - at, sequence, at - began))
            doc, at = doc + (stop == base[doc + 1]), stop
    return out


def pack(
    docs: DataFrame, *, tokenizer: str, text_col: str = "text", window: int = 4096, end_id: int = 2, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens; one row for each piece of a document.

    A document is the ids of its whole text and then `end_id`. The tokens of a partition are a row in the order in which
    the table is read; dynamic programming cuts it at the ends of documents and sentences (elsewhere only where there is
    no such place for INNER_STEP tokens), minimising padding plus the costs of cuts. What is left over at the end of the
    partition is cut at powers of two, which take no padding: twelve more cuts at most, for all its sequences. There is no
    shuffle, and memory holds a block (BLOCK_TOKENS, or one longer document).

    Returns the columns of `keep`, and start, length, ids_crc32, doc_tokens, sequence_id and offset (long). sequence_id
    is the partition times 2^32 and the sequence in it. A null or empty text gives its end_id alone. Rows are packed one
    by one, so repeated ids stay apart. An empty table gives an empty one. Columns outside `keep` are left out.
    """
    names = [k for k in keep if k.lower() not in {c.lower() for c in COLUMNS.names}]
    schema = T.StructType([docs.schema[k] for k in names] + list(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sequence = coder_of(tokenizer), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        rows: list[pa.RecordBatch] = []
        ids: list[bytes] = []
        places: list[list[int]] = []
        costs: list[list[int]] = []
        held = skip = 0  # tokens to be packed, and those of the first document that are packed already
        close = np.asarray([end_id], "<u4").tobytes()

        def flush(final: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, skip
            if not ids:
                return
            lengths = [len(b) // 4 for b in ids]
            left = [lengths[0] - skip, *lengths[1:]]
            if skip:
                gone = bisect_right(places[0], skip)
                places[0], costs[0] = [p - skip for p in places[0][gone:]], costs[0][gone:]
            pieces = pack_block(left, places, costs, window, final)
            pieces = [(d, s + skip if d == 0 else s, n, q, o) for d, s, n, q, o in pieces]
            table = pa.Table.from_batches(rows)
            kept = table.take(pa.array([p[0] for p in pieces], pa.int64()))
            new = {
                "start": [p[1] for p in pieces],
                "length": [p[2] for p in pieces],
                "ids_crc32": [zlib.crc32(ids[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces],
                "doc_tokens": [lengths[p[0]] for p in pieces],
                "sequence_id": [sequence + p[3] for p in pieces],
                "offset": [p[4] for p in pieces],
            }
            for k in COLUMNS.names:
                kept = kept.append_column(k, pa.array(new[k], pa.int64()))
            # what is left begins in the document of the last piece, or with the one after it
            sequence += pieces[-1][3] + 1
            first, skip = pieces[-1][0], pieces[-1][1] + pieces[-1][2]
            if skip == lengths[first]:
                first, skip = first + 1, 0
            if skip:  # places count from the document's start
                packed_before = lengths[first] - left[first]
                places[first] = [p + packed_before for p in places[first]]
            held = sum(lengths[first:]) - skip
            rows[:] = table.slice(first).to_batches() if first < len(ids) else []
            for x in (ids, places, costs):
                del x[:first]
            yield from kept.combine_chunks().to_batches()

        for batch in batches:
            texts, others, began = batch.column("__text"), batch.select(names), 0
            for i, text in enumerate(texts):
                ids.append(coder(text.as_py() or "") + close)
                held += len(ids[-1]) // 4
                where, cost = boundaries(np.frombuffer(ids[-1], "<u4"), coder.ends)
                places.append(where)
                costs.append(cost)
                if held >= max(BLOCK_TOKENS, 4 * window):
                    rows.append(others.slice(began, i + 1 - began))
                    began = i + 1
                    yield from flush()
            if began < batch.num_rows:
                rows.append(others.slice(began))
        yield from flush(final=True)

    return docs.select(*[F.col(f"`{k}`") for k in names], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=default_tokenizer())
