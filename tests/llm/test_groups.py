"""Operators over pairs and groups against brute force: Jaccard join, suffix dedup, chats, revisits; then the pipeline."""

import datetime
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import chat, common, components, jaccard, packing, quality, suffix, warc

from .helpers import docs_of, lower, odd_rows, words_of


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = words_of(lower(t))
        out.setdefault(i, []).append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def groups_of(rows, percent=80):
    sets = sets_of([(i, t) for i, t in rows if i is not None])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and any(100 * len(x & y) >= percent * len(x | y) and x and y for x in sets[i] for y in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_rows(seed, n, edits):
    """A chain: each text is edited from the one before, so links join what isn't alike itself; and stars of copies."""
    rng = random.Random(seed)
    base = [f"c{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
        if i % 3 == 0:
            base = w
    return rows


@pytest.mark.parametrize(("short", "block"), [(32, 400_000), (2, 600)])
def test_jaccard_groups(spark, monkeypatch, short, block):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard, "FIRST_SHINGLES", block)
    rows = odd_rows(6, 40) + near_rows(1, 40, 3) + near_rows(2, 30, 8) + [(2000, "A b c"), (2001, "a B c"), (2002, "a b c d"), (2003, "a b c d e f"), (7, "another text of document seven, unlike it")]
    out = jaccard.similar_groups(docs_of(spark, rows)).collect()
    want = groups_of(rows)
    assert len(set(want.values())) < len(want) - 20
    for r in out:
        assert r["component_id"] == (want[r.doc_id] if r.doc_id is not None else None), r.doc_id
    sizes = Counter((r.doc_id, r["n_shingles"]) for r in out)
    assert sizes == Counter((i, len(s)) for i, ss in sets_of(rows).items() for s in ss)
    assert jaccard.similar_groups(docs_of(spark, [])).count() == 0


@pytest.fixture(params=["rows", "bytes"])
def nothing_broadcast(request, monkeypatch):
    """Tables are held to be too large to be broadcast, by their rows or by their bytes."""
    monkeypatch.setattr(common, f"BROADCAST_{request.param.upper()}", 0)


def test_groups_by_shuffled_joins(spark, nothing_broadcast):
    rows = odd_rows(6, 40) + near_rows(1, 30, 3)
    want = groups_of(rows)
    assert {r.doc_id: r["component_id"] for r in jaccard.similar_groups(docs_of(spark, rows)).collect() if r.doc_id is not None} == want
    assert Counter(r.doc_id for r in jaccard.one_of_each(docs_of(spark, rows)).collect()) == Counter(fullest(rows)) + Counter({None: 2})


def test_repeats_by_shuffled_joins(spark, nothing_broadcast):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(600))
    rows = odd_rows(7, 30) + [(900 + i, f"{i}" * 30 + passage[rng.randint(0, 200) : rng.randint(300, 600)]) for i in range(30)]
    out = suffix.remove_repeats(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out) == cut_rows(rows, 200)


def test_sizes_of_values(spark):
    rows = [(1, "é" * 1000, ["a" * 500, None], (1, "b" * 300), {"k": "v" * 200}, bytearray(100)), (None,) * 6]
    df = spark.createDataFrame(rows, "a long, b string, c array<string>, d struct<x:long,y:string>, e map<string,string>, f binary")
    size = sorted(r[0] for r in df.select(common.value_bytes(df)).collect())
    assert size[0] < 300 and 3100 <= size[1] < 3600


def test_one_of_each(spark):
    rows = odd_rows(6, 40) + near_rows(3, 20, 3)
    docs = docs_of(spark, rows)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(fullest(rows)) + Counter({None: 2})
    assert jaccard.one_of_each(docs_of(spark, [])).count() == 0


def fullest(rows):
    """Of each group the id with the largest set, the last of those."""
    groups, sizes, best = groups_of(rows), {i: max(map(len, s)) for i, s in sets_of(rows).items()}, {}
    for i, g in groups.items():
        best[g] = max(best.get(g, (-1, -1)), (sizes[i], i))
    return {i for _, i in best.values()}


@pytest.mark.parametrize(("percent", "shift"), [(80, 0), (60, 0), (100, 0), (80, 60)])
def test_blocks_skipped_by_position_lose_no_link(spark, monkeypatch, percent, shift):
    """Long lists alone, of unlike sizes: sets that share a common stretch and more or less beyond it."""
    for name, value in (("SHORT_LIST", 1), ("BLOCK_SHINGLES", 700), ("FIRST_SHINGLES", 700), ("SET_LEAST", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(percent + shift)
    common = [f"c{k}" for k in range(90)]
    rows = []
    for i in range(110):
        low, high = rng.randint(0, 25) + shift // 4, rng.randint(50, 90)
        rows.append((i, " ".join([f"a{i}x{k}" for k in range(rng.choice((0, 0, 2, 9)))] + common[low:high] + [f"z{i % 7}y{k}" for k in range(rng.choice((0, 0, 3, 15, 40)))])))
    out = {r.doc_id: r["component_id"] for r in jaccard.similar_groups(docs_of(spark, rows), percent=percent).collect()}
    want = groups_of(rows, percent)
    assert out == want and 1 < len(set(want.values())) < len(rows)


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
        y = np.unique(np.concatenate((x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64))))
        if len(y) and jaccard.linked(x, y, 80):
            assert jaccard.may_link(len(x), jaccard.signature(x), len(y), jaccard.signature(y), 80)
    a, b = (np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64)) for _ in range(2))
    assert not jaccard.may_link(len(a), jaccard.signature(a), len(b), jaccard.signature(b), 80)


def test_sets_are_made_only_of_what_bitmaps_leave(spark, monkeypatch):
    """Texts that share half with the next one, and one pair of near copies: only the latter's sets are shipped."""
    seen = {}

    def kept(df, name):
        seen[name] = common.written(df, name)
        return seen[name]

    monkeypatch.setattr(jaccard, "written", kept)
    r = random.Random(11)
    parts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(30)) for _ in range(200)]
    rows = [(i, f"{parts[i]} {parts[(i + 1) % 200]}") for i in range(200)]
    rows.append((200, rows[7][1] + " more"))
    got = {x.doc_id: x.component_id for x in jaccard.similar_groups(docs_of(spark, rows)).collect()}
    assert got == {i: 7 if i == 200 else i for i in range(201)}
    assert seen["jaccard-pairs"].count() > seen["jaccard-close"].count()
    assert {x.cls for x in seen["jaccard-sets"].collect()} == {7, 200}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(100, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (1, 0)]
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, {a}).add(b)
            want.setdefault(b, {b}).add(a)
    label = {n: n for n in want}
    for _ in range(400):
        for n, near in want.items():
            label[n] = min(label[m] for m in near)
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut_rows(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = Counter()
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[(i, len(t), sum(gone), sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("length", "least"), [(200, 256), (50, 4), (40, 4)])
def test_suffix_dedup(spark, monkeypatch, length, least):
    monkeypatch.setattr(suffix, "FREQUENT_LEAST", least)
    monkeypatch.setattr(suffix, "FREQUENT_SHARE", 400)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdé ") for _ in range(600))
    rows = odd_rows(7, 40) + [(800, "ab" * 500), (801, "x" * 1000), (802, "é" * 300), (803, "q" * (length - 1)), (804, "q" * length), (805, passage[:length] + "!" + passage[:length])]
    rows += [(900 + i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) + passage[rng.randint(0, 200) : rng.randint(300, 600)]) for i in range(80)]
    out = suffix.remove_repeats(docs_of(spark, rows), length=length).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)
    assert got == cut_rows(rows, length)
    assert suffix.remove_repeats(docs_of(spark, [])).count() == 0


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 3000)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    rows = [(1, text), (2, "zz" + text[5000:9000]), (3, text[100:299])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeats(docs_of(spark, rows, 1)).collect()}
    assert got == {1: (4000, 1), 2: (4000, 1), 3: (0, 0)}


@pytest.mark.parametrize("blob", [100_000, 7])
def test_suffix_dedup_of_repeated_rows(spark, monkeypatch, blob):
    """A row that is there twice is a copy of itself, however its runs are dealt; so are rows of null id."""
    monkeypatch.setattr(suffix, "FREQUENT_LEAST", 4)
    monkeypatch.setattr(suffix, "FREQUENT_SHARE", 400)
    monkeypatch.setattr(suffix, "OFTEN_ROWS", blob)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdé ") for _ in range(300))
    lone = ["".join(rng.choice("xyz ") for _ in range(250)) + passage + f"{k}{passage[100:290]}" for k in range(12)]
    rows = [(k, t) for k, t in enumerate(lone)] + [(3, lone[3]), (4, lone[4]), (None, lone[5]), (None, lone[5]), (None, "z" * 150), (70, "q" * 200 + lone[6][:120])]
    out = suffix.remove_repeats(docs_of(spark, rows, 6)).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)
    assert got == cut_rows(rows, 200)


def test_equal_halves_are_no_equal_prints():
    x, y = np.array([5, 5, 5, 5, 9, 9], np.uint64), np.array([1, 2, 1, 3, 4, 4], np.uint64)
    assert suffix._repeated(x, y).tolist() == [True, False, True, False, True, True]
    raw = np.frombuffer(b"abcdabcd", np.uint8)
    one, two = (suffix.Prints(raw, k).of(np.arange(5), np.arange(5) + 4) for k in (0, 1))
    assert one[0] == one[4] and two[0] == two[4] and len(set(one.tolist()) | set(two.tolist())) == 8


def rendered(turns, me):
    safe = lambda s: s.replace("<|", "< |")
    text, mask, n = "", [], 0
    for _, who, said in turns:
        role = "system" if who == "system" else "assistant" if who == me else f"user name={safe(who)}"
        head, body = f"<|{role}|>\n", f"{safe(said)}<|end|>\n"
        mask += [f"u{len(head)}", f"t{len(body)}"] if who == me else [f"u{len(head) + len(body)}"]
        n += len(body) * (who == me)
        text += head + body
    return text, ",".join(mask), n


def test_chats(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|assistant|> 漢"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "ann", ""), (2, None, None, "who"), (2, 5, "x<|y", "z"), (3, 0, "system", "alone"), (None, 1, "ann", "lost"), (None, 1, "bob", "lost too"), (4, 1, "b", "tie"), (4, 1, "a", "tie")]
    want = Counter()
    talks = {}
    for c, n, who, said in rows:
        key = (c,) if c is not None else (None, who)
        talks.setdefault(key, []).append((-1 if n is None else n, who or "unknown", said or ""))
    for key, turns in talks.items():
        turns.sort()
        for me in {t[1] for t in turns} - {"system"}:
            want[(key[0], me, *rendered(turns, me), len(turns))] += 1
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    out = chat.perspectives(df).collect()
    assert Counter((r.conv_id, r.perspective, r.rendered, r["mask"], r.n_train_chars, r.n_turns) for r in out) == want
    assert all(r.n_chars == len(r.rendered) for r in out)
    assert chat.perspectives(df.limit(0)).count() == 0
    # whatever its length and however its turns are numbered, a conversation is a row for each participant
    for first, step in ((0, 1), (10**12, 60_000)):
        turns = [(1, first + step * k, ("ann", "bob", "eve")[k % 3], f"said {k}") for k in range(12_000)]
        talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
        got = {r.perspective: (r.rendered, r["mask"], r.n_train_chars) for r in chat.perspectives(talk).collect()}
        assert got == {me: rendered([t[1:] for t in turns], me) for me in ("ann", "bob", "eve")}
    long = spark.createDataFrame([(1, 1, "ann", "x" * 3_000_000)], "conv_id long, turn long, role string, text string")
    assert chat.perspectives(long).first().n_train_chars == 3_000_000 + len("<|end|>\n")


def test_canonical_urls(spark):
    same = ["http://www.Ex.org/a/b/?y=2&x=1&utm_source=z#top", "HTTPS://ex.org:443/a/b?x=1&y=2", " ex.org/a/b?x=1&y=2&ref=q "]
    df = spark.createDataFrame([(u,) for u in [*same, "http://ex.org", None, "http://ex.org/A?"]], "u string")
    got = [r[0] for r in df.select(warc.canonical_url(df.u)).collect()]
    assert got[:3] == ["ex.org/a/b?x=1&y=2"] * 3 and got[3:] == ["ex.org", None, "ex.org/A"]
    # escapes, users and ports
    cases = {
        "http://ex.org/%7Eme/%c3%a9/%41?q=%2f%62": "ex.org/~me/%C3%A9/A?q=%2Fb", "ex.org/100%": "ex.org/100%", "ex.org/%zz%4": "ex.org/%zz%4", "ex.org/a%2Fb": "ex.org/a%2Fb",
        "http://me:pw@ex.org:80/": "ex.org", "https://ex.org:80/": "ex.org:80", "http://ex.org:443/": "ex.org:443", "ftp://ex.org:80/x": "ex.org:80/x", "http://ex.org:/x@y": "ex.org/x@y", "": "",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r[0]: r[1] for r in df.select("u", warc.canonical_url(df.u)).collect()} == cases
    import duckdb

    pages = [(k, u, "<html>") for k, u in enumerate(cases)]
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    by_sql = {-1 - r[0]: r[1] for r in db.sql(f"SELECT record_id, canonical_url FROM ({warc.ORACLE})").fetchall()}
    assert by_sql == {k: cases[u] for k, u, _ in pages}


def test_revisits_with_long_headers(spark):
    at = datetime.datetime(2024, 1, 1)
    big = {f"X-{k}": "v" * 1000 for k in range(500)} | {"ETag": '"1"'}
    rows = [(1, "response", "a.org/" + "p" * 100_000, at, 200, big, "b"), (2, "revisit", "a.org/" + "p" * 100_000, at, 304, {"ETag": 'W/"1"', "Set-Cookie": "c" * 200_000}, None)]
    out = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert [(r.record_id, r.response_id, r.outcome, len(r.headers)) for r in out] == [(2, 1, "resolved", 501)] and out[0].headers["etag"] == 'W/"1"'


def test_revisits(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rng = random.Random(2)
    rows = []
    for i in range(200):
        u, tag = f"http://h{rng.randrange(4)}.org/p", f'"{rng.randrange(3)}"'
        kind = rng.choice(["response", "response", "revisit", "metadata"])
        rows.append((i, kind, u, at(rng.randrange(20_000)) if i % 17 else None, 304 if kind == "revisit" else rng.choice([200, 200, 404]), {"ETag": tag, "X-Own": str(i), "Cache-Control": kind} if i % 5 else None, None))
    rows += [(900, "revisit", None, at(5), 304, None, None), (901, "response", "http://h0.org/p", at(50_000), 304, {"etag": "W/\"1\""}, None), (10, *rows[10][1:])]
    out = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()
    full = sorted((r[3], r[0], r[2], r[5]) for r in rows if r[1] == "response" and r[4] == 200 and r[3])
    want = Counter()
    merged = {}
    for r in rows:
        if r[1] != "revisit" and r[4] != 304:
            continue
        before = [f for f in full if r[2] and r[3] and f[2] == r[2] and f[0] <= r[3]]
        last = before[-1] if before else None
        tag = lambda h: next((v.removeprefix("W/") for k, v in (h or {}).items() if k.lower() == "etag"), None)
        mine, theirs = tag(r[5]), tag(last[3]) if last else None
        outcome = "orphan" if last is None else "mismatch" if mine and theirs and mine != theirs else "resolved"
        want[(r[0], last[1] if last else None, outcome)] += 1
        if outcome == "resolved":
            own = {k.lower(): v for k, v in (r[5] or {}).items()}
            merged[r[0]] = {k.lower(): v for k, v in (last[3] or {}).items()} | {k: v for k, v in own.items() if k in warc.PERMITTED}
    assert Counter((r.record_id, r.response_id, r.outcome) for r in out) == want
    assert len(merged) > 5 and all(r.headers == merged[r.record_id] and r.status == 200 for r in out if r.outcome == "resolved")
    assert warc.resolve_revisits(spark.createDataFrame([], warc.RECORD)).count() == 0


def test_revisits_by_date_and_payload(spark):
    at = datetime.datetime(2024, 1, 1)
    day = lambda d: {"Last-Modified": f"{d:02d} Jan 2024 00:00:00"}
    http = lambda d: {"Last-Modified": f"Mon, {d:02d} Jan 2024 00:00:00 GMT"}
    rows = [(1, "response", "a.org", at, 200, http(3), "body"), (2, "revisit", "a.org", at, 304, http(4), None), (3, "revisit", "a.org", at, 304, http(2), None), (4, "revisit", "a.org", at, 304, day(1), None)]
    records = spark.createDataFrame(rows, warc.RECORD)
    got = {r.record_id: (r.outcome, r.payload) for r in warc.with_payload(warc.resolve_revisits(records), records).collect()}
    assert got == {2: ("resolved", "body"), 3: ("mismatch", None), 4: ("resolved", "body")}


def corpus(spark, path, rows, schema="doc_id long, text string, lang string, source string, n_chars long", items=(), labels=()):
    """The three tables that the pipeline reads."""
    extra = len(schema.split(",")) - 5
    spark.createDataFrame([(i, t, None, "s", len(t or ""), *["x"] * extra) for i, t in rows], schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def common_lines(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(lower(line.strip(" \t\n\x0b\x0c\r")), set()).add(i)
    return {k: s for k, s in holders.items() if len(k) >= 20 and len(s) >= 3}


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against brute force on its own input; the whole gives the same."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = odd_rows(8, 60) + near_rows(5, 12, 2) + [(3000 + k, f"a line that all of these documents share\n{' '.join(f'{w}z{k // 2}' for w in range(60))}") for k in range(6)]
    leak = next(t for i, t in rows if i == 9 and t)
    docs = corpus(spark, tmp_path, rows, "doc_id long, text string, lang string, source string, n_chars long, `__id` string, n_words string, component_id string, kept string, th string", [(1, " ".join(leak.split()[:11]))], [(i, 1, 0) for i in range(5, 40)])
    read = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    stages, now = dict(pipeline.STAGES), {}
    before = docs
    for name, stage in pipeline.STAGES:
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now[name].columns == docs.columns
            before = now[name]
    assert list(stages) == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]
    verdicts = quality.quality_rules(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).select("doc_id", "n_words", "kept")
    good, kept = read(now["quality_rules"]), Counter(r.doc_id for r in verdicts.collect() if r.kept)
    assert Counter(i for i, _ in good) == kept and not any(len(words_of(t)) < 10 for _, t in good) and 0 < len(good) < len(rows)
    common = common_lines(good)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    cut = lambda i, t: "\n".join(x for x in (t or "").split("\n") if key(x) not in common or i == max(j for j in common[key(x)] if j is not None))
    lines = read(now["line_dedup"])
    assert Counter(lines) == Counter((i, cut(i, t)) for i, t in good) and lines != good
    assert all(r.n_chars == len(r.text) for r in now["line_dedup"].collect())
    ones = read(now["jaccard_join"])
    assert Counter(i for i, _ in ones) == Counter(fullest(lines)) + Counter(i for i, _ in lines if i is None) and len(ones) < len(lines)
    assert set(ones) <= set(lines)
    # what many documents shared is still there, unless it was a whole document and a near copy of that stays
    lost = {k for k in common if not any(k == key(x) for _, t in ones for x in t.split("\n"))}
    assert lost <= {key(t) for _, t in lines} and len(lost) < len(common)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    item = word.findall(lower(" ".join(leak.split()[:11])))
    windows = {tuple(item[k : k + 10]) for k in range(max(1, len(item) - 9))}
    clean = [(i, t) for i, t in ones if not windows & {tuple(w[k : k + 10]) for w in [word.findall(lower(t))] for k in range(len(w))}]
    assert Counter(read(now["decontamination"])) == Counter(clean) and len(clean) < len(ones)
    packed = now["packing"].collect()
    size = Counter()
    for r in packed:
        size[r.doc_id] += r.length
    coder = packing.WordIds(packing.default_tokenizer())
    want = Counter()
    for i, t in clean:
        want[i] += len(coder.tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert size == want
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole if r.length == r.doc_tokens) >= Counter()
    assert Counter({i: sum(r.length for r in whole if r.doc_id == i) for i in want}) == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    corpus(spark, tmp_path, [])
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)


def test_pipeline_of_nulls(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"w{k}" for k in range(50))
    corpus(spark, tmp_path, [(None, text), (None, None), (1, None), (2, text), (3, text)], labels=[(None, None, None)], items=[(None, None)])
    size = Counter()
    for r in pipeline.run(spark, str(tmp_path)).collect():
        size[r.doc_id] += r.length
    # the line of three documents stays in the last; what is left of the others is empty, and like nothing
    assert set(size) == {None, 2, 3} and size[None] == size[2] == 1 < size[3]
