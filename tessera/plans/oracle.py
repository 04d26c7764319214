"""DuckDB SQL of the registered queries, with constants as literals."""

from __future__ import annotations

from ..functions.exprs import BLANKS
from ..functions.codebooks import get_codebook, half_centroids, projection, residual_scale
from .queries import CUT, DIM, INVARIANTS, K, M, NLIST, NPROBE, POOL, SEED, TOP, sign_rows

W = DIM // M


def _list(values) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _base(scaled: bool = False, dim: int = DIM) -> str:
    """base: id, v, label; unit: id, n, u, label."""
    times = " * (1 + vec_id % 5)" if scaled else ""
    return f"""
  base AS (SELECT vec_id AS id, label, list_transform(embedding[1:{dim}], lambda x: (x{times})::FLOAT::DOUBLE) AS v FROM embeddings),
  unit AS (SELECT id, label, n, list_transform(v, lambda x: x / CASE WHEN n > 1e-10 THEN n ELSE 1 END) AS u
           FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM base))"""


def _turned(dim: int = DIM) -> str:
    """turned: id, n, u, y = the scaled rotation of the padded unit vector."""
    rows = ", ".join("[" + ", ".join(map(str, r)) + "]" for r in sign_rows())
    pad = f"list_concat(u, list_transform(range({DIM - dim}), lambda i: 0::DOUBLE))" if dim < DIM else "u"
    return f""",
  m AS (SELECT [{rows}]::DOUBLE[][] AS m),
  turned AS (SELECT id, label, n, u, list_transform(m, lambda r: list_inner_product(r, p)) AS y FROM (SELECT *, {pad} AS p FROM unit), m)"""


def _encode(y: str, bits: int) -> str:
    b = _list(get_codebook(bits)[1])
    return f"list_transform({y}, lambda x: len(list_filter({b}, lambda b: b < x)))"


def _decode(codes: str, table) -> str:  # noqa: ANN001
    return f"list_transform({codes}, lambda c: ({_list(table)})[c + 1])"


def _top(scores: str, k: int = TOP) -> str:
    """The k best of query_id, id, score."""
    return f"""
SELECT query_id, rank, id, round(score, 6) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM ({scores})
) WHERE rank <= {k}"""


def _each(source: str, column: str, digits: int = 6) -> str:
    return f"SELECT id, (j - 1)::INTEGER AS j, round(x, {digits}) + 0.0 AS x FROM (SELECT id, unnest({column}) AS x, generate_subscripts({column}, 1) AS j FROM {source})"


def _codes_of(bits: int) -> str:
    return f"WITH {_base()}{_turned()}, coded AS (SELECT id, label, n, u, y, {_encode('y', bits)} AS c FROM turned)"


def _scalar_search(bits: int, where: str = "true", scaled: bool = False, dim: int = DIM) -> str:
    head = f"WITH {_base(scaled, dim)}{_turned(dim)}, coded AS (SELECT id, label, y, {_decode(_encode('y', bits), half_centroids(bits))} AS x FROM turned)"
    return head + _top(f"SELECT q.id AS query_id, c.id, list_inner_product(c.x, q.y) / {DIM} AS score FROM turned q, coded c WHERE q.id % 100 = 0 AND {where}")


def _pack(bits: int) -> str:
    word = f"list_sum(list_transform(range(8), lambda k: (c[g * 8 + k + 1])::BIGINT * (1::BIGINT << (k * {bits}))))::BIGINT"
    byte = f"list_transform(range({bits}), lambda k: (w >> (8 * k)) & 255)"
    return f"""{_codes_of(bits)},
  words AS (SELECT id, list_transform(range({DIM // 8}), lambda g: {word}) AS ws FROM coded)
SELECT id, array_to_string(flatten(list_transform(ws, lambda w: {byte})), ',') AS packed FROM words"""


def _prod_search() -> str:
    s = ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in projection(DIM, SEED))
    return (
        f"""WITH {_base()}{_turned()}, s AS (SELECT [{s}]::DOUBLE[][] AS s),
  coded AS (SELECT id, y, {_encode('y', 2)} AS c FROM turned),
  left_over AS (SELECT id, {_decode('c', half_centroids(2))} AS x, list_transform(list_zip(y, {_decode('c', get_codebook(2)[0])}), lambda p: p[1] - p[2]) AS r FROM coded),
  stored AS (SELECT id, x, list_transform(s, lambda w: CASE WHEN list_inner_product(w, r) < 0 THEN -1.0 ELSE 1.0 END) AS g,
             sqrt(list_inner_product(r, r)) / 8 AS rn FROM left_over, s),
  asked AS (SELECT id, y, list_transform(s, lambda w: list_inner_product(w, y) / 8) AS sy FROM turned, s WHERE id % 100 = 0)"""
        + _top(f"SELECT q.id AS query_id, c.id, list_inner_product(c.x, q.y) / {DIM} + sqrt(pi() / 2) / {DIM} * c.rn * list_inner_product(c.g::DOUBLE[], q.sy) AS score FROM asked q, stored c")
    )


def _residual() -> str:
    scale = residual_scale(3)
    return f"""WITH {_base(True)}{_turned()},
  one AS (SELECT *, {_encode('y', 3)} AS c1 FROM turned),
  two AS (SELECT *, list_transform(list_zip(y, {_decode('c1', get_codebook(3)[0])}), lambda p: (p[1] - p[2]) / {scale!r}) AS r FROM one),
  coded AS (SELECT *, {_encode('r', 3)} AS c2 FROM two),
  stored AS (SELECT id, n, y, {_decode('c1', get_codebook(3)[0])} AS x1, {_decode('c2', get_codebook(3)[0])} AS x2 FROM coded),
  scored AS (SELECT q.id AS query_id, c.id, list_inner_product(c.x1, q.y) / {DIM} AS coarse,
             (list_inner_product(c.x1, q.y) + {scale!r} * list_inner_product(c.x2, q.y)) / {DIM} * c.n AS score
             FROM stored q, stored c WHERE q.id % 100 = 0)"""


def _part(v: str, j: str) -> str:
    return f"{v}[{j} * {W} + 1 : {j} * {W} + {W}]"


def _coded(source: str) -> str:
    """Product codes of the column x of `source`, by the books b."""
    dist = f"list_transform(range({K}), lambda k: list_distance({_part('x', 'j')}, {_part('b[k + 1]', 'j')}))"
    return f""",
  dists AS (SELECT *, list_transform(range({M}), lambda j: {dist}) AS ds FROM {source}, books),
  coded AS (SELECT *, list_transform(ds, lambda d: list_position(d, list_min(d)) - 1) AS c FROM dists)"""


def _table_score(q: str, row: str) -> str:
    return f"list_sum(list_transform(range({M}), lambda j: list_inner_product({_part(q, 'j')}, {_part(f'{row}.b[{row}.c[j + 1] + 1]', 'j')})))"


def _product_search(prepared: str, scaled: bool = True, dim: int = DIM, where: str = "true") -> str:
    head = f"WITH {_base(scaled, dim)}{_turned(dim)}, ready AS (SELECT id, n, {prepared} AS x FROM turned), books AS (SELECT list(x ORDER BY id) AS b FROM ready WHERE id < {K})"
    return head + _coded("ready") + _top(f"SELECT q.id AS query_id, c.id, {_table_score('q.x', 'c')} * c.n AS score FROM ready q, coded c WHERE q.id % 100 = 0 AND {where}")


def _inverted(scaled: bool = True) -> str:
    near = "list_transform(cs, lambda c: list_distance(u, c))"
    return f"""WITH {_base(scaled)},
  centers AS (SELECT list(u ORDER BY id) AS cs FROM unit WHERE id < {NLIST}),
  assigned AS (SELECT id, label, n, u, list_position(d, list_min(d)) - 1 AS cluster_id, cs FROM (SELECT *, {near} AS d FROM unit, centers)),
  rest AS (SELECT *, list_transform(list_zip(u, cs[cluster_id + 1]), lambda p: p[1] - p[2]) AS x FROM assigned),
  books AS (SELECT list(x ORDER BY id) AS b FROM rest WHERE id >= {NLIST} AND id < {NLIST + K})"""


def _probes(where: str = "true") -> str:
    value = "round(2 * list_inner_product(q.u, cs[k + 1]) - list_inner_product(cs[k + 1], cs[k + 1]), 12)"
    return f""",
  ranked AS (SELECT q.id AS query_id, k AS cluster_id, {value} AS v FROM assigned q, range({NLIST}) r(k)
             WHERE q.id % 100 = 0 AND k IN (SELECT cluster_id FROM assigned WHERE {where})),
  probes AS (SELECT query_id, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, cluster_id) AS rank FROM ranked QUALIFY rank <= {NPROBE})"""


def _inverted_scores(where: str = "true") -> str:
    return f"""SELECT p.query_id, c.id, (list_inner_product(q.u, c.cs[c.cluster_id + 1]) + {_table_score('q.u', 'c')}) * c.n AS score
  FROM probes p JOIN coded c ON p.cluster_id = c.cluster_id JOIN assigned q ON q.id = p.query_id WHERE {where}"""


def _half(x: str) -> str:
    step = f"pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / {step}, 0) * {step} END"


def _asked() -> str:
    """asked: the queries, which are units of units in single precision."""
    return """,
  single AS (SELECT id, list_transform(u, lambda y: y::FLOAT::DOUBLE) AS x FROM unit),
  asked AS (SELECT id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS u FROM single WHERE id % 100 = 0)"""


def _binary_residual() -> str:
    """Two stages of single-precision units, and no norms."""
    turn = lambda p: f"list_transform(m, lambda r: list_inner_product(r, {p}))"
    scale = residual_scale(3)
    rows = ", ".join("[" + ", ".join(map(str, r)) + "]" for r in sign_rows())
    return f"""WITH {_base()}{_asked()}, m AS (SELECT [{rows}]::DOUBLE[][] AS m),
  turned AS (SELECT id, {turn('x')} AS y FROM single, m),
  one AS (SELECT *, {_encode('y', 3)} AS c1 FROM turned),
  two AS (SELECT *, list_transform(list_zip(y, {_decode('c1', get_codebook(3)[0])}), lambda p: (p[1] - p[2]) / {scale!r}) AS r FROM one),
  coded AS (SELECT *, {_encode('r', 3)} AS c2 FROM two),
  stored AS (SELECT id, {_decode('c1', get_codebook(3)[0])} AS x1, {_decode('c2', get_codebook(3)[0])} AS x2 FROM coded),
  q AS (SELECT id, {turn('u')} AS y FROM asked, m)""" + _top(
        f"SELECT q.id AS query_id, c.id, (list_inner_product(c.x1, q.y) + {scale!r} * list_inner_product(c.x2, q.y)) / {DIM} AS score FROM q, stored c"
    )


def _binary_product() -> str:
    """Codes, books and queries as a file and single-precision units make them."""
    head = f"WITH {_base()}{_asked()}, books AS (SELECT list(x ORDER BY id) AS b FROM single WHERE id < {K})" + _coded("single")
    return head + _top(f"SELECT q.id AS query_id, c.id, {_table_score('q.u', 'c')} AS score FROM asked q, coded c")


def _binary_inverted() -> str:
    near = "list_transform(cs, lambda c: list_distance(x, c))"
    double = "list_transform(cds, lambda c: list_distance(u, c))"
    value = "round(2 * list_inner_product(q.u, cs[k + 1]) - list_inner_product(cs[k + 1], cs[k + 1]), 12)"
    minus = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])"
    head = f"""WITH {_base()}{_asked()},
  centers AS (SELECT list(x ORDER BY id) AS cs FROM single WHERE id < {NLIST}),
  doubles AS (SELECT list(u ORDER BY id) AS cds FROM unit WHERE id < {NLIST}),
  books AS (SELECT list(list_transform(r, lambda y: y::FLOAT::DOUBLE) ORDER BY id) AS b FROM (
    SELECT id, {minus('u', 'cds[list_position(d, list_min(d))]')} AS r FROM (SELECT *, {double} AS d FROM unit, doubles WHERE id >= {NLIST} AND id < {NLIST + K}))),
  rest AS (SELECT id, cs, cluster_id, {minus('x', 'cs[cluster_id + 1]')} AS x FROM (SELECT *, list_position(d, list_min(d)) - 1 AS cluster_id FROM (SELECT *, {near} AS d FROM single, centers))),
  probes AS (SELECT q.id AS query_id, k AS cluster_id, q.u FROM asked q, centers, range({NLIST}) r(k) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {value} DESC, k) <= {NPROBE})"""
    return head + _coded("rest") + _top(f"SELECT p.query_id, c.id, list_inner_product(p.u, c.cs[c.cluster_id + 1]) + {_table_score('p.u', 'c')} AS score FROM probes p JOIN coded c ON p.cluster_id = c.cluster_id")


#: Steps of the life of an index, and what each comes to.
LIFE = (
    ("repr", "ScalarIndex(bits=2, seed=0, use_prod=False, normalized=False)"), ("search", "3"), ("frozen", "True"), ("frozen search", "3"), ("frozen add", "RuntimeError"), ("frozen delete", "RuntimeError"),
    ("frozen compact", "RuntimeError"), ("frozen close", "RuntimeError"), ("unfreeze", "None"), ("add", "None"), ("length", "1"), ("add a known id", "ValueError"), ("delete", "True"), ("delete again", "False"),
    ("length after", "0"), ("close", "None"), ("search before fit", "RuntimeError"), ("fit with few rows", "ValueError"), ("fit", "None"), ("fit again", "RuntimeError"), ("5 bits", "ValueError"),
    ("correction of 2 bits", "ValueError"), ("stage of 1 bit", "ValueError"), ("1 centroid", "ValueError"), ("257 centroids", "ValueError"), ("7 subspaces", "ValueError"), ("two rotations", "ValueError"),
    ("1 cluster", "ValueError"), ("k of 0", "ValueError"), ("short vector", "ValueError"), ("not a number", "ValueError"), ("unknown option", "TypeError"), ("pool under k", "ValueError"),
    ("no such cluster", "ValueError"), ("rerank without vectors", "ValueError"),
)


def _front_matter() -> str:
    return """
WITH d AS (SELECT doc_id, lang, source, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) || ' #after #after' AS body,
  CASE doc_id % 3 WHEN 0 THEN [lang, 'two words', source] WHEN 1 THEN [source, lang] ELSE []::VARCHAR[] END AS front FROM documents),
t AS (SELECT *, list_concat(front, regexp_extract_all(body, '(^|[^\\w/])#([a-zA-Z][a-zA-Z0-9_\\-/]*)', 2)) AS ts FROM d)
SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(ts, range(1, len(ts) + 1)), lambda p: list_position(ts, p[1]) = p[2]), lambda p: p[1]), ',') AS tags,
  sha256(body) AS body_sha256 FROM t"""


def _embedded_chunks() -> str:
    counts = ", ".join(f"(length(chunk) - length(replace(chunk, '{c}', '')))::BIGINT AS n_{c}" for c in "ent")
    return _chunks().replace("SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, length(chunk)::BIGINT AS n_chars, sha256(chunk) AS chunk_sha256", f"SELECT doc_id || '#' || chunk_idx AS id, {counts}")


def _notes_search() -> str:
    found = _scalar_search(4, "c.label % 3 = 1")
    cut = found.index("\nSELECT query_id, rank")
    return f"""{found[:cut]}, found AS ({found[cut:]})
SELECT rank, f.id::VARCHAR AS id, score, 'folder/n' || f.id || '.md' AS path, f.id % 4 AS chunk_idx, 't1,all' AS tags, 'note ' || f.id || ' of label ' || label AS snippet
FROM found f JOIN unit u ON f.id = u.id WHERE query_id = 0"""


def _chunks() -> str:
    start = "{'done': []::VARCHAR[], 'now': '', 'n': 0}"
    full = "acc.n + length(p) > 1500 AND acc.n > 0"
    step = f"""{{'done': CASE WHEN {full} THEN list_append(acc.done, acc.now) ELSE acc.done END,
        'now': CASE WHEN {full} OR acc.n = 0 THEN p ELSE acc.now || chr(10) || chr(10) || p END,
        'n': (CASE WHEN {full} THEN 0 ELSE acc.n END) + length(p) + 2}}"""
    return f"""
WITH RECURSIVE paragraphs AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, p FROM (
    SELECT doc_id, generate_subscripts(ps, 1) AS i, regexp_replace(unnest(ps), '^\\s+|\\s+$', '', 'g') AS p
    FROM (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n') AS ps FROM documents)
  ) WHERE p <> ''
), packed AS (
  SELECT doc_id, i, 0 AS chunk_idx, length(p) + 2 AS n, p AS now FROM paragraphs WHERE i = 1
  UNION ALL
  SELECT a.doc_id, b.i, CASE WHEN a.n + length(b.p) > 1500 THEN a.chunk_idx + 1 ELSE a.chunk_idx END,
    CASE WHEN a.n + length(b.p) > 1500 THEN 0 ELSE a.n END + length(b.p) + 2, b.p
  FROM packed a JOIN paragraphs b ON a.doc_id = b.doc_id AND b.i = a.i + 1
), plain AS (
  SELECT doc_id, chunk_idx, string_agg(now, chr(10) || chr(10) ORDER BY i) AS chunk, max(chunk_idx) OVER (PARTITION BY doc_id) AS last FROM packed GROUP BY doc_id, chunk_idx
), folded AS (
  SELECT doc_id, CASE WHEN chunk_idx = last AND last > 0 AND length(chunk) < 200 THEN chunk_idx - 1 ELSE chunk_idx END AS chunk_idx, chunk_idx AS part, chunk FROM plain
)
SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, length(chunk)::BIGINT AS n_chars, sha256(chunk) AS chunk_sha256
FROM (SELECT doc_id, chunk_idx, string_agg(chunk, chr(10) || chr(10) ORDER BY part) AS chunk FROM folded GROUP BY doc_id, chunk_idx)"""


def _recall() -> str:
    found = _scalar_search(4).replace("WITH ", "", 1)
    cut = found.index("\nSELECT query_id, rank")
    exact = _top(f"SELECT q.id AS query_id, c.id, list_inner_product(c.u, q.u) AS score FROM unit q, unit c WHERE q.id % 100 = 0")
    return f"""WITH {found[:cut]}, found AS ({found[cut:]}), truth AS ({exact})
SELECT round(count(f.id) / count(*), 6) AS recall, count(*) AS n FROM truth t LEFT JOIN found f ON t.query_id = f.query_id AND t.id = f.id"""


_STRINGED = "array_to_string({}, ',')"

ORACLE_SQL: dict[str, str] = {
    "exact_topk": f"WITH {_base()}" + _top("SELECT q.id AS query_id, c.id, list_inner_product(c.u, q.u) AS score FROM unit q, unit c WHERE q.id % 100 = 0"),
    "vec_norm": f"WITH {_base(True)} SELECT id, round(n, 6) AS norm FROM unit",
    "rht": f"WITH {_base()}{_turned()}, y AS (SELECT id, list_transform(y, lambda x: x * n / 8) AS y FROM turned) " + _each("y", "y"),
    "pad_rht": f"WITH {_base(True, CUT)}{_turned(CUT)} " + _each("turned", "y"),
    **{f"sq_encode_b{b}": f"{_codes_of(b)} SELECT id, {_STRINGED.format('c')} AS codes FROM coded" for b in (2, 3, 4)},
    **{f"sq_pack_b{b}": _pack(b) for b in (2, 3, 4)},
    "sq_roundtrip_b3": f"{_codes_of(3)}, x AS (SELECT id, {_decode('c', get_codebook(3)[0])} AS x FROM coded) " + _each("x", "x"),
    **{f"sq_search_b{b}": _scalar_search(b) for b in (2, 3, 4)},
    "sq_search_padded": _scalar_search(4, scaled=True, dim=CUT),
    "sq_search_filtered": _scalar_search(4, "c.label % 2 = 0"),
    "sq_prod_search": _prod_search(),
    "residual_encode": _residual().replace("* (1 + vec_id % 5)", "") + f" SELECT id, {_STRINGED.format('c1')} AS codes1, {_STRINGED.format('c2')} AS codes2 FROM coded",
    "residual_search": _residual() + _top("SELECT query_id, id, score FROM scored"),
    "residual_rerank": _residual()
    + f", pool AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(coarse, 9) DESC, id) <= {POOL})"
    + _top("SELECT query_id, id, score FROM pool"),
    "kmeans_assign": _inverted(False) + " SELECT id, cluster_id::BIGINT AS cluster_id FROM assigned",
    "kmeans_step": _inverted(False)
    + """ SELECT cluster_id::BIGINT AS cluster_id, (j - 1)::INTEGER AS j, round(avg(x), 6) AS center, count(*) AS n
  FROM (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM assigned JOIN base ON assigned.id = base.id) GROUP BY cluster_id, j""",
    "pq_encode": f"WITH {_base()}, ready AS (SELECT id, u AS x FROM unit), books AS (SELECT list(x ORDER BY id) AS b FROM ready WHERE id < {K})"
    + _coded("ready")
    + f" SELECT id, {_STRINGED.format('c')} AS codes FROM coded",
    "pq_search": _product_search("u"),
    "pq_rht_search": _product_search("list_transform(y, lambda x: x / 8)", dim=CUT),
    "pq_opq_search": _product_search("list_transform(y, lambda x: x / 8)"),
    "opq_covariance": f"WITH {_base()}, e AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM base)"
    " SELECT a.j::BIGINT AS i, b.j::BIGINT AS j, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 8) + 0.0 AS c FROM e a JOIN e b ON a.id = b.id GROUP BY a.j, b.j",
    "ivf_assign": _inverted(False) + " SELECT id, cluster_id::BIGINT AS cluster_id FROM assigned",
    "ivf_cluster_sizes": _inverted(False)
    + f""" SELECT k::BIGINT AS cluster_id, count(id) AS n, coalesce(sum(count(id)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM range({NLIST}) r(k) LEFT JOIN assigned ON cluster_id = k GROUP BY k""",
    "ivf_probes": _inverted(False) + _probes() + " SELECT query_id, rank::BIGINT AS rank, cluster_id::BIGINT AS cluster_id FROM probes",
    "ivf_search": _inverted() + _probes() + _coded("rest") + _top(_inverted_scores()),
    "ivf_search_filtered": _inverted() + _probes("label % 2 = 0") + _coded("rest") + _top(_inverted_scores("c.label % 2 = 0")),
    "ivf_rerank": _inverted()
    + _probes()
    + _coded("rest")
    + f""", scores AS ({_inverted_scores()}),
  pool AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= {POOL}),
  half AS (SELECT id, n, u, list_transform(u, lambda x: {_half('x')}) AS h FROM unit)"""
    + _top("SELECT p.query_id, p.id, list_inner_product(h.h::DOUBLE[], q.u) * h.n AS score FROM pool p JOIN half h ON p.id = h.id JOIN half q ON q.id = p.query_id"),
    "delete_anti": "SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0",
    "delete_pq_search": _product_search("u", where="c.id % 7 <> 0"),
    "delete_ivf_search": _inverted() + _probes() + _coded("rest") + _top(_inverted_scores("c.id % 7 <> 0")),
    "duplicate_ids": "SELECT vec_id AS id FROM embeddings WHERE vec_id % 10 IN (3, 7)",
    "add_twice_search": _scalar_search(4),
    "zero_queries": _scalar_search(4, "q.id % 200 = 0"),
    "binary_scalar_search": _scalar_search(3),
    "binary_residual_search": _binary_residual(),
    "binary_product_search": _binary_product(),
    "binary_inverted_search": _binary_inverted(),
    "streaming_ingest": _scalar_search(4),
    "lifecycle": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{a}', '{b}')" for i, (a, b) in enumerate(LIFE)) + ") t(step, what, outcome)",
    "fit_centers": f"WITH {_base()}, first AS (SELECT * FROM unit WHERE id < {NLIST}) " + _each("first", "u"),
    "fit_invariants": "SELECT * FROM (VALUES " + ", ".join(f"('{x}', true)" for x in INVARIANTS) + ") t(invariant, holds)",
    "ivf_stats": _inverted(False)
    + f""", sizes AS (SELECT k, count(id) AS n FROM range({NLIST}) r(k) LEFT JOIN assigned ON cluster_id = k GROUP BY k)
SELECT sum(n)::BIGINT AS n, {DIM}::BIGINT AS dim, {M + 4}::BIGINT AS bytes_per_vector, min(n) AS cluster_min, floor(median(n))::BIGINT AS cluster_median, max(n) AS cluster_max,
  greatest(1, {NLIST} // 16)::BIGINT AS default_nprobe, {NLIST}::BIGINT AS nlist, {M}::BIGINT AS "M", {K}::BIGINT AS "K" FROM sizes""",
    "index_stats": """SELECT b::BIGINT AS bits, (SELECT count(*) FROM embeddings) AS n, 64::BIGINT AS dim, (8 * b + 4)::BIGINT AS bytes_per_vector,
  round(256 / (8 * b + 4), 6) AS compression_ratio FROM range(2, 5) r(b)""",
    "recall_at_10": _recall(),
    "chunk_documents": _chunks(),
    "hashtags": """SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda p: list_position(t, p[1]) = p[2]), lambda p: p[1]), ',') AS tags
  FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)) || ' #' || lang || ' #' || source || ' #' || lang, '(^|[^\\w/])#([a-zA-Z][a-zA-Z0-9_\\-/]*)', 2) AS t FROM documents)""",
    "tag_filter_search": _scalar_search(4, "c.label % 3 IN (0, 2)"),
    "front_matter": _front_matter(),
    "embedded_chunks": _embedded_chunks(),
    "notes_search": _notes_search(),
    "sidecar_status": "SELECT count(*) AS chunks, count(*) AS notes FROM embeddings",
    "snippet": f"SELECT doc_id, trim(regexp_replace(text, '{BLANKS}', ' ', 'g'), ' ')[1:220] AS snippet FROM documents",
}

ORACLE_SQL["save_load_search"] = ORACLE_SQL["ivf_rerank"]
