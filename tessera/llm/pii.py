"""Personal data: patterns, and further spans that boosted trees choose among candidates of high-recall generators."""

from __future__ import annotations

from functools import reduce
from random import Random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import overlay, packed, written
from .spans import find_spans, joined

#: Fixed values of the base scan. A pattern may only start where a run begins or the last match ended, which changes no
#: match and keeps long runs linear; possessive loops match the same and don't recurse.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: Generators of candidates; they overlap each other and the base on purpose, and each holds the base spans of its sort.
#: Loops are possessive and open-ended: a number ends in a digit by construction.
GENERATORS = {
    "mail": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "digits": r"(?:(?<![0-9(])\()?+(?<![0-9])[0-9](?:[\x20().-]{0,3}+[0-9])++",
    "dotted": r"(?<![0-9])[0-9]++(?:(?:\.|\[\.\]|\x20?\(dot\)\x20?)[0-9]++){3,}+",
    "colons": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,}+(?<=[0-9A-Fa-f])",
    "plus": r"\+[0-9](?:[\x20().-]*+[0-9])++",
    "run": r"(?<![0-9])[0-9]{7,}+",
    "national": r"(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}+(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])",
}
ORDER = ["email", "ip", "card", "phone", "likely"]

#: Words before a candidate, by what they speak for; 1 stands for none of them.
CONTEXT = {
    0: r"(?i)(?:order|invoice|isbn|issn|version|ver|release|item|sku|part|page|pages|pp|doi|date|ticket|ref|room|build|batch)[.:#]?\x20{0,2}(?:no\.?\x20{0,2}|nr\.?\x20{0,2}|number\x20{0,2}|is\x20{0,2})?\z",
    2: r"(?i)(?:e-?mail|mailto|contact|write to|reach)\W{0,3}(?:me at\x20|is\x20)?\z",
    3: r"(?i)(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|ring)\W{0,3}(?:me at\x20|me on\x20|is\x20|us at\x20)?\z",
    4: r"(?i)(?:card|visa|iban|account|acct|ssn|social security|passport|licen[cs]e|tax id)\W{0,3}(?:no\.?\x20|nr\.?\x20|number\x20)?(?:is\x20)?\z",
    5: r"(?i)(?:ip|host|address|server|mac|ping|gateway)\W{0,3}(?:is\x20)?\z",
}
#: Features, and how many values each has; a vector is one value of each, so there are a bounded number of them.
VALUES = {"f_generator": len(GENERATORS), "f_digits": 10, "f_letters": 4, "f_groups": 8, "f_first": 6, "f_longest": 8, "f_shape": 6, "f_luhn": 2, "f_octets": 2, "f_context": 6, "f_before": 3, "f_after": 3}
FEATURES = list(VALUES)
ROUNDS, SHRINK = 120, 0.3
#: Share of held-out candidates at a score that must be personal data, by generator, for the score to select.
PRECISION = 0.98
#: Example texts that the trees and the thresholds are made from, half each; made here, not taken from the corpus.
EXAMPLES = 8000


def _spans(base: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """find_spans(), where a pattern's own signs stand in the text at all."""
    text = F.col("__text")
    base = base.withColumn("__digit", text.rlike("[0-9]"))
    at, digit = text.contains("@"), F.col("__digit")
    needs = {
        "email": at, "mail": at | text.contains("(at)") | text.contains("[at]") | (text.contains(" at ") & text.contains(" dot ")),
        "plus": text.contains("+"), "phone": text.contains("+"), "colons": text.contains(":"),
    } | dict.fromkeys(("ip", "card", "digits", "run", "dotted", "national", "iban"), digit)
    return find_spans(base, kinds, {k: c for k, c in needs.items() if k in kinds})


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, F.lit(0) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(rows: DataFrame) -> DataFrame:
    """The base spans among matches: those that pass their kind's check."""
    rows = rows.withColumn("__d", F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))))
    n = F.length("__d")
    ok = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.col("match").rlike(VALID_IP))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), luhn(F.col("__d"))).otherwise(F.lit(False)))
        .when(F.col("kind") == "phone", n.between(9, 15))
    )
    return rows.where(ok).select("__id", "__th", "kind", "s", "e")


def _features(rows: DataFrame) -> DataFrame:
    digits, match = _digits(F.col("match")), F.col("match")
    rows = rows.withColumn("__d", digits)
    n = F.length("__d")
    rows = rows.withColumn("__g", F.transform(F.filter(F.split(match, r"[^0-9A-Za-z]+"), lambda g: g != ""), lambda g: F.length(g)))
    context = F.lit(1)
    for k, p in CONTEXT.items():
        context = F.when(F.col("before").rlike(p), F.lit(k)).otherwise(context)
    shape = F.when(~match.rlike(r"[^0-9A-Za-z]"), 0).when(match.rlike(r"[()\[\]]"), 4)
    for k, sign in ((1, r"\x20"), (2, "-"), (3, r"\.")):
        shape = shape.when(~match.rlike(rf"[^0-9A-Za-z{sign}]"), k)

    def edge(c: Column) -> Column:
        return F.when(c.rlike(r"^[0-9A-Za-z]$"), 2).when(c.rlike(r"^[!-/:-@\[-`{-~]$"), 1).otherwise(0)

    new = {
        "f_generator": F.array_position(F.array(*[F.lit(g) for g in GENERATORS]), F.col("kind")) - 1,
        "f_digits": F.when(n == 0, 0).when(n < 7, 1).when(n < 12, n - 5).when(n < 16, 7).when(n < 20, 8).otherwise(9),
        "f_letters": F.when(~match.rlike("[A-Za-z]"), 0).when(match.rlike("@"), 1).when(match.rlike(r"[(\[]|\x20(?:at|dot)\x20"), 2).otherwise(3),
        "f_groups": F.least(F.size("__g"), F.lit(7)),
        "f_first": F.least(F.coalesce(F.get("__g", F.lit(0)), F.lit(0)), F.lit(5)),
        "f_longest": F.least(F.coalesce(F.array_max("__g"), F.lit(0)), F.lit(7)),
        "f_shape": shape.otherwise(5),
        "f_luhn": F.when(n.between(12, 19) & luhn(F.col("__d")), 1).otherwise(0),
        "f_octets": F.when(F.regexp_replace(match, r"\[\.\]|\x20?\(dot\)\x20?", ".").rlike(VALID_IP), 1).otherwise(0),
        "f_context": context,
        "f_before": edge(F.right("before", F.lit(1))),
        "f_after": edge(F.left("after", F.lit(1))),
    }
    return rows.select("__id", "__th", "kind", "s", "e", *[c.cast("int").alias(k) for k, c in new.items()])


def _example(r: Random) -> tuple[str, int, int, bool]:
    """A text, the place of what stands in it, and whether that is personal data; formats and look-alikes by turns."""

    def d(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def nz(n: int) -> str:
        return r.choice("123456789") + d(n - 1)

    def word() -> str:
        return "".join(r.choice(("ba", "de", "fi", "go", "ku", "la", "me", "no", "pi", "ra", "su", "ti", "ve", "xo", "za")) for _ in range(r.randint(1, 4)))

    def number(n: int, valid: bool) -> str:
        x = nz(n - 1)
        total = sum(v if i % 2 else 2 * v - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(x)))
        return x + str((-total + (0 if valid else r.randint(1, 9))) % 10)

    def by(sign: str, *sizes: int) -> str:
        return sign.join(d(n) for n in sizes)

    def cut(x: str, sign: str, n: int = 4) -> str:
        return sign.join(x[i : i + n] for i in range(0, len(x), n))

    def pick(*options: str) -> str:
        return r.choice(options)

    mail, phone = ("mail", "email:", "contact", "write to"), ("phone", "call", "tel.", "mobile:", "fax")
    paper, net = ("account", "ssn", "passport no.", "card", "iban:"), ("ip", "host", "server", "address:")
    dull = ("order", "invoice no.", "isbn", "version", "page", "ticket", "item", "ref.", "date:")
    none = ("",)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    octets = [str(r.randint(0, r.choice((9, 99, 255)))) for _ in range(4)]
    forms = [  # (personal, words that stand before it, the thing)
        (True, mail + none * 4, word() + pick("", ".", "_") + word() + pick("@", " @ ", "(at)", " (at) ", "[at]", " [at] ") + word() + pick(".", "(dot)", " (dot) ", "[dot]", " [dot] ") + pick("com", "org", "de", "io")),
        (True, mail + none * 4, word() + " at " + word() + " dot " + pick("com", "org", "net")),
        (True, phone + none * 5, pick(f"({d(3)}) {by('-', 3, 4)}", by("-", 3, 3, 4), by(".", 3, 3, 4), by(" ", 3, 3, 4), f"({d(3)}) {by(' ', 3, 4)}")),
        (True, phone + none * 4, "0" + pick(by(" ", 2, 7), by(" ", 3, 3, 4), by("-", 3, 7), by(" ", 2, 3, 2, 2), by(" ", 1, 2, 2, 2, 2))),
        (True, phone, pick(d(7), d(10), by("-", 3, 4), by(" ", 3, 4), by(" ", 2, 2, 2, 2), "+" + nz(7), "+" + nz(8))),
        (True, paper + none * 5, by("-", 3, 2, 4)),
        (True, paper, pick(d(8), d(9), d(10), d(12), cut(number(16, False), pick("", " ", "-", ".")))),
        (True, paper + none * 3, cut(number(16, True), pick(".", "  ", " - "))),
        (True, paper + none * 6, number(16, True)),
        (True, paper + none * 3, pick("DE", "FR", "ES", "GB") + pick(d(18), d(20), d(2) + " " + cut(d(16), " "), d(2) + " " + cut(d(18), " "))),
        (True, net + none * 4, pick("[.]", " (dot) ", "(dot)").join(octets)),
        (True, net + none * 4, pick(":".join(hexa(4) for _ in range(8)), hexa(4) + ":" + hexa(3) + "::" + hexa(4) + ":" + hexa(2), ":".join(hexa(2) for _ in range(6)))),
        (False, none * 3 + dull, pick(f"{r.randint(1900, 2030)}-{by('-', 2, 2)}", f"{by('.', 2, 2)}.{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)} {r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}")),
        (False, none, f"{r.randint(1900, 2030)}-{by('-', 2, 2)} {by(':', 2, 2)}"),
        (False, none + dull, pick(by(":", 2, 2, 2, 2), by(":", 1, 2, 2, 3), word() + "::" + word() + "::" + word())),
        (False, none * 3 + dull, ".".join(str(r.randint(0, 2000)) for _ in range(r.randint(5, 7)))),
        (False, none + dull, ".".join([str(r.randint(1, 20)), str(r.randint(0, 20)), str(r.randint(0, 20)), str(r.randint(256, 30000))])),
        (False, none * 6 + dull, pick(nz(7), nz(8), nz(9), nz(10), nz(11), nz(13), number(16, False), number(16, False), nz(20), nz(24), nz(40))),
        (False, dull, pick(nz(8), nz(10), by("-", 3, 4), by("-", 3, 3, 4), by("-", 3, 2, 4), by("-", 3, 1, 2, 6, 1), cut(number(16, False), "-"))),
        (False, none + dull, d(1) + "." + d(r.randint(6, 16))),
        (False, none * 3 + dull, " ".join(d(r.randint(1, 6)) for _ in range(r.randint(6, 12)))),
        (False, none + dull, cut(nz(9), pick(" ", "."), 3)),
        (False, none, f"{r.randint(1, 99)} {pick('@', '@ ')}{r.randint(1, 99)}.{d(2)}"),
        (False, none, pick(word(), hexa(3) + "x") + nz(r.randint(7, 14)) + pick(word(), "x" + hexa(4))),
        (False, none, "+" + pick(by(" ", 1, 1), by(".", 1, 2), by(" - ", 2, 2), by(" ", 2, 2, 2))),
    ]
    personal, cues, thing = r.choice(forms)
    cue = r.choice(cues)
    before = " ".join(word() for _ in range(r.randint(0, 4))) + r.choice(("", " ", ", ", ". ", " (", "\n")) * (r.random() < 0.3)
    before = " ".join(filter(None, (before.rstrip(" ") if cue else before, cue)))
    before = before + " " if before and before[-1] not in " (\n" else before
    after = r.choice(("", ".", ",", ")", " ", ". ", "\n")) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
    glued = thing[0].isalpha() and thing[-1].isalnum() and any(c.isdigit() for c in thing) and not personal
    start = len(before)
    return before + thing + (after if not glued else " " + after), start, start + len(thing), personal


def examples(n: int, seed: int = 5) -> list[tuple[str, int, int, bool]]:
    """n example texts: (text, start, end, whether what stands there is personal data)."""
    r = Random(seed)
    return [_example(r) for _ in range(n)]


def _table(rows: list[tuple[tuple[int, ...], bool]]) -> list[tuple[tuple[int, ...], int, int]]:
    counts: dict[tuple[int, ...], list[int]] = {}
    for x, personal in rows:
        counts.setdefault(x, [0, 0])[not personal] += 1
    return [(x, p, n) for x, (p, n) in sorted(counts.items())]


_models: dict[tuple[int, int], tuple[list[tuple[int, int, int, int, list[float]]], dict[int, float]]] = {}


def trained(spark: SparkSession, n: int = EXAMPLES, seed: int = 5) -> tuple[list[tuple[int, int, int, int, list[float]]], dict[int, float]]:
    """Trees, and each generator's threshold: fitted to one half of n examples and calibrated on the other.

    Examples go through the generators and features that documents go through. A candidate is personal data if an example's
    personal data and it are mostly the same stretch.
    """
    if (n, seed) not in _models:
        made = examples(n, seed)
        texts = spark.range(1).select(F.posexplode(F.split(F.lit("\x1e".join(t for t, *_ in made)), "\x1e")).alias("__id", "__text"))
        texts = texts.repartition(spark.sparkContext.defaultParallelism)  # one row of text would be one task's
        found = _features(_spans(texts.withColumn("__th", F.lit(0)), GENERATORS))
        halves: list[list[tuple[tuple[int, ...], bool]]] = [[], []]
        for c in found.select("__id", "s", "e", *FEATURES).collect():  # a few candidates for each example
            _, s, e, personal = made[c["__id"]]
            same = min(e, c.e) - max(s, c.s)
            halves[c["__id"] % 2].append((tuple(c[f] for f in FEATURES), personal and same >= 0.8 * (e - s) and same >= 0.7 * (c.e - c.s)))
        trees = boost(_table(halves[0]))
        held = _table(halves[1])
        _models[(n, seed)] = trees, calibrate(held, [score_of(trees, x) for x, _, _ in held])
    return _models[(n, seed)]


def boost(table: list[tuple[tuple[int, ...], int, int]]) -> list[tuple[int, int, int, int, list[float]]]:
    """Gradient-boosted trees of two splits from (vector, positives, negatives); logistic loss, Newton leaves.

    A tree is (feature, value, feature, value, four leaves): a split asks whether the feature is at most the value; the
    leaf's place is 2 * first + second. Every candidate counts, in its vector's row; ties go to the first split.
    """
    if not table:
        return []
    x = np.array([v for v, _, _ in table])
    pos, total = (np.array(c, float) for c in ([p for _, p, _ in table], [p + n for _, p, n in table]))
    splits = [(f, v) for f, name in enumerate(FEATURES) for v in range(VALUES[name] - 1) if 0 < (x[:, f] <= v).sum() < len(x)]
    if not splits:
        return []
    low = np.array([x[:, f] <= v for f, v in splits], float)
    scores, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        sums = np.stack((pos - total * p, total * p * (1 - p)))  # gradients and curvatures

        def leaves(one: int, sums: np.ndarray = sums) -> np.ndarray:
            """Sums of the four leaves that split `one` and each split make: (2, splits, 4)."""
            by_side = [sums * side for side in (1 - low[one], low[one])]
            both = [(s @ (1 - low).T, s @ low.T) for s in by_side]
            return np.stack([*both[0], *both[1]], axis=2)

        def gains(g: np.ndarray) -> np.ndarray:
            return np.round((g[0] ** 2 / (g[1] + 1)).sum(1), 9)

        first = int(np.argmax([gains(leaves(k))[k] for k in range(len(splits))]))
        found = leaves(first)
        second = int(np.argmax(gains(found)))
        values = SHRINK * found[0, second] / (found[1, second] + 1)
        trees.append((*splits[first], *splits[second], values.tolist()))
        scores = scores + values[(2 * low[first] + low[second]).astype(int)]
    return trees


def score_of(trees: list[tuple[int, int, int, int, list[float]]], x: tuple[int, ...]) -> float:
    return sum(v[2 * (x[a] <= b) + (x[c] <= d)] for a, b, c, d, v in trees)


def _score(trees: list[tuple[int, int, int, int, list[float]]]) -> Column:
    def tree(a: int, b: int, c: int, d: int, v: list[float]) -> Column:
        low, low2 = F.col(FEATURES[a]) <= b, F.col(FEATURES[c]) <= d
        return F.when(low & low2, v[3]).when(low, v[2]).when(low2, v[1]).otherwise(v[0])

    return reduce(lambda s, t: s + t, [tree(*t) for t in trees], F.lit(0.0))


def calibrate(table: list[tuple[tuple[int, ...], int, int]], scores: list[float]) -> dict[int, float]:
    """For each generator the lowest score from which on PRECISION of its candidates are personal data; none without."""
    out: dict[int, float] = {}
    for g in {x[0] for x, _, _ in table}:
        pos = total = 0
        rows = sorted(((z, p, n) for (x, p, n), z in zip(table, scores, strict=True) if x[0] == g), reverse=True)
        for i, (z, p, n) in enumerate(rows):
            pos, total = pos + p, total + p + n
            if (i + 1 == len(rows) or rows[i + 1][0] < z) and pos >= PRECISION * total:
                out[g] = z
    return out


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text: e-mail, IP address, payment card, phone, and likely ones.

    The base spans are the matches of PATTERNS that pass their checks. Generators propose overlapping candidates, among
    them look-alikes, spelled-out and national forms; binned features of format and context give each a vector. Boosted
    trees score it. There are no labels of personal data, so trees are fitted to examples made from known formats and
    look-alikes (trained(): a fixed number), and each generator's threshold is calibrated on examples held out. Those selected
    that overlap no base span are merged where they overlap, and added as "likely". SQL functions only; only matches are
    shuffled.

    Returns the columns of docs, and n_email, n_ip, n_card, n_phone, n_likely (long), base_spans and spans (strings of
    kind:start:end, code points, by start and kind); columns of these names are replaced. A null text is empty and has no
    spans. Repeated rows get the same spans each; null ids are served like others. An empty table gives an empty one.
    """
    base = packed(docs, id_col, text_col)
    rows = written(_spans(base, PATTERNS | GENERATORS), "personal-spans")
    sure = _valid(rows.where(F.col("kind").isin(*PATTERNS)))
    candidates = _features(rows.where(F.col("kind").isin(*GENERATORS)))
    # both kinds of rows of a document in one order of starts: the furthest end of base spans so far, and the next start
    marks = candidates.unionByName(sure.select("__id", "__th", F.lit("base").alias("kind"), "s", "e"), allowMissingColumns=True)
    w = Window.partitionBy("__id", "__th").orderBy("s", F.when(F.col("kind") == "base", 0).otherwise(1))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marks = marks.withColumn("__end", F.max(F.when(F.col("kind") == "base", F.col("e"))).over(upto))
    marks = marks.withColumn("__next", F.min(F.when(F.col("kind") == "base", F.col("s"))).over(after))
    covers = F.coalesce(F.col("__end") > F.col("s"), F.lit(False)) | F.coalesce(F.col("__next") < F.col("e"), F.lit(False))
    trees, limits = trained(docs.sparkSession)
    limit = F.lit(float("inf"))
    for g, z in limits.items():
        limit = F.when(F.col("f_generator") == g, F.lit(z - 1e-9)).otherwise(limit)
    chosen = marks.where("kind <> 'base'").where(~covers).where(_score(trees) >= limit).select("__id", "__th", "s", "e")
    # overlapping ones become one: a span starts where nothing before it reaches
    by_start = Window.partitionBy("__id", "__th").orderBy("s", "e")
    reach = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("__new", F.when(reach > F.col("s"), 0).otherwise(1)).withColumn("__group", F.sum("__new").over(by_start))
    likely = chosen.groupBy("__id", "__th", "__group").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    likely = likely.select("__id", "__th", F.lit("likely").alias("kind"), "s", "e")
    both = sure.unionByName(likely).groupBy(F.col("__id").alias("__sid"), F.col("__th").alias("__sth"))
    is_base = F.col("kind") != "likely"
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    text = F.struct("s", rank.alias("k"), "e", F.concat_ws(":", "kind", "s", "e").alias("t"))
    per_doc = both.agg(
        *[F.count_if(F.col("kind") == k).alias(f"__n_{k}") for k in (*PATTERNS, "likely")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_base, text))), lambda x: x["t"]), ",").alias("__base"),
        joined(sure, ORDER).alias("__all"),
    )
    out = base.join(per_doc, F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__th") == F.col("__sth")), "left")
    new = {f"n_{k}": F.coalesce(F.col(f"__n_{k}"), F.lit(0)).cast("long") for k in (*PATTERNS, "likely")}
    return overlay(out, "__row", new | {"base_spans": F.coalesce("__base", F.lit("")), "spans": F.coalesce("__all", F.lit(""))})


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = ("n_email", "n_ip", "n_card", "n_phone", "n_likely")
    return out.select(
        "doc_id", *counts, sum(F.col(c) for c in counts).alias("n_personal"), F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans"
    )
