"""Personal data and secrets: candidates scored by boosted trees, all in column expressions.

High-recall patterns propose spans that overlap each other: the four base kinds, long mixed tokens, national
phone numbers, social security numbers and IBANs. Each candidate gets small integer features of two views:
its format (length, digits, letters, case, variety, strict validity, known prefix) and its context (a cue
word of its kind before it, an assignment or quote before it, the character after it).

There are no span labels, so each view is learned with the other one as its weak label: the format trees
predict the cue from the format alone, the context trees predict strict validity from the context alone; no
tree sees its own label. They are fitted on the counted table of distinct feature vectors over the candidates
of the corpus, whose size is bounded by the product of ``BINS``; one document in ``FOLDS`` is left out of the
fit and calibrates the thresholds: per kind and view the lowest score above which the weak label holds with
the stated precision, moving past whole runs of equal scores. A candidate is selected if its format passes,
or if its context passes and it is itself valid or announced by a cue. Base spans stay in any case; selected
candidates that overlap none of them are added, from the left, the longest of those that begin together.

Positions are code points. A pattern's matches and the gaps between them give the positions, without Python
on the executors; arrays are built in blocks, and overlaps are found by sorted sweeps, so a text with very
many candidates takes time in proportion to their number.

Defined cases: a null text is empty and has no span; texts of any length are searched whole (repeated groups
are possessive, which Java runs as loops); repeated rows are judged alike; with no candidate of a kind, or
with a weak label that never holds or cannot be told apart at the stated precision, nothing of that kind is
added; an empty table gives an empty result; ``redact`` leaves all other columns as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import apart, bind, stored

KINDS = ("email", "ip", "card", "phone", "secret", "national", "ssn", "iban")
BASE = 4  # the first kinds have spans that stay in any case
#: The patterns; a base match starts where its run of characters starts or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}",
    "national": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Words that announce a kind, in the lower-cased characters before a candidate.
CUES = {
    "email": "e-?mail|mail|mailto|contact",
    "ip": "ip|host|server|addr|address",
    "card": "card|visa|mastercard|amex|credit|debit",
    "phone": "phone|tel|call|mobile|fax|cell",
    "secret": "pass(?:word|wd|phrase)?|pwd|secret|token|credential|api.?key|access.?key|auth",
    "national": "phone|tel|call|mobile|fax|cell",
    "ssn": "ssn|social security|tax id",
    "iban": "iban|account|acct|bank",
}
CUE_END = r"(?:\s?(?:number|no|nr|id|is|at|me|address)\.?)?[^a-z0-9]{0,4}$"
PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|pk_|xox[abp]-|eyJ)"
FORMAT = ("kind", "length", "digits", "letters", "variety", "upper", "valid", "prefix")
CONTEXT = ("kind", "cue", "assign", "after")
FEATURES = (*FORMAT, *CONTEXT[1:])
#: Number of values of each feature; their product bounds the table that the trees are fitted on.
BINS = dict(zip(FEATURES, (len(KINDS), 5, 6, 3, 4, 3, 2, 2, 2, 2, 3), strict=True))
FOLDS = 5
BLOCK = 128  # elements that one aggregate gathers


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 30
    rate: float = 0.3
    ridge: float = 1.0
    precision: float = 0.95  # of the weak labels above a threshold, on the fold that was not fitted


def scan(items: Column, state: Column, step, element: str) -> Column:
    """Array of what ``step(state, x)`` -> (new state, element) gives along ``items``; the state is an int.

    An aggregate copies what it has gathered at every step, so it gathers at most ``BLOCK`` elements: a first
    pass carries the state alone from block to block, a second fills each block from its first state.
    """
    none = F.array().cast(f"array<{element}>")

    def after(block: Column, first: Column) -> Column:
        return F.aggregate(block, first, lambda s, x: step(s, x)[0].cast("int"))

    def within(block: Column, first: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            s, e = step(acc["s"], x)
            return F.struct(s.cast("int").alias("s"), F.array_append(acc["out"], e).alias("out"))

        return F.aggregate(block, F.struct(first.alias("s"), none.alias("out")), one, lambda a: a["out"])

    def firsts(blocks: Column) -> Column:
        begin = F.struct(state.cast("int").alias("s"), F.array().cast("array<int>").alias("at"))
        carry = lambda acc, b: F.struct(after(b, acc["s"]).alias("s"), F.array_append(acc["at"], acc["s"]).alias("at"))
        return F.aggregate(blocks, begin, carry, lambda a: a["at"])

    def blocked(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        cut = F.transform(numbers, lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(all_) > 0, bind(cut, lambda bs: F.flatten(F.zip_with(bs, firsts(bs), within)))).otherwise(none)

    return bind(items, blocked)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check digit of a string of digits fits (doubling every second digit from the right)."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def iban_checks(m: Column) -> Column:
    """True if the check digits fit: the country and check digits go last, letters count from 10, modulo 97."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: (F.when(c.between("0", "9"), r * 10).otherwise(r * 100) + value(c)) % 97
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    """The strict check of a kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "secret":
        return m.rlike(PREFIX) | (m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & F.length(m).isin(32, 40, 64))
    if kind == "national":
        return m.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]")
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return iban_checks(m)
    n = F.length(_digits(m))
    return n.between(14, 19) & luhn(_digits(m)) if kind == "card" else n.between(10, 15)


def _matches(text: Column, kind: str) -> Column:
    """Array of (m, before, after, at): a pattern's matches, characters around each, and its start."""
    pattern, element = PATTERNS[kind], "struct<m:string,before:string,after:string,at:int>"

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        at = pos + F.length(x["gap"])
        found = F.struct(x["m"].alias("m"), F.right(x["gap"], F.lit(32)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"), at.alias("at"))
        return at + F.length(x["m"]), found

    def walk(ms: Column) -> Column:
        def joined(gaps: Column) -> Column:
            pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(ms)), ms, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
            around = F.zip_with(pairs, F.slice(gaps, F.lit(2), F.size(ms)), lambda p, g: F.struct(p["gap"].alias("gap"), p["m"].alias("m"), g.alias("next")))
            return scan(around, F.lit(0), step, element)

        return F.when(F.size(ms) > 0, bind(F.split(text, pattern, -1), joined)).otherwise(F.array().cast(f"array<{element}>"))

    guard = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
    return F.when(guard, bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)).otherwise(F.array().cast(f"array<{element}>"))


def _features(kind: str, x: Column) -> Column:
    m, before = x["m"], F.lower(x["before"])
    n, d = F.length(m), F.length(_digits(m))
    a = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    u = F.length(F.regexp_replace(m, "[^A-Z]", ""))
    v = F.size(F.array_distinct(F.split(m, "")))
    steps = lambda c, *at: reduce(add, [(c >= t).cast("int") for t in at])
    strict = F.coalesce(valid(kind, m), F.lit(False))
    values = (
        F.lit(KINDS.index(kind)), steps(n, 8, 16, 24, 40), steps(d, 1, 4, 10, 14, 20), steps(a, 1, 6), steps(v, 6, 9, 12), steps(u, 1, 4),
        strict.cast("int"), m.rlike(PREFIX).cast("int") if kind == "secret" else F.lit(0),
        before.rlike(rf"(?:^|[^a-z])(?:{CUES[kind]}){CUE_END}").cast("int"), before.rlike("[=:#\"'][^a-z0-9]{0,3}$").cast("int"),
        F.when(x["after"].rlike(r"[\"']"), 2).when((x["after"] == "") | x["after"].rlike(r"\s"), 1).otherwise(0),
    )
    base = strict if kind in KINDS[:BASE] else F.lit(False)
    return F.struct(
        x["at"].alias("start"), (x["at"] + n).alias("end"), base.alias("base"),
        *[F.coalesce(c, F.lit(0)).cast("int").alias(f) for c, f in zip(values, FEATURES, strict=True)],
    )


def _candidate(kind: str):
    return lambda x: _features(kind, x)


def candidates(text: Column) -> Column:
    """Array of all candidates of all kinds with their features."""
    each = []
    for kind in KINDS:
        found = _matches(text, kind)
        if kind == "card":
            found = F.filter(found, lambda x: F.length(x["m"]) >= 7)
        if kind == "secret":
            found = F.filter(found, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
        each.append(F.transform(found, _candidate(kind)))
    return F.concat(*each)


@dataclass(frozen=True)
class Trees:
    """(feature, cut, feature if below, cut, feature if not below, cut, four leaf values) per tree."""

    bias: float = 0.0
    trees: tuple = ()
    thresholds: tuple = (math.inf,) * len(KINDS)  # per kind, on the raw score; infinite: nothing passes

    def raw(self, x: Column) -> Column:
        value = F.lit(self.bias)
        for f, t, lf, lt, rf, rt, v in self.trees:
            low = F.when(x[lf] <= lt, v[0]).otherwise(v[1])
            high = F.when(x[rf] <= rt, v[2]).otherwise(v[3])
            value = value + F.when(x[f] <= t, low).otherwise(high)
        return value

    def passes(self, x: Column) -> Column:
        limits = [F.when(x["kind"] == k, F.lit(t)) for k, t in enumerate(self.thresholds) if t < math.inf]
        return F.coalesce(self.raw(x) >= F.coalesce(*limits), F.lit(False)) if limits else F.lit(False)


@dataclass(frozen=True)
class Model:
    form: Trees = Trees()
    context: Trees = Trees()

    def selects(self, x: Column) -> Column:
        return self.form.passes(x) | (self.context.passes(x) & ((x["valid"] == 1) | (x["cue"] == 1)))


def fit(table: list[tuple[dict, int, int]], features: tuple[str, ...], params: BoostParams = BoostParams()) -> Trees:
    """Boosted depth-two trees on feature vectors with (rows, positive weak labels)."""
    total, positive = sum(n for _, n, _ in table), sum(p for _, _, p in table)
    if not total:
        return Trees()
    bias = math.log((positive + 0.5) / (total - positive + 0.5))
    scores, trees = [bias] * len(table), []

    def split(rows: list[int], g: list[float], h: list[float]) -> tuple[float, str, int]:
        best = (0.0, features[0], BINS[features[0]])
        whole_g, whole_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        gain = lambda a, b: a * a / (b + params.ridge)
        for f in features:
            by: dict[int, list[float]] = {}
            for i in rows:
                cell = by.setdefault(table[i][0][f], [0.0, 0.0])
                cell[0] += g[i]
                cell[1] += h[i]
            lg = lh = 0.0
            for cut in range(BINS[f] - 1):
                lg, lh = lg + by.get(cut, (0, 0))[0], lh + by.get(cut, (0, 0))[1]
                won = gain(lg, lh) + gain(whole_g - lg, whole_h - lh) - gain(whole_g, whole_h)
                if won > best[0] + 1e-9:
                    best = (won, f, cut)
        return best

    for _ in range(params.rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [pos - n * q for (_, n, pos), q in zip(table, p, strict=True)]
        h = [n * q * (1 - q) for (_, n, _), q in zip(table, p, strict=True)]
        rows = list(range(len(table)))
        won, f, t = split(rows, g, h)
        if won <= 1e-6:
            break
        sides = [[i for i in rows if table[i][0][f] <= t], [i for i in rows if table[i][0][f] > t]]
        node, values = [f, t], []
        for side in sides:
            _, sf, st = split(side, g, h)
            node += [sf, st]
            for part in ([i for i in side if table[i][0][sf] <= st], [i for i in side if table[i][0][sf] > st]):
                value = params.rate * sum(g[i] for i in part) / (sum(h[i] for i in part) + params.ridge)
                values.append(value)
                for i in part:
                    scores[i] += value
        trees.append((*node, tuple(values)))
    return Trees(bias, tuple(trees))


def raw_score(trees: Trees, x: dict) -> float:
    """The score of one feature vector, as ``Trees.raw`` gives it for columns."""
    value = trees.bias
    for f, t, lf, lt, rf, rt, v in trees.trees:
        value += (v[0] if x[lf] <= lt else v[1]) if x[f] <= t else (v[2] if x[rf] <= rt else v[3])
    return value


def calibrate(trees: Trees, table: list[tuple[dict, int, int]], precision: float) -> Trees:
    """Thresholds per kind on rows that were not fitted; equal scores are admitted together or not at all."""
    limits = []
    for k in range(len(KINDS)):
        by: dict[float, list[int]] = {}
        for x, n, pos in table:
            if x["kind"] == k:
                cell = by.setdefault(round(raw_score(trees, x), 9), [0, 0])
                cell[0] += n
                cell[1] += pos
        best, n, hit = math.inf, 0, 0
        for s in sorted(by, reverse=True):
            if 2 * by[s][1] < by[s][0]:  # vectors that are mostly wrong do not ride on the others' precision
                break
            n, hit = n + by[s][0], hit + by[s][1]
            if hit >= precision * n:
                best = s - 1e-6
        limits.append(best)
    return Trees(trees.bias, trees.trees, tuple(limits))


def learn(found: DataFrame, params: BoostParams = BoostParams()) -> Model:
    """Fit on the candidates column ``c`` of all rows, by their fold ``fold``; counts of distinct vectors are collected."""
    each = found.select((F.col("fold") == 0).alias("held"), F.explode("c").alias("x"))
    counts = each.groupBy("held", *[F.col(f"x.{f}").alias(f) for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"))
    rows = [(r["held"], {f: r[f] for f in FEATURES}, r["n"]) for r in counts.orderBy("held", *FEATURES).collect()]

    def view(features: tuple[str, ...], label: str) -> Trees:
        tables = [[(x, n, n * x[label]) for h, x, n in rows if h == held] for held in (False, True)]
        return calibrate(fit(tables[0], features, params), tables[1], params.precision)

    return Model(view(FORMAT, "cue"), view(CONTEXT, "valid"))


def base_spans(c: Column) -> Column:
    """(start, k, end) of the base spans, in order of start and kind."""
    only = F.filter(c, lambda x: x["base"])
    return F.array_sort(F.transform(only, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("k"), x["end"].alias("end"))))


def added_spans(c: Column, model: Model) -> Column:
    """Selected candidates that overlap no base span; where they overlap each other the first, then the longest stays."""
    element = "struct<start:int,back:int,k:int,base:boolean,near:int>"
    far = 1 << 30
    entry = lambda x, near: F.struct(*[x[f].alias(f) for f in ("start", "back", "k", "base")], near.cast("int").alias("near"))

    def before(s: Column, x: Column) -> tuple[Column, Column]:  # near: the largest end of a base span before
        return F.when(x["base"], F.greatest(s, -x["back"])).otherwise(s), entry(x, s)

    def after(s: Column, x: Column) -> tuple[Column, Column]:  # near: the least start of a base span after, if none before overlaps
        free = F.when(x["near"] > x["start"], F.lit(-1)).otherwise(s)
        return F.when(x["base"], F.least(s, x["start"])).otherwise(s), entry(x, free)

    def greedy(s: Column, x: Column) -> tuple[Column, Column]:  # near: 1 if it stays
        stays = x["start"] >= s
        return F.when(stays, -x["back"]).otherwise(s), entry(x, stays.cast("int"))

    def sweep(items: Column) -> Column:
        left = scan(F.array_sort(items), F.lit(0), before, element)
        right = scan(F.reverse(left), F.lit(far), after, element)
        free = F.filter(F.reverse(right), lambda x: ~x["base"] & (x["near"] >= -x["back"]))
        return F.filter(scan(free, F.lit(0), greedy, element), lambda x: x["near"] == 1)

    every = F.filter(c, lambda x: x["base"] | model.selects(x))
    items = F.transform(every, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("k"), x["base"].alias("base"), F.lit(0).alias("near")))
    spans = F.when(F.exists(items, lambda x: ~x["base"]), bind(items, sweep)).otherwise(F.array().cast(f"array<{element}>"))
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), (-x["back"]).alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def _searched(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with the candidates ``__c`` (searched once and stored) and the fold of each document."""
    fold = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).cast("int")
    return stored(docs.select(*[F.col(f"`{c}`") for c in keep], bind(F.coalesce(F.col("text"), F.lit("")), candidates).alias("__c"), fold.alias("__fold")), "candidates")


def learn_from(found: DataFrame, params: BoostParams = BoostParams()) -> Model:
    return learn(found.select(F.col("__c").alias("c"), F.col("__fold").alias("fold")), params)


def detect(docs: DataFrame, params: BoostParams = BoostParams()) -> DataFrame:
    """One row per document: base counts and digest, and all spans with those that the trees add."""
    found = _searched(docs, "doc_id")
    model = learn_from(found, params)
    count = lambda k: F.size(F.filter("b", lambda x: x["k"] == k)).cast("long")
    return (
        found.withColumn("b", base_spans(F.col("__c")))
        .select("doc_id", "b", F.when(F.size("__c") > 0, F.array_sort(F.concat("b", added_spans(F.col("__c"), model)))).otherwise(F.col("b")).alias("s"))
        .select(
            "doc_id",
            *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
            F.sha2(_joined(F.col("b")), 256).alias("base_sha256"),
            _joined(F.col("s")).alias("spans"),
        )
    )


def redact(docs: DataFrame, params: BoostParams = BoostParams()) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` (if present) follows.

    Other columns stay as they are, whatever their names.
    """
    return apart(docs, ("__c", "__fold"), lambda rows: _redacted(rows, params))


def _redacted(docs: DataFrame, params: BoostParams) -> DataFrame:
    found = _searched(docs, *docs.columns)
    model = learn_from(found, params)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def replaced(spans: Column) -> Column:
        def step(pos: Column, x: Column) -> tuple[Column, Column]:  # a span that begins inside the last one only extends it
            gap = F.substr(text, pos + 1, F.greatest(x["start"] - pos, F.lit(0)))
            return F.greatest(pos, x["end"]), F.when(x["start"] >= pos, F.concat(gap, F.get(names, x["k"]))).otherwise("")

        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(scan(spans, F.lit(0), step, "string"), ""), F.substr(text, end + 1, F.length(text)))

    spans = F.array_sort(F.concat(base_spans(F.col("__c")), added_spans(F.col("__c"), model)))
    clean = F.when(text.isNotNull(), bind(spans, lambda s: F.when(F.size(s) > 0, replaced(s)).otherwise(text)))
    out = found.select(*[clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
