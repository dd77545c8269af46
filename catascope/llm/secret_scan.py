"""Secret scans by a trigram inverted index.

Every rule is a regular expression. What its matches must contain is derived from its parsed form as a Boolean query
over trigrams of bytes with A-Z folded. Tasks cut their rows into blocks of ``BLOCK`` bytes (or one longer text), index
each block (trigram to rows) for the trigrams that the rules ask for, intersect and unite the postings, and verify the
rows that are left with the expression. A rule without mandatory trigrams scans every row. An index lives as long as its
block: nothing is shuffled, and a lost executor costs its blocks only.

Spans count code points, end exclusive. Null and empty texts have no span; repeated rows are rows of their own; other
columns are ignored; equal starts are listed in the order of the rules.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import by_value

BLOCK = 4 << 20
#: Strings that a query follows side by side; more of them are cut into shorter ones.
WIDE = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and how long the whole match or a group of it must be."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Public forms of credentials: key files, web tokens, access tokens by their prefix, and passwords inside addresses.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s]+-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----)?"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36})"),
    Rule("address", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s/@]{6,128}@[A-Za-z0-9.-]+"),
    Rule("bearer", r"authorization\x20*[:=]\x20*(?:bearer|basic)\x20+([A-Za-z0-9+/_.=-]+)", 16, 1, fold=True),
)
RULES = BASE + MORE


def _fold(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass").lower() if code < 128 else chr(code).encode("utf-8", "surrogatepass")


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    flat = [x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", list(dict.fromkeys(map(_key, flat))))


def _any(parts: list):
    parts = list(dict.fromkeys(map(_key, parts)))
    if True in parts:
        return True
    needs = {p: frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
    parts = [p for p in parts if not any(needs[o] < needs[p] for o in parts)]  # asking for more than another way adds nothing
    return parts[0] if len(parts) == 1 else ("or", parts)


def _key(q):
    """Hashable form, so equal parts are listed once."""
    return (q[0], tuple(q[1])) if isinstance(q, tuple) else q


def _grams(text: bytes):
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


def trigram_query(pattern: re.Pattern):
    """True (no demand), a trigram, or ("and" | "or", parts): what the folded bytes of every match contain.

    Runs of literals, small classes, optional literals and branches of those are followed as sets of strings; anything
    else ends the run. The query may ask for less than the expression, never for more.
    """
    from re import _parser as parser

    def walk(items, run: set[bytes], query: list) -> set[bytes]:
        """Strings that may end what was read so far, without a break since they began."""

        def end(strings: set[bytes]) -> set[bytes]:
            query.append(_any([_grams(s) for s in strings]))
            return {b""}

        def times(strings: set[bytes], more: set[bytes]) -> set[bytes]:
            if len(strings) * len(more) > WIDE:
                strings = end(strings)
            return {a + b for a, b in ((a, b) for a in strings for b in more)} if len(more) <= WIDE else end(more)

        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run = times(run, {_fold(value)})
            elif name == "IN":
                chars = letters(value)
                run = times(run, chars) if chars else end(run)
            elif name == "SUBPATTERN":
                run = walk(value[3], run, query)
            elif name == "ATOMIC_GROUP":
                run = walk(value, run, query)
            elif name == "BRANCH":
                exact, queries = set(), []
                for alternative in value[1]:
                    own: list = []
                    strings = walk(alternative, {b""}, own)
                    queries.append(_all([*own, _any([_grams(s) for s in strings])]))
                    exact = None if own or exact is None else exact | strings
                if exact is not None:
                    run = times(run, exact)
                else:
                    run = end(run)
                    query.append(_any(queries))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = value
                own = []
                strings = walk(body, {b""}, own)
                if own:  # it breaks inside
                    run = end(run)
                    if low:
                        query.append(_all([*own, _any([_grams(s) for s in strings])]))
                elif low == 0 and high == 1:
                    run = times(run, strings | {b""})
                else:
                    for _ in range(min(low, 8)):
                        run = times(run, strings)
                    if low != high or low > 8:
                        run = end(run)
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
                run = end(run)
        return run

    def letters(members) -> set[bytes]:
        out = set()
        for op, value in members:
            if str(op) == "LITERAL":
                out.add(_fold(value))
            elif str(op) == "RANGE" and value[1] - value[0] < 8:
                out |= {_fold(c) for c in range(value[0], value[1] + 1)}
            else:
                return set()
        return out if len(out) <= 8 else set()

    query: list = []
    rest = walk(parser.parse(pattern.pattern, pattern.flags), {b""}, query)
    return _all([*query, _any([_grams(s) for s in rest])])


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams(q) for q in query[1]))


class BlockIndex:
    """Postings of the wanted trigrams over the rows of one block; rows are numbered from 0."""

    def __init__(self, wanted: Sequence[bytes]):
        import numpy as np

        self.codes = np.array(sorted(int.from_bytes(t, "big") for t in wanted), np.int64)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32

    def build(self, data, offsets) -> None:
        """``data``: the bytes of all rows; ``offsets``: where each begins, and the end."""
        import numpy as np

        b = self.low[data].astype(np.int32)
        hit = np.flatnonzero(self.wanted[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]) if len(b) > 2 and len(self.codes) else np.zeros(0, int)
        row = np.searchsorted(offsets, hit, "right") - 1
        inside = hit + 3 <= offsets[row + 1]
        hit, row = hit[inside], row[inside]
        code = np.searchsorted(self.codes, (b[hit] << 16) | (b[hit + 1] << 8) | b[hit + 2])
        pairs = np.unique(code * len(offsets) + row)
        self.rows = pairs % len(offsets)
        self.begin = np.searchsorted(pairs, np.arange(len(self.codes) + 1) * len(offsets))
        self.n = len(offsets) - 1

    def search(self, query):
        """Sorted row numbers that satisfy the query."""
        import functools

        import numpy as np

        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            k = np.searchsorted(self.codes, int.from_bytes(query, "big"))
            return self.rows[self.begin[k] : self.begin[k + 1]]
        if query[0] == "or":
            return functools.reduce(np.union1d, [self.search(q) for q in query[1]])
        found = None
        for part in query[1]:
            found = self.search(part) if found is None else np.intersect1d(found, self.search(part), assume_unique=True)
            if not len(found):
                break
        return found


def _matches(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]


def _full_pattern(rule: Rule, pattern: re.Pattern) -> re.Pattern:
    """For a class repeated once or more with a least length of the whole match: its maximal stretches of that length."""
    from re import _parser as parser

    parsed = list(parser.parse(rule.pattern, pattern.flags))
    if len(parsed) == 1 and str(parsed[0][0]) == "MAX_REPEAT" and parsed[0][1][0] == 1 and not rule.group and rule.least > 1 and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1:
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", pattern.flags)
    return pattern


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, hits, n_verified): per document its spans (rule number, start, end) by start, then rule; and the rows verified."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        patterns = [r.compiled() for r in rules]
        queries = [trigram_query(p) for p in patterns]
        index = BlockIndex(sorted(set().union(*map(trigrams, queries))))
        patterns = [_full_pattern(r, p) if q is True else p for r, p, q in zip(rules, patterns, queries, strict=True)]
        span = pa.list_(pa.struct([("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(1)
            offsets = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))])
            first = 0
            while first < batch.num_rows:
                after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
                values = [t or b"" for t in texts[first:after].to_pylist()]
                index.build(np.frombuffer(b"".join(values), np.uint8), offsets[first : after + 1] - offsets[first])
                hits: list[list] = [[] for _ in values]
                decoded: dict[int, str] = {}
                verified = [0] * len(values)
                for j, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                    for row in index.search(query).tolist():
                        if row not in decoded:
                            decoded[row] = values[row].decode()
                        verified[row] += query is not True
                        hits[row] += [(s, j, e) for s, e in _matches(rule, pattern, decoded[row])]
                out = [[{"rule": j, "start": s, "end": e} for s, j, e in sorted(h)] for h in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:after], pa.array(out, span), pa.array(verified, pa.int64())], names=["key", "hits", "n_verified"])
                first = after

    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), data.alias("t"), F.octet_length(data).cast("long").alias("n"))
    return rows.mapInArrow(run, f"key {kind}, hits array<struct<rule:int,start:long,end:long>>, n_verified long").withColumnRenamed("key", key)


def secret_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The digest columns of every document; the first three rules are the base kinds."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    line = lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda hits: F.array_join(F.transform(hits, line), ",")
    base = F.filter("hits", lambda x: x["rule"] < len(BASE))
    count = lambda k: F.size(F.filter("hits", lambda x: x["rule"] == k)).cast("long").alias(f"n_{BASE[k].kind}")
    found = scan(docs, rules)
    return found.select("doc_id", *[count(k) for k in range(len(BASE))], F.sha2(joined(base), 256).alias("base_sha256"), joined("hits").alias("spans"), F.size("hits").cast("long").alias("n_spans"), "n_verified")


warnings.filterwarnings("ignore", category=FutureWarning, module=__name__)
by_value(__name__)
