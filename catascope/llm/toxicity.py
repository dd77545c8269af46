"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is a logistic of its words' weights; a document's score is the noisy-or of its
sentences with a small leak. Words count by themselves and by their prefixes, so inflected forms share
weight. The classifier is fitted on a bounded sample of the labelled rows (``TrainParams.max_docs``, half
for each class; the classes are weighted back to their frequencies). Tasks turn the sample into packed
numbers, words by position and sentence, and all features that ``min_docs`` sampled documents hold are
fitted by gradient steps in numpy: what is fitted is one weight per feature, what is stepped through are the
sample's words once, whatever features they have. Scoring runs over all whole texts and also locates the
worst sentence.

Defined cases: null, empty and wordless texts get the leak as their score; documents without a doc_id are
never trained on and count as held out; label rows without a 0/1 label are ignored; repeated rows are
scored alike; without labels of both classes every score is the share of toxic rows (0.5 if none); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import by_value, stored

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5, 6, 7)
BUCKETS = 1 << 20


@dataclass(frozen=True)
class TrainParams:
    max_docs: int = 8000  # bound of the labelled sample
    min_docs: int = 4  # a feature must occur in so many sampled documents
    steps: int = 250
    rate: float = 0.05
    ridge: float = 1e-4


@dataclass(frozen=True)
class Model:
    leak: float = 0.5
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)


def lower(text: str) -> str:
    """Lower case, letter by letter where that would change the length, so that places stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower()[:1] for c in text])


def features(word: str) -> list[int]:
    """Hashed buckets of a lower-case word and of its prefixes."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    out += [zlib.crc32(b"^" + word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) >= n]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int = 5, max_docs: int = 8000) -> DataFrame:
    """(doc_id, text, toxic) of a sample of at most about ``max_docs`` labelled rows outside the held-out fold."""
    usable = labels.where("toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % held_out != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("toxic") == t, F.lit(min(1.0, max_docs / 2 / n))) for t, n in sizes.items()], F.lit(0.0))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    # about max_docs rows
    return docs.select("doc_id", "text").join(F.broadcast(usable.where(lot < share)), "doc_id").select("doc_id", "text", "toxic")


def packed_words(rows: DataFrame) -> DataFrame:
    """(doc, toxic, words, block): a row per document; its distinct words, and each word's place among them by sentence."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names, blocks = [], []
            for text in batch.column(2):
                place: dict[str, int] = {}
                lines = [WORD.findall(s) for s in SENTENCE.findall(lower(text.as_py() or ""))]
                lines = [[place.setdefault(w, len(place)) for w in line] for line in lines if line]
                sizes = np.array([len(line) for line in lines], dtype=np.int32)
                blocks.append(len(sizes).to_bytes(4, "little") + sizes.tobytes() + np.array([i for line in lines for i in line], dtype=np.int32).tobytes())
                names.append(" ".join(place))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names), pa.array(blocks, pa.binary())], names=["doc", "toxic", "words", "block"])

    return rows.select(F.xxhash64("doc_id").alias("doc"), F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "doc long, toxic int, words string, block binary")


@dataclass
class Sample:
    """The sampled documents as numbers; features come by word type."""

    toxic: object  # label of each document
    owner: object  # document of each sentence
    sentence: object  # of each word
    word: object  # type of each word
    of: object  # type of each (type, feature) pair
    feature: object  # feature of each pair
    buckets: object  # bucket of each feature
    held: object  # documents of each class that hold a feature: (features, 2)


def gather(rows: DataFrame, min_docs: int) -> Sample:
    """Collects the bounded sample, document by document, in the order of their hashes."""
    import numpy as np

    types: dict[str, int] = {}
    toxic, owner, sizes, words, seen = [], [], [], [], []
    for r in rows.orderBy("doc", "toxic", "words").toLocalIterator():
        place = np.array([types.setdefault(w, len(types)) for w in r["words"].split()], dtype=np.int32)
        n = int.from_bytes(r["block"][:4], "little")
        sizes.append(np.frombuffer(r["block"], np.int32, n, 4))
        words.append(place[np.frombuffer(r["block"], np.int32, offset=4 + 4 * n)])
        owner.append(np.full(n, len(toxic), dtype=np.int32))
        seen.append(place)
        toxic.append(r["toxic"])
    each = [features(w) for w in types]
    of, bucket = np.repeat(np.arange(len(each), dtype=np.int32), [len(f) for f in each]), np.array([b for f in each for b in f], dtype=np.int64)
    buckets, feature = np.unique(bucket, return_inverse=True)
    # documents that hold a feature: pairs of document and feature, each once
    begin = np.searchsorted(of, np.arange(len(each) + 1))
    held = np.zeros((len(buckets), 2))
    for y, place in zip(toxic, seen, strict=True):
        count = begin[place + 1] - begin[place]
        at = np.repeat(begin[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        held[np.unique(feature[at]), y] += 1
    kept = held.sum(axis=1) >= min_docs
    name = np.cumsum(kept) - 1
    pairs = kept[feature]
    lengths = np.concatenate([*sizes, np.zeros(0, np.int32)])
    return Sample(
        np.array(toxic), np.concatenate([*owner, np.zeros(0, np.int32)]), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths),
        np.concatenate([*words, np.zeros(0, np.int32)]), of[pairs], name[feature[pairs]].astype(np.int32), buckets[kept], held[kept],
    )


def fit_noisy_or(s: Sample, prior: float, params: TrainParams) -> Model:
    """Gradient steps (Adam) on the log-likelihood of document labels under the noisy-or of sentences.

    They start from the features' log-odds, shrunk the more the less clearly the classes differ.
    """
    import numpy as np

    n, y = len(s.toxic), s.toxic
    n1, n0 = max(y.sum(), 1), max(n - y.sum(), 1)
    r1, r0 = (s.held[:, 1] + 0.5) / (n1 + 1), (s.held[:, 0] + 0.5) / (n0 + 1)
    both = (s.held.sum(axis=1) + 1) / (n1 + n0 + 2)
    z = (r1 - r0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    odds = np.clip(np.log(r1 / (1 - r1)) - np.log(r0 / (1 - r0)), -4, 4)
    share = y.mean()
    importance = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    x = np.concatenate([0.5 * odds / (1 + np.exp(-2 * (np.abs(z) - 5))), [-3.0, -4.0]])  # weights, bias, leak
    m, v = np.zeros_like(x), np.zeros_like(x)
    types = int(max(s.word.max(initial=0), s.of.max(initial=0))) + 1
    for t in range(1, params.steps + 1):
        weight = np.bincount(s.of, x[s.feature], minlength=types)  # of each word type
        z = np.bincount(s.sentence, weight[s.word], minlength=len(s.owner)) + x[-2]
        p, leak = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-x[-1]))
        q = np.bincount(s.owner, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n) + np.log1p(-leak)
        none = np.exp(q)  # probability that no sentence is toxic
        pull = importance * np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        dz = pull[s.owner] * p
        back = np.bincount(s.word, dz[s.sentence], minlength=types)
        g = np.concatenate([np.bincount(s.feature, back[s.of], minlength=len(s.buckets)), [dz.sum(), (pull * leak).sum()]]) / n
        g[:-2] -= params.ridge * x[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += params.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(1 / (1 + np.exp(-x[-1]))), float(x[-2]), dict(zip(s.buckets.tolist(), x[:-2].tolist(), strict=True)))


def train(docs: DataFrame, labels: DataFrame, params: TrainParams = TrainParams()) -> Model:
    rows = stored(packed_words(training_rows(docs, labels, max_docs=params.max_docs)), "labelled-sample")
    prior = labels.where("toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).agg(F.avg("toxic")).first()[0]
    if rows.agg(F.countDistinct("toxic")).first()[0] < 2:
        return Model(leak=0.5 if prior is None else min(max(prior, 0.0), 1.0))
    return fit_noisy_or(gather(rows, params.min_docs), prior, params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, worst_start, worst_end, n_flagged): code-point span of the worst sentence, if any word counts."""

    def run(batches: Iterator) -> Iterator:
        import math

        import pyarrow as pa

        weights, known = model.weights, {}

        def weight(word: str) -> float:
            if len(known) > 300_000:
                known.clear()
            known[word] = out = sum(weights.get(f, 0.0) for f in features(word))
            return out

        def judge(text: str) -> tuple[float, int | None, int | None, int]:
            low = lower(text)
            words = WORD.findall(low)
            none, worst, start, end, flagged = 1 - model.leak, 0.0, None, None, 0
            if any([known[w] if w in known else weight(w) for w in words]):
                for s in SENTENCE.finditer(low):
                    each = [known[w] if w in known else weight(w) for w in WORD.findall(s[0])]
                    if any(each):
                        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(each)))))
                        none *= 1 - p
                        flagged += p >= 0.5
                        if p > worst:
                            worst, start, end = p, s.start(), s.end()
            return 1 - none, start, end, flagged

        for batch in batches:
            rows = [judge(t.as_py() or "") for t in batch.column(1)]
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "score", "worst_start", "worst_end", "n_flagged"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, worst_start int, worst_end int, n_flagged int")


by_value(__name__)
