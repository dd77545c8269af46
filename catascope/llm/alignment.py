"""Alignment of two tokenizers on the same texts by lockstep merging.

A is a byte-level BPE, B a piece BPE with byte fallback. Both encode texts exactly, word by word with a bounded cache:
words of A are those of its own pre-tokenizer, and no piece of B goes on after a later space or line end. Texts with
characters whose class this module does not know go through A's tokenizer whole.

A task encodes ``BLOCK`` bytes of text at a time. The ends of all tokens, in bytes, are two arrays, and every document is
cut into lanes of some hundred tokens at ends that A and B share. One state vector then holds the two pointers of all
lanes: each step compares their ends, emits a link and a cut where they agree, advances the pointer that is behind (or
both) and compacts finished lanes away.

Counts of id pairs are corpus-wide. Each block is written once with its distinct pairs and its links as numbers of those;
blocks' counts are summed by pair and compared by B id, joined back to the pairs of each block, and added up per document.
What is shuffled are the distinct pairs of blocks, never links.

Null and empty texts, and texts that the tokens do not spell out (B reads U+2581 as a space), have no tokens. Repeated rows
are rows of their own; other columns are ignored; a long text is a block of its own, in many lanes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import by_value, stored

BLOCK = 2 << 20
LANE = 512
CACHE = 600_000
#: The byte-level tokenizer's word pattern (fixed by its file); l, n and s stand for letters, numbers and spaces.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
#: Characters outside of which classes of letters, numbers and spaces may differ between Unicode versions.
KNOWN = "\t-\r\x20-\x7e\xa1-ɏЀ-џ‐-‧‰-›€ぁ-ゖァ-ヺ一-龥가-힣"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def known_classes() -> dict[str, str]:
    """Letters, numbers and spaces among KNOWN, as the insides of character classes."""
    import re
    import unicodedata

    inside, ranges = re.compile(f"[{KNOWN}]"), {"l": [], "n": []}
    for code in range(1 << 16):
        kind = unicodedata.category(chr(code))[0].lower()
        if kind in ranges and inside.match(chr(code)):
            of = ranges[kind]
            if of and of[-1][1] == code - 1:
                of[-1][1] = code
            else:
                of.append([code, code])
    return {k: "".join(f"{chr(a)}-{chr(b)}" for a, b in of) for k, of in ranges.items()} | {"s": "\t-\r\x20"}


class Words:
    """Ids of words, encoded once each and kept in flat arrays; emptied when ``CACHE`` words are held."""

    def __init__(self, encode):
        self.encode = encode  # list of words -> list of id lists
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.known, self.first, self.size, self.flat = {}, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids(self, words: list[str]):
        """(ids of all words in one array, number of ids per word)."""
        import numpy as np

        if len(self.known) > CACHE:
            self.clear()
        new = list(set(words) - self.known.keys())
        if new:
            lists = self.encode(new)
            self.known.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))])
            self.size = np.concatenate([self.size, sizes])
            self.first = np.concatenate([[0], np.cumsum(self.size)])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        begin = np.cumsum(size) - size
        return self.flat[np.repeat(self.first[at] - begin, size) + np.arange(int(size.sum()))], size


class Encoders:
    """Both tokenizers over lists of texts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.pattern, self.other = re.compile(WORDS.format(**known_classes())), re.compile(f"[^{KNOWN}]")
        self.chunks = re.compile(r"(?: +|\n+)[^ \n]*")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        n = self.a.get_vocab_size()
        self.length_a = np.array([len(self.a.id_to_token(i) or "") for i in range(n)], np.int64)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.space = self.b.piece_to_id("▁")
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.words_a, self.words_b = Words(self._words_a), Words(self._words_b)

    def _words_a(self, words: list[str]) -> list[list[int]]:
        tokenize, letters = self.a.model.tokenize, self.letters
        return [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]

    def _words_b(self, words: list[str]) -> list[list[int]]:
        # B puts a space before what it encodes: it is the word's own first one, or the first id goes
        lists = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        out = []
        for w, ids in zip(words, lists, strict=True):
            ids = [self.space] if w == " " else ids if w[0] == " " else ids[1:]
            out.append(ids if b"".join([self.bytes_b[i] for i in ids]) == w.encode() else [-1])  # it does not spell the word
        return out

    def encode(self, texts: list[str]):
        """(ids A, number per text, ids B, number per text); no tokens for texts that they do not spell out."""
        import numpy as np

        texts = [" " + t if t and "▁" not in t else "" for t in texts]
        words, per = [], np.zeros(len(texts), np.int64)
        whole: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            if t and self.other.search(t):
                whole[k] = self.a.encode(t, add_special_tokens=False).ids
                if self.length_a[whole[k]].sum() != len(t.encode()):
                    whole[k], texts[k] = [], ""
            else:
                found = self.pattern.findall(t)
                per[k] = len(found)
                words += found
        ids_a, n_a = self._per_text(self.words_a, words, per)
        if whole:
            parts = np.split(ids_a, np.cumsum(n_a)[:-1])
            for k, ids in whole.items():
                parts[k], n_a[k] = np.array(ids, np.int32), len(ids)
            ids_a = np.concatenate(parts)
        words, per = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            found = self.chunks.findall(t)
            per[k] = len(found)
            words += found
        ids_b, n_b = self._per_text(self.words_b, words, per)
        text_b = np.repeat(np.arange(len(texts)), n_b)
        bad = np.zeros(len(texts), bool)
        bad[text_b[ids_b < 0]] = True
        if bad.any():
            ids_a, ids_b = ids_a[~np.repeat(bad, n_a)], ids_b[~bad[text_b]]
            n_a[bad] = n_b[bad] = 0
        return ids_a, n_a, ids_b, n_b

    @staticmethod
    def _per_text(cache: Words, words: list[str], per):
        import numpy as np

        ids, size = cache.ids(words)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per)])])


def lanes(end_a, end_b, last_a, last_b):
    """First and last token of every lane on both sides: documents, cut again where A and B share an end.

    ``last_a`` and ``last_b``: the last tokens of the documents. About every ``LANE`` tokens of A, the first shared end is
    looked for in the next 64; without one, the lane goes on.
    """
    import numpy as np

    tries = np.arange(LANE, len(end_a), LANE)
    window = tries[:, None] + np.arange(64)
    window = np.minimum(window, len(end_a) - 1)
    at = np.searchsorted(end_b, end_a[window])
    same = (at < len(end_b)) & (end_b[np.minimum(at, len(end_b) - 1)] == end_a[window])
    hit = same.any(1)
    pick = np.argmax(same, 1)[hit]
    cut_a = np.union1d(window[hit, pick], last_a)
    cut_b = np.union1d(at[hit, pick], last_b)
    return np.append(0, cut_a[:-1] + 1), cut_a, np.append(0, cut_b[:-1] + 1), cut_b


def lockstep(end_a, end_b, last_a, last_b):
    """(A tokens, B tokens) that end together, by place: one state vector over all lanes advances both pointers."""
    import numpy as np

    if not len(end_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, stop, b, _ = lanes(end_a, end_b, last_a, last_b)
    links_a, links_b = [], []
    while len(a):
        x, y = end_a[a], end_b[b]
        link = x == y
        links_a.append(a[link])
        links_b.append(b[link])
        done = link & (a == stop)
        a = a + (x <= y)
        b = b + (y <= x)
        if done.any():
            going = ~done
            a, b, stop = a[going], b[going], stop[going]
    at = np.concatenate(links_a)
    order = np.argsort(at, kind="stable")
    return at[order], np.concatenate(links_b)[order]


def _group_texts(ids_a, n_a, ids_b, n_b, link_a, link_b, tables) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` per document."""
    import numpy as np

    out = np.zeros(len(ids_a) + len(ids_b), np.int64)
    group_a, group_b = np.searchsorted(link_a, np.arange(len(ids_a))), np.searchsorted(link_b, np.arange(len(ids_b)))
    before_b = np.append(0, link_b + 1)[group_a]  # B tokens of the groups before
    through_a = (link_a + 1)[group_b]  # A tokens up to and with the group
    ends_a, ends_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    ends_a[link_a], ends_b[link_b] = True, True
    out[np.arange(len(ids_a)) + before_b] = ids_a * 3 + ends_a
    out[np.arange(len(ids_b)) + through_a] = ids_b * 3 + 2 * ends_b
    texts = list(map(tables.__getitem__, out.tolist()))
    stops = np.cumsum(n_a + n_b).tolist()
    return ["".join(texts[i:j])[:-1] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


def align(docs: DataFrame, paths: tuple[str, str] | None = None, text: str = "text", key: str = "doc_id", groups: bool = False) -> DataFrame:
    """Blocks of documents: (block, pair_a, pair_b, pair_n, docs, links).

    ``docs`` holds, per document, its key, the numbers of its tokens, groups and links, the digest of its groups (with
    ``groups`` their text too); ``links`` the numbers of the pairs of all links, as bytes of 2 or 4 each.
    """
    import hashlib

    path_a, path_b = paths or default_paths()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoders = Encoders(path_a, path_b)
        ids = max(len(encoders.length_a), len(encoders.length_b))
        tables = [f"{i}{s}" for i in range(ids) for s in ",|;"]
        block = TaskContext.get().partitionId() << 32

        def one(keys, texts):
            ids_a, n_a, ids_b, n_b = encoders.encode(texts)
            end_a, end_b = np.cumsum(encoders.length_a[ids_a]), np.cumsum(encoders.length_b[ids_b])
            last = [np.cumsum(n)[n > 0] - 1 for n in (n_a, n_b)]
            link_a, link_b = lockstep(end_a, end_b, *last)
            n_links = np.diff(np.searchsorted(link_a, np.append(0, np.cumsum(n_a))))
            lines = _group_texts(ids_a, n_a, ids_b, n_b, link_a, link_b, tables)
            digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines]
            pairs, number, count = np.unique(ids_a[link_a].astype(np.int64) << 32 | ids_b[link_b], return_inverse=True, return_counts=True)
            numbers = number.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32).tobytes()
            fields = {"key": keys, "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_links": pa.array(n_links), "groups_sha256": pa.array(digest, pa.string())}
            if groups:
                fields["groups"] = pa.array(lines, pa.string())
            rows = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
            as_list = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), as_list(pa.array((pairs >> 32).astype(np.int32))), as_list(pa.array((pairs & 0xFFFFFFFF).astype(np.int32))), as_list(pa.array(count)), as_list(rows), pa.array([numbers], pa.binary())],
                names=["block", "pair_a", "pair_b", "pair_n", "docs", "links"],
            )

        keys, texts, size = [], [], 0
        for batch in batches:
            first = 0
            for k, t in enumerate(batch.column(1).to_pylist()):
                texts.append(t or "")
                size += len(texts[-1])
                if size >= BLOCK:
                    keys.append(batch.column(0)[first : k + 1])
                    yield one(pa.concat_arrays(keys), texts)
                    block, first, keys, texts, size = block + 1, k + 1, [], [], 0
            keys.append(batch.column(0)[first:])
        if texts:
            yield one(pa.concat_arrays(keys), texts)

    entry = f"key:{kind},n_a:long,n_b:long,n_links:long,groups_sha256:string" + (",groups:string" if groups else "")
    schema = f"block long, pair_a array<int>, pair_b array<int>, pair_n array<long>, docs array<struct<{entry}>>, links binary"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): links of every pair of ids in the whole corpus, and whether no pair of its B id has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    counts = stored(pairs.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_n").alias("n")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, paths: tuple[str, str] | None = None, key: str = "doc_id", groups: bool = False) -> DataFrame:
    """Per document: tokens, groups, links, how many links are the best of their B id, the sum of their counts, a digest."""
    blocks = stored(align(docs, paths, key=key, groups=groups), "alignment")
    counts = pair_counts(blocks)
    own = blocks.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("at", "p")).select("block", "at", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    known = own.join(counts, ["a", "b"]).select(F.col("block").alias("of"), "at", "n", "best")
    kind = docs.schema[key].dataType.simpleString()

    def add(left, right):
        import numpy as np
        import pyarrow as pa

        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["at"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        numbers = np.frombuffer(left["links"][0].as_py(), np.uint16 if len(n) <= 1 << 16 else np.uint32)
        rows = left["docs"].combine_chunks().flatten()
        field = lambda name: rows.field(rows.type.get_field_index(name))
        links = field("n_links").to_numpy()
        stops = np.cumsum(links)
        total = lambda values: np.diff(np.append(0, np.cumsum(values[numbers]))[np.append(0, stops)])
        out = {"key": field("key"), "n_a": field("n_a"), "n_b": field("n_b"), "n_groups": field("n_links"), "n_links": field("n_links"), "n_best": pa.array(total(best)), "count_sum": pa.array(total(n)), "groups_sha256": field("groups_sha256")}
        if groups:
            out["groups"] = field("groups")
        return pa.table(out)

    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if groups else "")
    left = blocks.select("block", "docs", "links").groupBy("block")
    return left.cogroup(known.groupBy("of")).applyInArrow(add, schema).withColumnRenamed("key", key)


by_value(__name__)
