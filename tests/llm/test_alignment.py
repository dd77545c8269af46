"""Tokenizer alignment against a plain two-pointer version with the tokenizers themselves."""

import collections
import hashlib

import numpy as np
import pytest

from catascope.llm import alignment as L

ODD = [
    None, "", " ", "  ", "\n", "\n\n a", "a  b", "a▁b", "café 中文 \U0001f600 x", "<|endoftext|> <s> </s> hi", "\t\ttab \r\n x", "x\x00y", "ﬁ Å ñ",
    "  lead", "trail  ", "a\n b\n\n  c", "<0x41>", "<unk>", "\x85  z", "don't I'LL 123 4567 ²½ !!!", " \n \n ", "a" * 3000, "word " * 3000, "word " * 3000,
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = L.default_paths()
    a_tok, b_tok = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_tok.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    docs = []
    for t in texts:
        want = (" " + (t or "")).encode()
        a, b = a_tok.encode(" " + (t or ""), add_special_tokens=False).ids, b_tok.encode(t or "")
        bytes_a = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append(None)
            continue
        ends = dict(zip(np.cumsum([len(x) for x in bytes_b]).tolist(), range(len(b)), strict=True))
        links = [(i, ends[e]) for i, e in enumerate(np.cumsum([len(x) for x in bytes_a]).tolist()) if e in ends]
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        docs.append((len(a), len(b), [(a[i], b[j]) for i, j in links], ";".join(groups)))
    count, most = collections.Counter(p for d in docs if d for p in d[2]), collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    one = lambda d: (d[0], d[1], len(d[2]), len(d[2]), sum(count[p] == most[p[1]] for p in d[2]), sum(count[p] for p in d[2]), hashlib.sha256(d[3].encode()).hexdigest())
    return [zero if d is None else one(d) for d in docs]


@pytest.mark.parametrize(("block", "lane"), [(4 << 20, 512), (2000, 5)])
def test_documents_and_odd_texts(spark, sf_dir, monkeypatch, block, lane):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "LANE", lane)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(120).collect()] + ODD
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, block int, n_a int")
    got = {r["doc_id"]: tuple(r)[1:] for r in L.alignment_report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_rows_null_ids_and_no_rows(spark):
    schema = "doc_id long, text string"
    rows = L.alignment_report(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], schema), groups=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in rows) == [(0, 2), (1, 2), (1, 2), (2, 0)]
    assert len({r["groups"] for r in rows if r["n_links"]}) == 1
    assert L.alignment_report(spark.createDataFrame([], schema)).count() == 0


def test_lanes_change_nothing(monkeypatch):
    r = np.random.default_rng(3)
    end_a, end_b = (np.unique(np.append(r.choice(4000, 1500, replace=False), [1000, 3999])) for _ in range(2))
    last = [np.searchsorted(e, [1000, 3999]) for e in (end_a, end_b)]
    want = np.intersect1d(end_a, end_b)
    for lane in (3, 70, 100_000):
        monkeypatch.setattr(L, "LANE", lane)
        a, b = L.lockstep(end_a, end_b, *last)
        assert (end_a[a] == want).all() and (end_b[b] == want).all()
