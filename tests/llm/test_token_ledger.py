"""The ledger's commits: compaction, racing writers, and the registered query against exact counts."""

import collections

import pyarrow.parquet as pq
from test_operators import make


def totals(ledger):
    return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}


def test_compaction_and_races(spark, tmp_path):
    from catascope.llm import token_counts as T

    docs = make(spark, [f"t{i}" for i in range(20)])
    rows = docs.selectExpr("doc_id", "source", "lang", "'v' AS tokenizer_version", "doc_id AS n_tokens")
    ledger = T.TokenLedger(spark, str(tmp_path / "l"))
    assert not ledger.compact()
    assert ledger.commit("1", T.inserted(rows)) and ledger.commit("2", T.deleted(rows.where("doc_id < 10")))
    before = totals(ledger)
    assert before == {("s", "en"): (10, sum(range(10, 20)))}
    assert ledger.compact() and totals(ledger) == before and ledger.compact() and totals(ledger) == before
    assert not ledger.commit("1", T.inserted(rows))  # folded batches stay committed
    assert ledger.commit("3", T.inserted(rows.where("doc_id = 3"))) and totals(ledger) == {("s", "en"): (11, 3 + sum(range(10, 20)))}
    # a writer that lost the race leaves a folder that counts for nothing
    lost = ledger._write(T.inserted(rows))
    assert not ledger._mark("batch-3", lost, []) and totals(ledger) == {("s", "en"): (11, 3 + sum(range(10, 20)))}
    assert ledger.commit("4", T.deleted(rows.where("doc_id = 3 or doc_id >= 10"))) and totals(ledger) == {}


def test_query(spark, sf_dir):
    from tokenizers import Tokenizer

    from catascope.llm.op01 import op1_token_counts
    from catascope.llm.tokens import default_path

    tok, want = Tokenizer.from_file(default_path()), collections.defaultdict(lambda: [0, 0])
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    for source, lang, text in zip(t["source"], t["lang"], t["text"], strict=True):
        want[source, lang][0] += 1
        want[source, lang][1] += len(tok.encode(text or "", add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in op1_token_counts(spark, sf_dir).collect()}
    assert got == dict(want)
