"""Scores do not hang on one letter's lower case; a batch whose writer ended early can be committed again."""

import pytest
from test_operators import make

from catascope.llm import token_counts as T
from catascope.llm import toxicity as X


def test_a_letter_whose_lower_case_is_longer(spark):
    model = X.Model(weights={f: 3.0 for f in X.features("vile")}, bias=-2.0, leak=0.01)
    texts = ["You are VILE. Fine day.", "İ You are VILE. Fine day.", "ẞß You are VILE. Fine day.", "Fine day. " + "x" * 100_000 + " İ VILE"]
    rows = {r["doc_id"]: r for r in X.score(make(spark, texts), model).collect()}
    scores = [rows[i]["score"] for i in sorted(rows)]
    assert scores[0] == scores[1] == scores[2] and min(scores) > 0.5
    for i, text in zip(sorted(rows), texts, strict=True):
        assert "VILE" in text[rows[i]["worst_start"] : rows[i]["worst_end"]]


def test_writer_that_ends_before_the_marker_has_its_name(spark, tmp_path, monkeypatch):
    rows = make(spark, ["a", "b"]).selectExpr("doc_id", "source", "lang", "'v' AS tokenizer_version", "1L AS n_tokens")
    ledger = T.TokenLedger(spark, str(tmp_path / "l"))
    with monkeypatch.context() as m:
        m.setattr(T.json, "dumps", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            ledger.commit("1", T.inserted(rows))
    assert ledger.totals().count() == 0
    assert ledger.commit("1", T.inserted(rows)) and not ledger.commit("1", T.inserted(rows))
    assert ledger.totals().first()["n_docs"] == 2


def test_other_errors_are_raised(spark, tmp_path):
    rows = make(spark, ["a"]).selectExpr("doc_id", "source", "lang", "'v' AS tokenizer_version", "1L AS n_tokens")
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "commits").write_text("a file where the folder should be")
    with pytest.raises(Exception):
        T.TokenLedger(spark, str(tmp_path / "l")).commit("1", T.inserted(rows))
