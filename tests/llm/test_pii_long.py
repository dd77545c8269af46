"""Spans in very long texts: runs of digits and dotted names of 100,000 parts."""

from test_operators import make, rows


def test_long_texts(spark):
    from catascope.llm.pii import detect, redact

    n = 100_000
    cases = [
        ("1" * n, []), ("1 " * n + "x", []), ("2-" * n, []), ("7 8  " * 500, []), ("+1" + " 2" * n, []),
        ("x@a" + ".b" * n, [f"email:0:{3 + 2 * n}"]), ("x@a" + ".b-c" * n + "..", [f"email:0:{3 + 4 * n}"]),
        ("ab@c.de 4111 1111 1111 1111", ["email:0:7", "card:8:27"]),
    ]
    docs = make(spark, [t for t, _ in cases])
    got = rows(detect(docs))
    for i, (_, spans) in enumerate(cases):
        assert (got[i]["n_email"], got[i]["n_card"]) == tuple(sum(s.startswith(k) for s in spans) for k in ("email", "card"))
        assert got[i]["n_ip"] == got[i]["n_phone"] == 0 and set(spans) <= set(got[i]["spans"].split(","))
    clean = rows(redact(docs))
    assert clean[5]["text"] == "[EMAIL]" and clean[6]["text"] == "[EMAIL].." and clean[7]["text"] == "[EMAIL] [CARD]"
