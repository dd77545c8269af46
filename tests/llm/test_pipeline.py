"""The pipeline on the smallest tables: what every stage keeps and writes against a brute-force version or SQL."""

import collections

import duckdb
from test_near_copies import kept


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def sql(name, docs, sf_dir, folder):
    """Rows of an operator's SQL over ``docs``, by doc_id."""
    from catascope import llm

    path = f"{folder}/{name}"
    docs.write.parquet(path)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/*.parquet'")
    c.sql(f"create view benchmark as select * from '{sf_dir}/benchmark.parquet'")
    r = c.sql(llm.oracle_sql()[name])
    return [dict(zip(r.columns, row, strict=True)) for row in r.fetchall()]


def check_quality(docs, out, sf_dir, folder):
    want = sorted(r["doc_id"] for r in sql("op6_quality_rules", docs, sf_dir, folder) if r["kept"])
    assert sorted(r["doc_id"] for r in out.collect()) == want and len(want) < docs.count()
    before = {r["doc_id"]: collections.Counter(r["text"].split("\n")) for r in docs.where("text is not null").collect()}
    for r in out.collect():
        assert collections.Counter(r["text"].split("\n")) <= before[r["doc_id"]] and r["n_chars"] == len(r["text"])


def check_near_dedup(docs, out, sf_dir, folder):
    rows = pairs(docs)
    assert pairs(out) == sorted((rows[i] for i in kept(rows)), key=repr)


def check_decontamination(docs, out, sf_dir, folder):
    want = sorted(r["doc_id"] for r in sql("op8_decontamination", docs, sf_dir, folder) if not r["contaminated"])
    assert sorted(r["doc_id"] for r in out.collect()) == want and len(want) < docs.count()


def check_pii(docs, out, sf_dir, folder):
    from catascope.llm.pii import detect

    spans, before, after = ({r["doc_id"]: r[c] for r in df.collect()} for df, c in ((detect(docs), "spans"), (docs, "text"), (out, "text")))
    assert before.keys() == after.keys() and any(spans.values())
    for k, text in before.items():
        pos, line = 0, []
        for kind, a, b in (s.split(":") for s in (spans[k] or "").split(",") if s):
            if int(a) >= pos:
                line += [text[pos : int(a)], f"[{kind.upper()}]"]
            pos = max(pos, int(b))
        assert after[k] == "".join(line) + text[pos:]


def check_packing(docs, out, sf_dir, folder):
    from tokenizers import Tokenizer

    from catascope.llm.tokens import default_path

    tok, held, full = Tokenizer.from_file(default_path()), collections.Counter(), collections.defaultdict(list)
    for r in out.collect():
        held[r["doc_id"]] += r["length"]
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    assert held == {r["doc_id"]: 1 + len(tok.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    for slots in full.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(slots[-1]) <= 2048


def test_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        out = P.stored(stage(spark, docs, sf_dir), name)
        assert name == "packing" or out.columns == columns
        globals()[f"check_{name}"](docs, out, sf_dir, str(tmp_path))
        docs = out
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


def test_awkward_rows(spark, sf_dir):
    """Nulls in every column, repeated rows, empty and long texts, an empty table, in every stage."""
    import corpus_pipeline as P

    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    good = "\n".join(f"Sentence number {i} says that thing{i} goes with place{i * 7}." for i in range(12))
    long = "\n".join(f"Line {i} of the long text tells name{i} about item{i * 3} and nothing else." for i in range(20_000))
    rows = [(1, good), (1, good), (2, good), (None, good), (None, None), (3, None), (4, ""), (5, long), (5, long), (6, "x " * 30)]
    docs = spark.createDataFrame([tuple({"doc_id": i, "text": t}.get(f.name) for f in schema) for i, t in rows], schema)
    for name, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        docs = P.stored(stage(spark, docs, sf_dir), name)
    assert {r["doc_id"] for r in docs.collect()} == {1, 5}


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
