"""Each operator against a brute-force version on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string, label string, h string"
WORDS = "the of and to red blue gear ring anvil bolt stupid idiot café señor über".split()


def make(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "x", "y", "z", "h") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    out = [prose(rng.randint(1, 120)) + "\n" + prose(rng.randint(5, 60)) for _ in range(60)]
    out += out[:8] + [t.replace("red", "tan", 1) for t in out[:6]]
    out += [None, "", " \n\t ", "one", "a\nb\na\n\na", "word " * 400, "The The The The " * 30, "| ".join(["home"] * 60), "é" * 300, out[0] + out[1]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_counts(spark, docs, empty, texts, tmp_path):
    from catascope.llm import token_counts as T
    from catascope.llm.tokens import default_path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path())
    exact = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    counted = T.count_tokens(docs, default_path(), "v").cache()
    assert {k: r["n_tokens"] for k, r in rows(counted).items()} == exact
    ledger = T.TokenLedger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("1", T.inserted(counted))
    assert not ledger.commit("1", T.inserted(counted))
    assert ledger.commit("2", T.deleted(counted.where("doc_id % 2 = 0")))
    assert ledger.commit("3", T.inserted(T.count_tokens(empty, default_path(), "v")))
    moved = counted.where("doc_id = 1").withColumns({"old_source": F.lit("s"), "source": F.lit("new"), "new": F.lit(7)})
    assert ledger.commit("4", T.revised(moved, "n_tokens", "new", old_source="old_source"))
    got = {r["source"]: (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    odd = [i for i in exact if i % 2 and i != 1]
    assert got == {"s": (len(odd), sum(exact[i] for i in odd)), "new": (1, 7)}


def test_encoder_is_exact():
    from catascope.llm.tokens import WordEncoder, default_path
    from tokenizers import Tokenizer

    tok, ours, rng = Tokenizer.from_file(default_path()), WordEncoder(default_path()), random.Random(1)
    odd = ["<|endoftext|> a", "İstanbul ŒUVRE 12a34", "a\x85b\xa0c\x1cd", "日本 🙂", "It's 'S 'LL", ""]
    odd += ["".join(chr(rng.randrange(0x250)) for _ in range(40)) for _ in range(300)]
    for t in odd:
        assert ours.ids(t) == b"".join(i.to_bytes(4, "little") for i in tok.encode(t, add_special_tokens=False).ids)


def brute_removed(pairs, span=50):
    seen = {}
    for d, t in pairs:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            seen[b[i : i + span]] = min(seen.get(b[i : i + span], d), d)
    out = {}
    for d, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        left = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("group_bytes", [1000, 1 << 20])
def test_suffix_dedup(docs, texts, empty, group_bytes):
    from catascope.llm.suffix_dedup import dedup_report

    got = rows(dedup_report(docs, group_bytes=group_bytes))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == brute_removed(list(enumerate(texts)))
    assert dedup_report(empty).count() == 0


def test_suffix_order():
    import numpy as np
    from catascope.llm.suffix_dedup import suffix_order

    rng = random.Random(2)
    for _ in range(60):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 300)))
        rank = suffix_order(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 10**6)
        assert [int(i) for i in np.argsort(rank)] == sorted(range(len(t)), key=lambda i: t[i:])


def fingerprint(t, width):
    import xxhash

    w = words_of(lower(t))
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=3):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def test_simhash(docs, texts, empty):
    from catascope.llm.simhash import keep_one, near_duplicates

    prints = {i: fingerprint(t, 3) for i, t in enumerate(texts)}
    got = rows(near_duplicates(docs))
    assert {k: r["fp"] % (1 << 64) for k, r in got.items()} == prints
    assert {k: r["component_id"] for k, r in got.items()} == components(prints)
    kept = keep_one(docs, width=3)
    assert kept.columns == docs.columns
    assert sorted(rows(kept)) == sorted(set(components(prints).values()))
    assert near_duplicates(empty).count() == keep_one(empty).count() == 0


@pytest.mark.parametrize("cap", [2, 64])
def test_crowded_buckets(spark, cap):
    from catascope.llm.components import components as labelled
    from catascope.llm.simhash import links

    rng = random.Random(5)
    prints = set()
    for base in (rng.getrandbits(64) for _ in range(4)):
        for _ in range(40):
            x = base
            for k in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                x ^= 1 << k
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {r["node"]: r["label"] for r in labelled(links(df, cap=cap)).collect()}
    groups = collections.defaultdict(list)
    for x, c in components({x: x for x in prints}).items():
        groups[c].append(signed(x))
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_packing(spark, docs, texts, empty):
    from catascope.llm.packing import best_fit_plan, pack
    from catascope.llm.tokens import default_path
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(default_path()), {}
    for i, t in enumerate(texts):
        ids = b"".join(x.to_bytes(4, "little") for x in [*tok.encode(t or "", add_special_tokens=False).ids, 0])
        for k, at in enumerate(range(0, len(ids), 400)):
            want[i, k] = (at // 4, len(ids[at : at + 400]) // 4, zlib.crc32(ids[at : at + 400]))
    got = pack(docs, capacity=100).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 100
    plain: list[int] = []  # best-fit decreasing, a document at a time
    for n in sorted((v[1] for v in want.values()), reverse=True):
        fits = [k for k, room in enumerate(plain) if room >= n]
        if fits:
            plain[min(fits, key=lambda k: plain[k])] -= n
        else:
            plain.append(100 - n)
    assert len(bins) == len(plain)
    assert pack(empty).count() == 0 and best_fit_plan({}) == []
    twice = pack(docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3")), capacity=100).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)


def test_toxicity(spark):
    from catascope.llm.toxicity import Model, score, train

    rng = random.Random(4)
    mild = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma".split()
    bad = ["vilewort", "grimslur", "vilewords"]
    texts, labels = [], []
    for i in range(600):
        s = [" ".join(rng.choice(mild) for _ in range(8)) for _ in range(4)]
        toxic = int(i % 4 == 0)
        if toxic:
            s[rng.randrange(4)] += " " + rng.choice(bad)
        texts.append(". ".join(s) + ".")
        labels.append((i, toxic))
    docs = make(spark, [*texts, None, ""])
    model = train(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = rows(score(docs, model))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]["score"] >= 0.5) == bool(labels[i][1]) for i in held) >= 0.97 * len(held)
    hit = next(i for i, y in labels if y)
    assert any(b in texts[hit][got[hit]["worst_start"] : got[hit]["worst_end"]] for b in bad)
    assert got[600]["score"] == got[601]["score"] < 0.5 and got[600]["worst_start"] is None
    assert train(docs, spark.createDataFrame([], "doc_id long, toxic int")) == Model()
    assert score(docs.where("false"), model).count() == 0


def test_quality(docs, texts, empty):
    from catascope.llm.quality import clean_documents, quality_report

    got = rows(quality_report(docs))
    for i, t in enumerate(texts):
        w, seen, dup = words_of(t), set(), 0
        for line in (t or "").split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = clean_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(rows(kept)) == sorted(i for i, r in got.items() if r["kept"])
    assert quality_report(empty).count() == clean_documents(empty).count() == 0


def test_quality_lines(spark):
    from catascope.llm.quality import clean_documents, quality_report

    good = "This is a line of plain prose that says something and ends well. Another sentence follows it with other words, and a third one closes the paragraph."
    nav = "Home | About | Contact | Shop | News | Help | Blog | Jobs"
    text = f"{good}\n{nav}\nLicensed under the Apache License, Version 2.0."
    docs = make(spark, [text, "\n".join([nav] * 6)])
    kept = rows(clean_documents(docs))
    assert list(kept) == [0] and kept[0]["text"] == good and kept[0]["n_chars"] == len(good)
    assert rows(quality_report(docs))[0]["kept"]


def test_decontamination(spark, docs, texts, empty):
    from catascope.llm.decontaminate import decontaminate, drop_contaminated

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = {1: texts[3], 2: "RED ring, anvil!", 3: " ".join(split(texts[5])[4:30]), 4: None, 5: "", 6: "café", 7: texts[3], 8: "never seen words here"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    windows = collections.defaultdict(set)
    for k, t in items.items():
        w = split(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(k)
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    for limit in (500_000, 20):  # one block and several
        got = rows(decontaminate(docs, bench, block_rows=limit))
        assert {k: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for k, r in got.items()} == want
    assert sorted(rows(drop_contaminated(docs, bench))) == [d for d, x in want.items() if not x[4]]
    assert decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(docs, bench.where("false")).collect())


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_pii(spark, empty):
    from catascope.llm.pii import detect, redact

    rng = random.Random(7)
    odd = ["".join(rng.choice(al) for _ in range(rng.randint(0, 90))) for al in ("a1@. -b2%+", "0123456789 .-+()", "12.5 3é😀@ab.c+-") for _ in range(150)]
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    odd += [None, "1.2.3.4.5.6.7.8", "x@y.z%w@q.r", *[f"and password={hexed()} end" for _ in range(60)], f"😀 a@b.co 4111 1111 1111 1111 and password={hexed()} end"]
    docs = make(spark, odd)
    got = rows(detect(docs))
    for i, t in enumerate(odd):
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m[0]))
        names = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in found]
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[1] == k for x in found) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r["spans"].split(",")) | {""}
    assert "secret:" in got[len(odd) - 1]["spans"]
    clean = rows(redact(docs))
    assert clean[len(odd) - 1]["text"] == "😀 [EMAIL] [CARD] and password=[SECRET] end" and clean[450]["text"] is None
    assert redact(docs).columns == docs.columns and detect(empty).count() == redact(empty).count() == 0


def test_sharding(docs, texts, empty):
    from catascope.llm.sharding import shard

    got = shard(docs, 4).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    assert shard(empty, 4).count() == 0
    again = shard(docs.where("doc_id < 5").unionByName(docs.where("doc_id < 5")), 4).collect()
    assert len({(r["shard"], r["slot"]) for r in again}) == 10


def test_null_ids(spark):
    from catascope.llm import decontaminate, packing, pii, quality, sharding, simhash, suffix_dedup

    docs = make(spark, ["same text here and there", "same text here and there", None], [None, 1, None])
    bench = spark.createDataFrame([(1, "text here")], "item_id long, text string")
    assert simhash.near_duplicates(docs).count() == packing.pack(docs).count() == sharding.shard(docs, 2).count() == 3
    assert suffix_dedup.dedup_report(docs).count() == quality.quality_report(docs).count() == pii.detect(docs).count() == 3
    assert sorted(r["n_hit"] for r in decontaminate.decontaminate(docs, bench).collect()) == [0, 2, 2]
