import random
import re

import pytest

from orefield.llm import near, words


def sets(rows):
    out = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall("[A-Za-z0-9]+", t or "")]
        if len(w) >= 3:
            out[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return out


def brute(rows, least=0.7):
    s = sets(rows)
    ids = sorted(s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(s[a] & s[b]) >= least * len(s[a] | s[b]) - 1e-9}


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(3, 60))] for _ in range(n)]
    rows = []
    for i in range(n * 4):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        rows.append((i, "-".join(t) if i % 2 else " ".join(t).upper()))
    return rows + [(10_000, None), (10_001, ""), (10_002, "two words"), (10_003, "é ß ü"), (10_004, "a b c"), (10_005, "A, b; C!")]


@pytest.mark.parametrize("leaf", [48, 3])
def test_pairs_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(near, "LEAF", leaf)
    rows = corpus(25, 4)
    df = spark.createDataFrame([(i, t, 0, "k", 1) for i, t in rows], "unit_id bigint, source string, n int, key string, set int")
    got = [tuple(r) for r in near.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_a_group_of_copies_that_is_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(near, "LEAF", 5)
    rows = [(i, "one two three four five six seven eight") for i in range(40)] + [(100 + i, f"one two three four five six seven eight nine{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "unit_id bigint, source string")
    assert {tuple(r) for r in near.near_pairs(df).collect()} == brute(rows)
    classes = {r["unit_id"]: r for r in near.near_classes(df).collect()}
    assert classes[5]["class_id"] == 0 and classes[5]["n_copies"] == 40 and classes[5]["n_links"] == 30


def test_empty(spark):
    df = spark.createDataFrame([], "unit_id bigint, source string")
    assert near.near_pairs(df).count() == 0 and near.near_classes(df).count() == 0


def test_words_are_runs_of_ascii_letters_and_digits():
    import pyarrow as pa

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("aB9 _-é\n") for _ in range(rnd.randint(0, 40))) for _ in range(200)] + [None, "", "x" * 3_000_000, "a" * 9 + " " + "b" * 9]
    hashes, n = words.word_hashes(pa.array(texts))
    want = [[w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")] for t in texts]
    assert list(n) == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    by = {}
    for w, h in zip(flat, hashes, strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    sliced = pa.array(texts).slice(50, 20)
    assert (words.word_hashes(sliced)[0] == hashes[sum(n[:50]) : sum(n[:70])]).all()


def test_rings_alone_find_every_pair_within_the_fingerprint_bound(spark, monkeypatch):
    """One large shard: no pair is lost between the levels, none comes twice, whatever the depth."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near, "LEAF", 4)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([12, 30, 60]))] for _ in range(12)]
    rows = []
    for i in range(220):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([1, 1, 2, 3])):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(t)))
    made = near.prints(spark.createDataFrame(rows, "unit_id bigint, source string"), "unit_id", "source").dropDuplicates(["set"]).cache()
    rs = made.select("set", "n", "print").collect()
    bits = lambda p: sum(int(v & (2**64 - 1)) << (64 * k) for k, v in enumerate(p))
    want = set()
    for x, p in enumerate(rs):
        for q in rs[x + 1 :]:
            if min(p["n"], q["n"]) >= 0.7 * max(p["n"], q["n"]) - 1e-9 and bin(bits(p["print"]) ^ bits(q["print"])).count("1") <= int((p["n"] + q["n"]) * (0.3 / 1.7) + 1e-9):
                want.add((min(p["set"], q["set"]), max(p["set"], q["set"])))
    shard = made.select(F.lit(1).cast("bigint").alias("key"), "set", "n", "print")
    for levels in (1, 2, 5):
        got = [tuple(r) for r in near._vantage_pairs(shard, 0.7, levels).collect()]
        assert len(got) == len(set(got)) and set(got) == want != set()


def test_hot_bands_and_hot_classes_take_other_ways_to_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "LEAF", 5)
    monkeypatch.setattr(near, "SAMPLE", 1)
    rows = corpus(20, 9) + [(20_000 + i, "one two three four five six seven eight") for i in range(30)]
    df = spark.createDataFrame(rows, "unit_id bigint, source string")
    members, links = near.similar_classes(df, hot_classes=4)
    usual = near.similar_classes(df)[1]
    assert {tuple(r) for r in links.collect()} == {tuple(r) for r in usual.collect()}
    got = [tuple(r) for r in near.near_pairs(df, hot_copies=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
