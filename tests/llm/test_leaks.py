import random
import re

from orefield.llm import leaks

ITEM = "Which program reads the ledger after the nightly batch and writes every balance to the report file before the morning shift begins again"


def words(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")]


def brute(docs, items, run=12):
    def runs(t):
        w = words(t)
        return {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}

    held = [(i, runs(t)) for i, t in items]
    return {(d, i) for d, t in docs for r_d in [runs(t)] for i, r in held if r_d & r}


def make():
    rnd = random.Random(6)
    v = ITEM.lower().split() + [f"x{i}" for i in range(30)]
    items = [(1, ITEM), (2, ITEM), (3, "too short"), (4, None), (5, ""), (6, " ".join(rnd.choice(v) for _ in range(40)))]
    docs = [(10, f"Intro. {ITEM.upper().replace(' ', ' -- ')}! end"), (11, " ".join(ITEM.split()[:11])), (12, "é".join(ITEM.split()[5:17])), (13, None), (14, ""), (15, " ".join(ITEM.split()[3:10] + ["other"] + ITEM.split()[10:16])), (16, "a " * 50_000 + ITEM), (17, ITEM), (17, ITEM)]
    six = items[-1][1].split()
    docs += [(20 + k, " ".join([rnd.choice(v) for _ in range(9)] + six[k : k + 10 + k % 5] + [rnd.choice(v) for _ in range(9)])) for k in range(25)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 1, "w") for d, t in docs], "doc_id bigint, text string, item_id int, w string"), spark.createDataFrame([(i, t, "s") for i, t in items], "item_id bigint, text string, doc_id string")


def test_equal_brute_force_by_broadcast_and_by_shuffle(spark):
    docs, items = make()
    d, i = frames(spark, docs, items)
    for kw in ({}, {"broadcast_windows": 0}, {"radius": 0}, {"radius": 3}):
        got = [(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i, **kw).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items), kw


def test_radius_finds_all_near_fingerprints():
    import numpy as np

    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 200).astype(np.uint64)
    asked = items.copy()
    for k in range(200):
        for bit in rng.choice(64, k % 4, replace=False):
            asked[k] ^= np.uint64(1) << np.uint64(bit)
    for radius in (0, 1, 2, 3):
        a, b = leaks._Index(items, radius).near(asked, radius)
        want = {(x, y) for x in range(200) for y in range(200) if bin(int(asked[x] ^ items[y])).count("1") <= radius}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_empty(spark):
    docs, items = make()
    d, i = frames(spark, docs, items)
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0 and leaks.leaks(d, i.limit(0), broadcast_windows=-1).count() == 0


def test_near_copies_of_whole_items_stand_without_a_common_passage_only_if_asked(spark):
    rnd = random.Random(2)
    item = [f"v{rnd.randrange(900)}" for _ in range(48)]
    other = item[:3] + ["changed"] + item[4:]  # one word, near an end
    d, i = frames(spark, [(1, " ".join(other)), (2, " ".join(item)), (3, " ".join(item[::2]))], [(1, " ".join(item))])
    for kw in ({}, {"broadcast_windows": 0}):
        rows = {(r["doc_id"], r["size"]): r for r in leaks.hits(d, i, radius=12, **kw).collect()}
        assert rows[1, 48]["similar"] == 1 and rows[2, 48]["held"] and (3, 48) not in rows
        assert {r["doc_id"] for r in leaks.leaks(d, i, exact=False, radius=12, **kw).collect()} == {1, 2}
    got = {r["size"]: r for r in leaks.stages(d, i).collect()}
    assert set(got) == {12, 24, 48} and got[12]["pairs_held"] == 2 and got[48]["pairs_held"] >= 1


def test_ids_of_any_type_and_windows_of_items(spark):
    import numpy as np

    d = spark.createDataFrame([("d", ITEM)], "doc_id string, text string")
    i = spark.createDataFrame([("i", ITEM), (None, ITEM)], "item_id string, text string")
    for kw in ({}, {"broadcast_windows": 0}):
        assert sorted(((r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i, **kw).collect()), key=str) == [("d", "i"), ("d", None)]
    row, first = leaks.item_windows(np.array([30, 10, 25]), 24, 12)
    assert list(zip(row, first)) == [(0, 0), (0, 6), (2, 40), (2, 41)]
