import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veritrail.llm import components as cc
from veritrail.llm.components import components
from veritrail.llm.simhash import candidates, chain_length, chain_masks, fingerprint, hex_of, links, near_duplicates, ring


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_the_definition():
    rnd = random.Random(3)
    for n in (0, 1, 3, 4, 5, 40, 400):
        text = rnd.choice([" ", "\n"]).join(rnd.choice(["Ab", "cde", "É", "x y", "the"]) for _ in range(n))
        assert fingerprint(text.encode()) == slow_fingerprint(text)
    assert fingerprint(None) == fingerprint(b"") == fingerprint(b" \n\t") == 0


def test_blocks_do_not_change_fingerprints(monkeypatch):
    import veritrail.llm.shingles as shingles

    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice(["aa", "b", " ", "  ", "\n", "ccc d", "É"]) for _ in range(rnd.randint(0, 60)))
        monkeypatch.setattr(shingles, "_BLOCK", rnd.randint(1, 30))
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_links_lose_none(spark):
    rnd = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(8):
            fps.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))))
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for segments, chain in ((None, None), (3, 1), (5, 1), (5, 3), (4, 2)):
        got = [tuple(r) for r in links(frame, 4, segments, chain).collect()]
        assert set(got) == want and len(got) == len(want)
    for bits in (0, 1, 9):
        want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
        assert {tuple(r) for r in links(frame, bits).collect()} == want
    assert sum(w for _, w in ring(3)) == 64


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[x] == 100 for x in range(100, 140))


def test_odd_rows(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six"),
            (5, None), (6, ""), (7, " \n "), (8, "solo"), (None, "nobody else says this at all today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "component_id": F.lit(0), "root": F.lit(1)})
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (None, 1), (5, 5), (6, 5), (7, 5), (8, 8), (None, None)], key=str)
    assert near_duplicates(docs.where("false")).count() == 0
    zero = near_duplicates(docs.where("doc_id = 6")).select(hex_of(F.col("fp"))).first()[0]
    assert zero == "0" * 16


def test_near_copies_meet_and_others_do_not(spark):
    rnd = random.Random(9)
    words = [[f"w{rnd.randint(0, 5000)}" for _ in range(400)] for _ in range(6)]
    rows = []
    for k, w in enumerate(words):
        rows.append((10 * k, " ".join(w)))
        for c in range(1, 4):
            copy = list(w)
            copy[rnd.randrange(400)] = "changed"
            rows.append((10 * k + c, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {d: slow_fingerprint(t) for d, t in rows}
    parent = {d: d for d in prints}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {d: find(d) for d in prints}


def test_longer_chains_leave_fewer_candidates(spark):
    rnd = np.random.default_rng(8)
    frame = spark.createDataFrame([(int(x),) for x in rnd.integers(-(2**63), 2**63, 6000)], "fp long")
    met = [candidates(frame, 4, 5, chain).count() for chain in (1, 2, 3)]
    assert met[0] > 20 * met[1] and met[1] <= 60 and met[2] <= met[1]
    assert len(chain_masks([12, 13], 4, 5)) == 14 and len(chain_masks([13, 13, 13], 4, 5)) == 274
    assert chain_length(1 << 20, 4, 5) == chain_length(1 << 28, 4, 5) == 2 and chain_length(1 << 36, 4, 5) == 3


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(cc, "HOT", 3)
    monkeypatch.setattr(cc, "PARTS", 4)
    edges = [(500, x) for x in range(200, 260)] + [(1, x) for x in range(240, 300)] + [(900 + i, 901 + i) for i in range(20)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(r == (900 if n >= 900 else 1) for n, r in got.items()) and len(got) == 123
    rows = [(i, "one two three four five six" if i % 3 else f"a b c d {i} {i}") for i in range(60)]
    for similarity in (None, (4, 5)):
        found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: 1 if i % 3 else i for i, _ in rows}
