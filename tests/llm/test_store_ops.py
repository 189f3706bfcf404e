"""URL filters, exact top-k, byte-level BPE, WARC, mixing."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import mixing, warc
from veritrail.llm import url_filter as uf
from veritrail.llm.common import row_hashes
from veritrail.llm.bpe import Edited, Vocabulary, encode_decode, read_ranks
from veritrail.llm.topk import top_k

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

# ---- URL filters --------------------------------------------------------------------------------------------------


def test_cascade_is_exact_over_its_universe(spark):
    universe = [f"k{i}" for i in range(4000)]
    listed = universe[::13] + ["outside"]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    levels = uf.cascade(frame(listed + [None, listed[0]]), frame(universe + universe[:50] + [None]), rate=0.3)
    assert len(levels) > 3
    rows = frame(universe + ["outside"]).select("key", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("g"), "key").alias("g")).collect()
    found = uf.member(levels, *[np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in ("h", "g")])
    assert {r["key"] for r, f in zip(rows, found) if f} == set(listed)
    assert uf.cascade(frame([]), frame(universe)) == []


def slow_judge(url, block, allow):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for rules, v in ((block, "block"), (allow, "allow")) for h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


BLOCK, ALLOW = [("com", "/en/"), ("example.net", "/de/8"), ("org", "/es/"), ("a.b.c", "")], [("example.com", "/en/7"), ("net", "/de/"), ("x.a.b.c", "/q")]
URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/704?x", "http://example.com/en/6", "https://www.example.net/de/8#a", "https://net/de/9", "http://x.a.b.c/q/1", "http://y.a.b.c", "ftp://a.b.c?q", "http:///en/", "http://É.com/en/",
        "http://com/en", "http://com/en/", "a://b://com/en/", "http://notexample.net/de/8", "http://org/es/://x"]


def test_urls_by_brute_force(spark, monkeypatch):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[3]), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "keys": F.lit(1), "id": F.lit(2)})
    want = sorted([(i, *slow_judge(u, BLOCK, ALLOW)) for i, u in rows], key=str)
    assert sorted(map(tuple, uf.judge(pages, BLOCK, ALLOW).collect()), key=str) == want
    assert uf.judge(pages.where("false"), BLOCK, ALLOW).count() == 0
    assert {r["verdict"] for r in uf.judge(pages, [], []).collect()} == {"allow"}
    monkeypatch.setattr(uf, "MAX_LISTED", 2)  # too long to broadcast: exact joins
    assert sorted(map(tuple, uf.judge(pages, BLOCK, ALLOW).collect()), key=str) == want


# ---- exact top-k --------------------------------------------------------------------------------------------------


def slow_top(rows, k, step):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % step == 0}):
        own = min((np.array(v, np.float64).tobytes(), v) for i, v in good if i == q)[1]
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("shape", ["random", "clusters", "equal"])
def test_top_k_by_brute_force(spark, shape, monkeypatch):
    import veritrail.llm.topk as topk

    monkeypatch.setattr(topk, "GROUP", 64)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(300, 8)) * rnd.choice([0.1, 1, 3], size=(300, 1))
    if shape == "clusters":
        base = np.repeat(rnd.normal(size=(10, 8)), 30, axis=0) + 0.01 * base
    if shape == "equal":
        base[50:250] = base[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(vectors, F.col("id") % 50 == 0, 5).collect())) == slow_top(rows, 5, 50)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (50, [-1.0, 1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (8, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("clash"), "score": F.lit(0), "v": F.lit(1)})
    padded = [(i, v if v is None else list(v) + [0.0] * (2 - len(v))) for i, v in rows]
    assert sorted(map(tuple, top_k(vectors, F.col("id") % 50 == 0, 5).collect())) == slow_top(padded, 5, 50)
    assert top_k(vectors.where("false"), F.col("id") % 50 == 0).count() == 0
    assert top_k(vectors.where("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_far_vectors_score_with_near_ones(spark):
    rows = [(0, [1.3e7, 0.0]), (50, [1.0, 2.0]), (3, [2.0, 1.0])]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == slow_top(rows, 5, 50)


@pytest.mark.parametrize("bits", [24, 28, 30])
def test_scores_are_exact_at_any_magnitude(spark, bits):
    rnd = random.Random(bits)
    rows = [(i, [float(rnd.randint(-(2**bits), 2**bits)) / 256 for _ in range(6)]) for i in range(120)]
    rows += [(500, [1e200, 1.0]), (501, [3e9] * 6), (550, [2.0**60 / 256, 0.0]), (551, [0.0, 1e305]), (552, [1e308, 0.0])]  # not all of their scores fit; 552 overflows
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i < 552]
    fits = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q, x in (r for r in good if r[0] % 10 == 0):
        scored = sorted((-fits(sum(a * b for a, b in zip(x, v))), i) for i, v in good if i != q)[:5]
        want += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(frame, F.col("id") % 10 == 0).collect())) == want


# ---- byte-level BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        v = Vocabulary(read_ranks(f.read().split(b"\n")), P.PATTERN)
    return v, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def some_text(rnd):
    kind = rnd.random()
    if kind < 0.4:
        return "".join(rnd.choice(["the ", " and", "ing", "  ", "\n", "'s", "'re", "'x", "abc", "12", " x", ". ", "é", "日本", "\U0001f600", "%%%", "\t"]) for _ in range(rnd.randint(0, 40)))
    if kind < 0.7:
        return "".join(chr(rnd.choice([rnd.randint(1, 127), rnd.randint(128, 2500), rnd.randint(0x4E00, 0x4F00)])) for _ in range(rnd.randint(0, 60)))
    return "".join(rnd.choice("aaaaabcs' \n") for _ in range(rnd.randint(0, 200)))


def test_ids_are_the_library_s(vocabulary):
    v, reference = vocabulary
    rnd = random.Random(1)
    for text in [some_text(rnd) for _ in range(3000)] + ["", "a" * 5000, "ab" * 3000, "<|endoftext|>", " " * 300]:
        ids = v.encode(text)
        assert ids == reference.encode_ordinary(text), text
        assert v.decode(ids) == text.encode()


def test_prefixes_are_encodings(vocabulary):
    v, reference = vocabulary
    piece = b" antidisestablishmentarianism"
    table = v.last_tokens(piece)
    for end in range(1, len(piece) + 1):
        assert v.walked(table[:end]) == v.walked(v.last_tokens(piece[:end]))
    more = piece + b"ness"
    assert v.last_tokens(more, table) == v.last_tokens(more)


def test_edits_and_appends_are_exact(vocabulary):
    v, reference = vocabulary
    rnd = random.Random(2)
    for _ in range(150):
        e = Edited(v, some_text(rnd))
        for _ in range(5):
            a = rnd.randint(0, len(e.text))
            e.edit(a, min(len(e.text), a + rnd.randint(0, 6)), rnd.choice(["", " ", "\n\n", "'ll", "the", " 9", some_text(rnd)]))
            assert e.ids == reference.encode_ordinary(e.text)
        e.append(some_text(rnd))
        assert e.ids == reference.encode_ordinary(e.text)


def test_a_small_memory_gives_the_same(vocabulary, monkeypatch):
    import veritrail.llm.bpe as bpe

    v, reference = vocabulary
    monkeypatch.setattr(bpe, "REMEMBER", 20)
    small = Vocabulary(v.ranks, P.PATTERN)
    rnd = random.Random(3)
    for text in (some_text(rnd) for _ in range(300)):
        assert small.encode(text) == reference.encode_ordinary(text)


def test_blocks_do_not_change_ids(vocabulary):
    v, reference = vocabulary
    rnd = random.Random(5)
    for _ in range(400):
        text = some_text(rnd) + some_text(rnd)
        parts = list(v.blocks(text, rnd.randint(1, 20)))
        assert "".join(parts) == text and [i for p in parts for i in v.encode(p)] == reference.encode_ordinary(text)


def test_encode_decode_rows(spark, vocabulary):
    _, reference = vocabulary
    rows = [(1, None), (2, ""), (3, "the end\n\n of é \U0001f600"), (None, "x"), (3, "the end\n\n of é \U0001f600"), (4, "word " * 250_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "ids": F.lit(1), "id": F.lit(1)})
    got = encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()
    assert len(got) == 6
    for r, (i, text) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(rows, key=lambda r: str(r[0]))):
        ids = reference.encode_ordinary(text or "")
        assert (r["doc_id"], r["n_tokens"], r["ids"]) == (i, len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_decode(docs.where("false"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# ---- WARC ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_convert(version):
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\r\n\r\nbody\r\n\r\nWARC/1.0\r\n"
    data = warc.version_block(version, "old.arc", "19970101000000")
    line = {"URL": "http://a/b c", "IP-address": "1.2.3.4", "Archive-date": "1997010203", "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(http))}
    data += warc.arc_header_line(version, line) + http + b"\n"
    plain = {"URL": "dns:a", "IP-address": "1.2.3.4", "Archive-date": "19970102030405", "Content-type": "text/dns", "Archive-length": "3"}
    data += warc.arc_header_line(version, plain) + b"a\nb" + b"\n"
    other = plain | {"URL": "http://a/x.gif", "Content-type": "image/gif", "Archive-length": "0"}
    data += warc.arc_header_line(version, other) + b"" + b"\n"
    arcs = list(warc.read_arc(data))
    assert [a.fields["URL"] for a in arcs] == ["filedesc://old.arc", "http://a/b c", "dns:a", "http://a/x.gif"] and {a.version for a in arcs} == {version}
    records = [warc.converted(a) for a in arcs]
    assert [r.headers["WARC-Type"] for r in records] == ["warcinfo", "response", "response", "resource"]
    assert records[1].headers["WARC-Date"] == "1997-01-02T03:00:00Z" and records[1].payload() == b"\r\n\r\nbody\r\n\r\nWARC/1.0\r\n"
    assert records[1].headers["WARC-Payload-Digest"] == warc.digest(records[1].payload()) and records[1].headers["WARC-Record-ID"] == warc.converted(arcs[1]).headers["WARC-Record-ID"]
    archive = b"".join(r.to_bytes() + warc.END for r in records)
    back = list(warc.read_warc(archive))
    assert [(r.headers, r.block) for r in back] == [(r.headers, r.block) for r in records]
    assert list(warc.grouped(iter([]))) == []
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-8]))
    with pytest.raises(ValueError):
        list(warc.read_warc(archive[:-6]))


def test_pages_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 3000)
    big, other = "é" * 700, "x" * 999
    rows = [(1, "http://a/1", big), (5, "http://a/ 5\n", big), (9, None, big), (9, "http://a/9", big), (2, "u", other), (3, "u", other), (4, "u", None), (6, "u", ""), (None, "u", big), (None, "u", "only\r\n\r\nme"),
            (7, "http://b", "y" * 1000), (8, "http://b", "y" * 1000), (10, "u", "z" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit("clash"), "sha": F.lit(1), "first": F.lit(2)})
    want = []
    for key, _, html in rows:
        data = (html or "").encode()
        most = max((k for k, _, h in rows if k is not None and (h or "").encode() == data), default=None)
        again = len(data) >= 1000 and most is not None and most != key
        want.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", most if again else None))
    for version in (1, 2):
        got = warc.round_trip(pages, arc_version=version)
        assert got.where("not digest_holds").count() == 0
        assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_hold_a_member_for_each_record(spark, tmp_path, monkeypatch):
    import gzip
    import zlib

    monkeypatch.setattr(warc, "ARCHIVE", 4000)
    rows = [(i, f"http://a/{i}", "same" * 400 if i % 2 else f"page {i} " * 120) for i in range(12)]
    folders = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "out"))
    kinds = []
    for folder in folders:
        for file in sorted((tmp_path / "out" / folder.rsplit("/", 1)[1]).glob("part-*")):
            data, members = file.read_bytes().rstrip(b"\0"), []
            while data:
                d = zlib.decompressobj(31)
                members.append(d.decompress(data))
                data = d.unused_data
            if not members:  # of a task without rows
                continue
            own = [next(warc.read_warc(m)).headers["WARC-Type"] for m in members]
            assert own[0] == "warcinfo" and len(own) > 1 and gzip.decompress(file.read_bytes()) == b"".join(members)
            kinds += own[1:]
    assert sorted(kinds) == ["response"] * 7 + ["revisit"] * 5


def test_arc_files_convert_by_path(spark, tmp_path):
    import gzip

    data = warc.version_block(1, "o.arc", "20000101000000") + warc.arc_of_page(1, "7", "http://a/", b"<p>\r\n\r\n</p>", "20000101000000")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(data)
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(data))
    warc.convert_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = warc.read_archives(spark, str(tmp_path / "out")).orderBy("record_type").collect()
    assert [r["record_type"] for r in got] == ["response", "response", "warcinfo", "warcinfo"] and got[0]["key"] == 7 and got[0]["payload_bytes"] == 11


# ---- mixing -------------------------------------------------------------------------------------------------------


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [n for n in names if n not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[n] for n in free)
        over = [n for n in free if level * w[n] > cap * sizes[n]]
        if not over:
            return fixed | {n: level * w[n] for n in free}
        fixed |= {n: cap * sizes[n] for n in over}


def test_targets_fill_by_weight_up_to_the_cap(spark):
    rnd = random.Random(4)
    for n in (1, 2, 7, 20):
        sizes = {(None if i == n - 1 and n > 2 else rnd.choice("aZéb") + str(i)): rnd.choice([0, 1, 10, 500, 4000]) for i in range(n)}
        frame = spark.createDataFrame([(s, v, 1) for s, v in sizes.items()], "source string, source_size long, documents long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        want = slow_targets(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_pairing_keeps_the_sum_and_the_means():
    rnd = np.random.default_rng(5)
    size, part = rnd.integers(1, 300, 40).astype(float), rnd.random(40)
    runs = []
    for seed in range(3000):
        out, held = mixing.paired(size, part, np.random.default_rng(seed))
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6
        assert all(p in (0, 1) for k, p in enumerate(out) if k != held)
        runs.append(out)
    assert np.abs(np.mean(runs, axis=0) - part).max() < 0.05


def mixing_rows(rnd, n):
    return [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 400])) if i % 11 else None, None if i % 13 == 0 else f"s{min(rnd.randint(0, 9), 4)}") for i in range(n)]


def test_mix_comes_near_its_targets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = mixing_rows(random.Random(6), 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "target": F.lit(1), "id": F.lit(1)})
    got = mixing.mixed(docs).toPandas()
    assert len(got) == 1500 and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = slow_targets(sizes)
    for source, own in got.groupby("source", dropna=False):
        source = None if source != source else source
        assert own["size"].sum() == sizes[source] and abs(own["taken"].sum() - want[source]) <= 400
    again = mixing.mixed(docs.repartition(9)).toPandas()
    assert dict(zip(got["id"], got["taken"])) == dict(zip(again["id"], again["taken"]))


def test_mix_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "a b c", None), (None, "a b c", None), (2, None, "t"), (3, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got) <= 3 * 10
    taken = mixing.taken_documents(docs.withColumn("salt", F.lit(1)))
    assert taken.columns == ["doc_id", "text", "source", "salt"] and taken.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(docs.where("false")).count() == 0 and mixing.taken_documents(docs.where("false")).count() == 0
    assert mixing.mixed(docs.where("doc_id > 1")).agg(F.sum("taken")).first()[0] == 0


def test_mix_tells_rows_apart_by_all_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    long = " ".join(["w"] * 400)
    rows = [(1, "x", None, 1), (1, None, "x", 1), (2, long, None, 1), (2, None, long, 1)] + [(5, "same words here", "big", 7)] * 10_000
    rows += [(6, f"text {i % 2}", "big", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    got = mixing.mixed(docs).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    counts = {(r["doc_id"], r["text"], r["source"], r["extra"]): 0 for r in docs.collect()}
    taken = mixing.taken_documents(docs)
    for r in taken.groupBy(*docs.columns).count().collect():
        counts[r["doc_id"], r["text"], r["source"], r["extra"]] = r["count"]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(row_hashes(docs), "gh")])
    told = keyed.join(spark.createDataFrame(got[["g", "h", "copies"]]).groupBy("g", "h").agg(F.sum("copies").alias("copies")), ["g", "h"]).distinct()
    assert {(r["doc_id"], r["text"], r["source"], r["extra"]): r["copies"] for r in told.collect()} == counts
    again = mixing.taken_documents(docs.repartition(3)).groupBy(*docs.columns).count()
    assert sorted(map(tuple, again.collect()), key=str) == sorted(((*k, n) for k, n in counts.items() if n), key=str)


def test_the_mix_of_equal_rows_and_of_large_blocks_keeps_its_targets(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(["w"] * rnd.choice([3, 10, 30, 80])), "a" if i % 3 else "b") for i in range(3000)] + [(9000, " ".join(["w"] * 5000), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).toPandas()
    for _, own in got.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 100
    means = [mixing.mixed(docs, seed=s).where("id < 20").select("id", "copies").toPandas().set_index("id")["copies"] for s in range(3)]
    assert 0 < np.mean(means) < 3 and len({tuple(m.sort_index()) for m in means}) == 3


def test_shared_folder_is_the_session_s(spark):
    from veritrail.llm.common import shared_dir

    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == (told.rstrip("/") if told else shared_dir(spark))


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from veritrail.llm.common import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda key: None))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: None), sparkContext=context))


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_rows_without_dropped_ids(spark, monkeypatch, bits):
    from veritrail.llm import bloom

    monkeypatch.setattr(bloom, "SPARING_BITS", bits)
    rows = [(i, f"t{i}") for i in range(500)] + [(None, "n"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    dropped = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(0,)], "doc_id long")
    got = bloom.without(docs, "doc_id", dropped)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in got.where("doc_id is not null").collect()) == sorted((i, t) for i, t in rows if i is not None and (i % 7))
    assert got.where("doc_id is null").count() == 1 and bloom.without(docs, "doc_id", dropped.where("false")).count() == 502
