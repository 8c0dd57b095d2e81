"""Pages and pictures: WARC round trip, url rules, loser trees, image copies."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from planar_spark.llm import image_copies, loser_tree, url_filter, warc

URLS = [
    "http://example.net/en/a", "https://www.example.net/de/a", "http://A.Example.COM/de/x?y=1", "http://example.com", "ftp://x.org/fr/#f", "notaurl", None, "", "http://badexample.net/en/", "http://net/en",
    "http://example.net:80/en/", "http://u@example.net/en/", "http://example.net/en/\r\nX: y",
]


def pages(spark):
    big, rng = "é" * 80, random.Random(3)
    rows = [(i, u, rng.choice([big, "x" * 99, "x" * 100, None, "", "p" * i, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 4]), "z") for i, u in enumerate(URLS * 6)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, range string")


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    got = url_filter.judge(pages(spark), spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=5).collect()
    assert len(got) == pages(spark).count()
    for r in got:
        url = URLS[r["page_id"] % len(URLS)] or ""
        rest = url.partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].partition("#")[0].partition("?")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want[1:])
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judge(pages(spark).limit(0), none).count() == 0


def test_warc_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(pages(spark), folder)
    merged = warc.merge_index(warc.read_index(spark, folder), ranges=4).collect()
    got = {r["page_id"]: r for r in warc.resolved(spark.createDataFrame(merged)).collect()}
    first: dict[bytes, int] = {}
    for r in pages(spark).orderBy("page_id").collect():
        data = (r["html"] or "").encode()
        of = first.setdefault(data, r["page_id"]) if len(data) >= 100 else r["page_id"]
        kind = ("response", None) if of == r["page_id"] else ("revisit", of)
        g = got[r["page_id"]]
        assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), *kind)
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(merged, key=lambda r: (r["range_no"], r["place"]))]
    assert order == sorted(order) and len(order) == pages(spark).count()


def test_warc_repeated_page_ids(spark, tmp_path):
    a, b = "A" * 200, "B" * 200
    rows = spark.createDataFrame([(1, "http://x/", a), (2, "http://x/", a), (2, "http://y/", b), (3, "http://x/", a), (4, None, b)], "page_id long, url string, html string")
    warc.write_archives(rows, f"file://{tmp_path}/w")
    got = warc.resolved(warc.merge_index(warc.read_index(spark, f"file://{tmp_path}/w"))).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    of = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(1, "response", None, 200, of(a)), (2, "revisit", 1, 200, of(a)), (2, "response", None, 200, of(b)), (3, "revisit", 1, 200, of(a)), (4, "revisit", 2, 200, of(b))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    warc.write_archives(rows.limit(0), f"file://{tmp_path}/none")
    assert warc.merge_index(warc.read_index(spark, f"file://{tmp_path}/none")).count() == 0


def test_loser_trees():
    rng = random.Random(4)
    for k in range(9):
        runs = [sorted((rng.randrange(9), i) for _ in range(rng.randrange(12))) for i in range(k)]
        assert list(loser_tree.merge(runs)) == sorted(x for r in runs for x in r)
        strings = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(80))).encode() for _ in range(rng.randrange(9))) for _ in range(k)]
        coded = [[(loser_tree.common(r[i - 1], s) if i else 0, s, None) for i, s in enumerate(r)] for r in strings]
        out = list(loser_tree.merge_prefixed(coded))
        assert [s for _, s, _ in out] == sorted(s for r in strings for s in r)
        assert all(n == loser_tree.common(p, s) for (_, p, _), (n, s, _) in zip(out, out[1:]))


def test_image_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).astype(float).tolist(), "q") for i in range(60)] + [(60 + i, None if i else [1.0], "q") for i in range(3)]
    rows += [(70, rows[3][1], "q"), (71, rows[3][1], "q")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, corner string")
    queries = image_copies.rendered(table.where("vec_id % 20 = 0"), edited=True)
    pairs, members = image_copies.find_copies(queries, image_copies.rendered(table))
    got = {(r["query_id"], r["image_id"]) for r in pairs.collect()}
    assert got == {(0, 0), (20, 20), (40, 40)}
    of = {r["image_id"]: r["class_id"] for r in members.where("side = 'index'").collect()}
    assert of[70] == of[71] == 3 and of[61] == 61


def test_image_matches_against_brute_force():
    rng = np.random.default_rng(7)
    q, k = (np.zeros(n, image_copies.KEYPOINT) for n in (70, 2100))
    for n in "d0", "d1":
        k[n] = rng.integers(0, 1 << 63, len(k), np.uint64)
    for i in range(len(q)):  # i % 30 bits apart, spread over all words
        bits = int(k["d0"][30 * i]) << 64 | int(k["d1"][30 * i])
        for at in rng.choice(128, i % 30, replace=False):
            bits ^= 1 << int(at)
        q["d0"][i], q["d1"][i] = bits >> 64, bits & ((1 << 64) - 1)
    want = {(i, j) for i in range(len(q)) for j in range(len(k)) if (int(q["d0"][i]) ^ int(k["d0"][j])).bit_count() + (int(q["d1"][i]) ^ int(k["d1"][j])).bit_count() <= 20}
    a, b = image_copies.matches(q, k, 20)
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) == len(a) >= 49


def turned(p, degrees, size):
    """The middle of a picture, turned and scaled about its centre."""
    h = int(p.shape[0] * 0.8)
    r, c = np.mgrid[:h, :h] - (h - 1) / 2
    t = np.radians(degrees)
    y, x = ((np.cos(t) * r + np.sin(t) * c) / size + (p.shape[0] - 1) / 2, (np.cos(t) * c - np.sin(t) * r) / size + (p.shape[1] - 1) / 2)
    y, x = np.clip(y, 0, p.shape[0] - 1.001), np.clip(x, 0, p.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    f, g = y - i, x - j
    return p[i, j] * (1 - f) * (1 - g) + p[i + 1, j] * f * (1 - g) + p[i, j + 1] * (1 - f) * g + p[i + 1, j + 1] * f * g


def test_turned_and_rescaled_copies(spark):
    rng = np.random.default_rng(9)
    pictures = [image_copies.resized(rng.uniform(0, 255, (24, 24)), 160, 160) for _ in range(12)]
    edits = [turned(p, d, z) + rng.normal(0, 3, (128, 128)) for p, (d, z) in zip(pictures, [(7, 1), (-8, 1), (22, 1), (0, 1.08), (5, 0.95), (37, 1)] * 2)]
    frames = [spark.createDataFrame([(i, bytearray(image_copies.write_pgm(p))) for i, p in enumerate(x)], "image_id long, media binary") for x in (edits, pictures)]
    got = {(r["query_id"], r["image_id"]) for r in image_copies.copies(*frames).collect()}
    assert got == {(i, i) for i in range(12)}


def test_crops_of_large_pictures(spark):
    rng = np.random.default_rng(10)
    pictures = [image_copies.resized(rng.uniform(0, 255, (80, 80)), 480, 480) for _ in range(6)]
    places = [(0, 0), (352, 352), (100, 200), (300, 50), (17, 351), (200, 200)]
    crops = [p[r : r + 128, c : c + 128] + rng.normal(0, 2, (128, 128)) for p, (r, c) in zip(pictures, places)] + [turned(pictures[0][:160, :160], 0, z) for z in (0.92, 0.85)]
    frames = [spark.createDataFrame([(i, bytearray(image_copies.write_pgm(p))) for i, p in enumerate(x)], "image_id long, media binary") for x in (crops, pictures)]
    got = {(r["query_id"], r["image_id"]) for r in image_copies.copies(*frames).collect()}
    assert got == {*((i, i) for i in range(6)), (6, 0), (7, 0)}


def test_tables_choose_the_pairs_of_brute_force(monkeypatch):
    rng = np.random.default_rng(12)

    def block(pictures):
        out = []
        for i, p in enumerate(pictures):
            which, x, y, scale, turn, words = image_copies.keypoints(np.clip(np.rint(p), 0, 255).astype(np.float32)[None])
            rows = np.zeros(len(which), image_copies.KEYPOINT)
            rows["image"], rows["corner"], rows["x"], rows["y"], rows["scale"], rows["turn"] = i, np.arange(len(which)), x, y, scale, turn
            rows["d0"], rows["d1"] = words.view(np.uint64).T
            out.append(rows)
        return np.concatenate(out)

    pictures = [image_copies.resized(rng.uniform(0, 255, (24, 24)), 160, 160) for _ in range(40)]
    edits = [turned(p, d, z) + rng.normal(0, 3, (128, 128)) for p, (d, z) in zip(pictures, [(7, 1), (37, 1), (0, 1.08), (15, 1.2), (90, 1), (0, 0.8)])]
    q, k = block(edits), block(pictures)
    want = sorted(image_copies.tallied(q, k, *image_copies.matches(q, k, 20), 8))
    assert {x[:2] for x in want} >= {(i, i) for i in range(6)}
    compared, plain = [], image_copies.matches
    monkeypatch.setattr(image_copies, "matches", lambda a, b, d: compared.append(len(a) * len(b)) or plain(a, b, d))
    found = image_copies.voted(q, k, 20, 8, 3)
    assert set(found) <= set(want) and {x[:2] for x in found} >= {(i, i) for i in range(6)} and len(found) >= 0.9 * len(want)
    assert 0 < sum(compared) < 0.2 * len(q) * len(k)
    # Words of very many descriptors in parts, copies of one descriptor, no descriptors.
    monkeypatch.setattr(image_copies, "HELD", 64)
    assert sorted(image_copies.voted(q, k, 20, 8, 3)) == sorted(found)
    same = np.concatenate([k[:1]] * 50)
    assert image_copies.voted(same, same, 20, 8, 2) == [] and image_copies.voted(q, k[:0], 20, 8, 2) == image_copies.voted(q[:0], k, 20, 8, 2) == []
    assert np.array_equal(image_copies.unpacked(pa.py_buffer(image_copies.packed([k[:7], k[7:]]))), k)
