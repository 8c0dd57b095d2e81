"""Manifest, clustering and byte-level BPE against brute force, with nulls, ties, repeats, empty tables and clashing column names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken

from planar_spark.llm import byte_bpe, centroids, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, block string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """Rows of the manifest, level by level with lists."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(part, (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        groups.setdefault(r[3], []).append((r, leaf(r, r[1]), leaf(r, r[1].replace("\n", "")) if hit else leaf(r, r[1])))

    def grown(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, i):
        out = []
        for level in levels[:-1]:
            run = range(i // 3 * 3, min(len(level), i // 3 * 3 + 3))
            out.append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
            i //= 3
        return out

    trees, order = {}, sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = grown([x[1] for x in groups[s]])
    top = grown([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (r, own, now) in enumerate(groups[s]):
            steps = way(trees[s], i) + way(top, k)
            for left, right in steps:
                now = h(left, now, right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(*(a + b for a, b in steps)), now, now == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize(("depth", "n"), [(8, 300), (1, 300), (2, 41), (1, 1), (2, 0)])
def test_manifest(spark, monkeypatch, depth, n):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(n)
    rows = [(i, rng.choice(["a\nb", "", None, "é\n\n" * 50, "x"]), rng.choice(["en", None]), None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", i % 5 or None, "t", "d", "b") for i in range(n)]
    rows += rows[3:6] + [(7, "other", "en", "s1", 1, "", "", "")] + [(None, "a\nb", "en", "s0", 1, "", "", ""), (None, None, None, None, None, None, None, None)] * (n > 1)
    rows = rows if n else []
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    if n > 1:
        assert not all(r["verified"] for r in got) and any(r["verified"] for r in got)


def brute_clusters(vectors, k, rounds):
    """(vec_id, cluster, distance) with Python's whole numbers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    now = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, h(f"3:{r[0]}"), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            now[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, *reversed(near(v))) for i, v in kept], now


def test_clusters(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 0, 0.25, 1]) + rng.random() * (i % 2) for _ in range(64)]) for i in range(150)]
    rows += [(i, rows[i % 7][1]) for i in range(150, 190)]  # ties and repeats
    rows += [(3, [0.5] * 64), (None, [0.1] * 64), (500, None), (501, [1.0] * 63), (502, [None] + [1.0] * 63), (503, [float("nan")] * 64), (504, [float("inf")] * 64), (505, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, now = brute_clusters(rows, 8, 10)
    got = centroids.clustered(df).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for _, _, d in want)
        assert r["centroid_sha256"] == h(",".join(map(str, now[r["cluster"]])))
    assert centroids.clustered(df.limit(0)).count() == 0
    few = centroids.clustered(df.where("vec_id in (1, 2, 500)")).collect()
    assert {(r["vec_id"], r["distance"]) for r in few} == {(1, 0), (2, 0)}
    with pytest.raises(Exception, match="64 bits"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_screening_leaves_ties_to_whole_numbers():
    rng = np.random.default_rng(5)
    for top in (3, 1 << 12, 1 << 26):  # the last can't be told apart in float32
        v = rng.integers(-top, top, (400, 64))
        c = np.concatenate([v[:5] + rng.integers(-1, 2, (5, 64)), v[:5], v[:5]])
        exact = ((v[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (centroids.nearest(v, c) == exact).all()


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


ODD = [*"abst rvemld'  \n\t'éß中文٣½  🙂-_1239.,", "'s", "'re", "'ll", "'ve", " '", "''", "\r\n", " ", "<|endoftext|>"]


def test_words_are_the_patterns_matches(vocabulary):
    import regex

    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, "", "'", " ", "don't"]
    got = []
    for row, end, words, before in byte_bpe.blocks(pa.array(texts), vocabulary.classes):
        every = words.to_pylist()
        assert end - row == len(before) - 1
        got += [every[a:b] for a, b in zip(before, before[1:], strict=False)]
    assert got == [regex.findall(public_tokenizers.PATTERN, t or "") for t in texts]


def test_byte_bpe(spark, vocabulary, library, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeéstz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["".join(rng.choice(ODD) for _ in range(200)) for _ in range(20)]
    texts += [None, "", " \n", "x" * 700 + "-" * 300 + "中文字" * 200, "".join(map(chr, range(0x20, 0x2000))), texts[0], " ".join(texts[:60]) * 20]
    df = spark.createDataFrame([(i % 80, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, joined string, ids string")
    want = Counter()
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want[i % 80, len(ids), h(" ".join(map(str, ids))), h(t or "")] += 1
    for words in (byte_bpe.WORDS, 0):  # with the frequent words folded beforehand, and with every word folded where it stands
        monkeypatch.setattr(byte_bpe, "WORDS", words)
        assert Counter(map(tuple, byte_bpe.tokenize(df, vocabulary).collect())) == want
    assert byte_bpe.tokenize(df.limit(0), vocabulary).count() == 0
