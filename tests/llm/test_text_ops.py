"""Text operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing column names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from planar_spark.llm import exact_dedup, line_dedup, mixing, ngram_join, queries, substring_dedup, toxicity, unigram

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, key string"
EMPTY = (900, ""), (901, None), (902, " \t\n ")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, common = [], "\n".join(prose(9) for _ in range(14))
    for i in range(160):
        t = "\n".join(prose(rng.randint(3, 12)) for _ in range(rng.randint(1, 12)))
        if i % 5 == 0:
            t = t + "\n" + common + "\n" + prose(4)
        rows.append((i, t))
    for i in range(160, 220):  # near copies, many of one text
        w = rows[3 if i % 2 else rng.randrange(160)][1].split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, rows[7][1].replace(" ", "  ")) for i in range(220, 240)]
    return [*rows, *EMPTY, (903, prose(20_000)), (904, "one two"), (905, "One  TWO")]


def test_exact_dedup(spark, texts):
    want = defaultdict(list)
    for i, t in texts:
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(frame(spark, texts)).collect()}
    for t, ids in want.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(ids), len(ids), i == min(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_line_dedup(spark, texts):
    want, seen, parts = {}, Counter(), {}
    for i, t in texts:
        lines = (t or "").split("\n")
        parts[i] = [(a, b, "\n".join(lines[a:b])) for a, b in line_dedup.chunks(lines)] if len(lines) > 1 else []
        seen.update(body for a, b, body in parts[i] if b - a > 1 and body.strip())
    first = set()
    for i, t in sorted(texts):
        lines, drop = (t or "").split("\n"), set()
        for a, b, body in parts[i]:
            if b - a > 1 and seen[body] > 1:
                if body in first:
                    drop |= set(range(a, b))
                first.add(body)
        want[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop), len(drop)
    out = line_dedup.dedup_lines(frame(spark, texts))
    assert {r["doc_id"]: (r["text"], r["lines_removed"]) for r in out.collect()} == want
    assert sum(n for _, n in want.values()) > 100 and out.columns[:7] == frame(spark, texts).columns
    assert line_dedup.dedup_lines(frame(spark, texts).limit(0)).count() == 0


def test_line_dedup_whole(spark):
    """Every line of a passage of at least two non-blank lines that stands earlier goes: all passages of every length, by brute force."""
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(9))
    passages, rows = [[prose() for _ in range(n)] for n in (2, 2, 3, 3, 4, 5, 20)], []
    passages[4].insert(2, "")
    for i in range(120):
        lines = [prose() for _ in range(rng.randint(1, 6))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = rng.randint(0, max(0, len(p) - 2))
            at = rng.randint(0, len(lines))
            lines[at:at] = p[cut:] if i % 3 else p
        rows.append((i, "\n".join(lines)))
    rows += [(120, "\n".join(["same"] * 4)), *EMPTY]
    seen, want, later = set(), {}, 0
    for i, t in rows:
        lines, gone = (t or "").split("\n"), set()
        spans = sorted(((a, b) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1)), key=lambda s: s)
        for a, b in spans:
            if lines[a].strip() and lines[b - 1].strip():
                body = tuple(lines[a:b])
                if body in seen:
                    gone |= set(range(a, b))
                seen.add(body)
        later += len(gone)
        want[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    share = {}
    for whole in (False, True):
        got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.dedup_lines(frame(spark, rows), whole).collect()}
        share[whole] = sum(n for _, n in got.values()) / later
        for i, (text, n) in got.items():  # what goes stands earlier in the corpus, and nothing else does
            kept, must = iter((want[i][0] or "").split("\n")), (text or "").split("\n")
            assert n <= want[i][1] and (not want[i][0] or sum(line in must for line in kept) == len((want[i][0]).split("\n")))
    assert share[True] > 0.95 and share[False] < 0.7
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0), True).count() == 0


def test_line_dedup_of_repeated_and_missing_ids(spark):
    """Rows are documents of their own whatever their ids; a column that clashes stays."""
    passage = "\n".join(f"line {i} of a passage" for i in range(30))
    rows = [(1, "a\n" + passage), (1, "b\n" + passage), (None, "c\n" + passage), (None, "d\n" + passage), (2, None), (None, "")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, lines_total string")
    out = line_dedup.dedup_lines(docs, True)
    got = out.collect()
    assert sum(passage in (r["text"] or "") for r in got) == 1 and sum(r["lines_removed"] for r in got) == 90 and len(got) == 6
    assert out.columns == ["doc_id", "text", "lines_total", "lines_total_", "lines_removed", "chunks_removed"] and {r["lines_total"] for r in got} == {"mine"}


def test_line_chunks_resist_shifts():
    lines = [f"line {i}" for i in range(200)]
    ends = lambda c, by: {b + by for _, b in c}
    assert len(ends(line_dedup.chunks(lines), 1) & ends(line_dedup.chunks(["new", *lines]), 0)) > 40


def components_of(texts, n, percent):
    sets, up = {}, {i: i for i, _ in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, texts, n, percent):
    some = [r for r in texts if r[0] != 903]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, some), n, percent).collect()}
    assert got == components_of(some, n, percent)


def test_ngram_join_in_many_blocks(spark, texts, monkeypatch):
    for name in "BLOCK", "WIDE":
        monkeypatch.setattr(ngram_join, name, 4)
    some = [r for r in texts if r[0] < 240]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, some), 4, 85).collect()}
    assert got == components_of(some, 4, 85)


def test_ngram_join_of_repeated_and_missing_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "p q r s t"), (1, long), (2, long + " more"), (3, "p q r s t"), (4, "alone"), (None, long), (None, "nobody else has this"), (None, None), (5, "alone"), (5, "alone"), (6, "")]
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows), 4, 85).collect()), key=str)
    want = [(1, 37, 1), (2, 38, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6), (None, 37, 1), (None, 1, None), (None, 0, None)]
    assert got == sorted(want, key=str)
    kept = ngram_join.one_of_each(frame(spark, rows), 4, 85)
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect()) == [(1, "p q r s t"), (1, long), (4, "alone"), (6, "")]
    assert kept.where("doc_id is null").count() == 3
    assert ngram_join.jaccard_components(frame(spark, rows).limit(0), 4, 85).count() == 0


def test_anchors_in_pieces():
    data = substring_dedup.np.random.default_rng(3).integers(97, 99, 5000).astype(substring_dedup.np.uint8)
    whole = substring_dedup.anchors(data, 60, 30)
    for piece in (1, 7, 100, 4999):
        assert [x.tolist() for x in substring_dedup.anchors(data, 60, 30, piece)] == [x.tolist() for x in whole]


@pytest.mark.parametrize("per_range", [20_000, 20])
def test_suffix_dedup(spark, texts, per_range, monkeypatch):
    length, some = 60, [r for r in texts if r[0] != 903] + [(950, "a" * 300), (951, "ab" * 90), (952, texts[4][1]), (952, texts[4][1])]
    # One gram in many contexts, which is cut into several ranges if they are small.
    some += [(960 + i, f"{i * 7919} boilerplate that everyone has, over and over, in many a place {i % 9} {'and on' * 3} {i % 4}") for i in range(300)]
    cuts, real = [], substring_dedup.wide_cuts
    monkeypatch.setattr(substring_dedup, "wide_cuts", lambda *a: cuts.append(real(*a)) or cuts[-1])
    seen = Counter()
    for _, t in some:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame(spark, some), length, 30, per_range).collect()}
    for i, t in some:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        assert got[i] == (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest(), spans > 0)
    assert per_range > 20 or sum(map(len, cuts[0].values())) > 2
    assert substring_dedup.remove_repeats(frame(spark, some).limit(0), length, 30).count() == 0


def test_planted_passages(spark, tmp_path):
    """The query on passages of over 50 words that stand in two texts: from 400 bytes on they go whole, shorter ones and clean texts stay."""
    rng, rows, want = random.Random(11), [], {}
    prose = lambda n: " ".join(f"{rng.getrandbits(24):06x}" for _ in range(n))
    for k in range(40):
        size = (399, 400, 640, 0)[k % 4]
        passage = prose(100)[:size]
        assert not size or len(passage.split()) > 50
        for edge in "<[":  # neighbours differ, so that nothing beyond the passage repeats
            rows.append((len(rows), prose(rng.randint(1, 90)) + edge + passage + edge + prose(rng.randint(1, 90))))
            want[rows[-1][0]] = (len(rows[-1][1]), size if size >= 400 else 0, int(size >= 400), size >= 400)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["repeats"]) for r in got} == want


def test_mixing(spark, texts):
    docs = frame(spark, texts)
    rows = mixing.curriculum(docs).collect()
    size, target, taken, own = Counter(), {}, Counter(), {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s], own[s] = r["target"], r["source_size"]
    assert dict(size) == own and all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 and all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.curriculum(docs.repartition(3)).collect()))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_keeps_clashing_columns(spark, texts):
    docs = frame(spark, texts).withColumnsRenamed({"h1": "mix_copy", "key": "mix_position"})
    out = mixing.mixed_documents(docs, with_position=True)
    at = [r["mix_position_"] for r in out.collect()]
    assert out.columns == [*docs.columns, "mix_position_"] and at == sorted(at) and len(at) > 200


def test_mixing_places_every_copy(spark, texts):
    """With even schedules a copy is due at its share of the words of all passes, by brute force."""
    docs, even = frame(spark, texts), (((0.0, 1.0), (1.0, 1.0)),)
    source, by_source, due = {r["doc_id"]: r["source"] for r in docs.collect()}, defaultdict(list), []
    for r in mixing.curriculum(docs, schedules=even).collect():
        by_source[source[r["doc_id"]]].append(r)
    for rows in by_source.values():
        rows.sort(key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest()))
        done = 0
        for copy in range(2):
            for r in rows:
                part = min(r["size"], r["taken"] - copy * r["size"])
                if r["size"] and int(r["taken"] / r["size"] + 0.5) > copy:
                    due.append((round(min(1.0, (done + part / 2) / r["target"]), 9), r["doc_id"], copy))
                done += r["size"]
    got = [r["doc_id"] for r in mixing.mixed_documents(docs, schedules=even).collect()]
    assert got == [i for _, i, _ in sorted(due)] and len(got) > len(set(got))


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_unigram_best_path_against_brute_force():
    pieces = [b"<unk>", "▁".encode(), b"a", b"b", b"ab", "▁a".encode(), b"ba", b"bab", "é".encode()]
    m = unigram.Unigram(pieces, unigram.np.array([0, -2.0, -3, -3.5, -4, -3.2, -4.4, -5.1, -6]), [], 0, key="tiny")

    def best(s):
        if not s:
            return 0.0
        return max((m.scores[i] + best(s[len(p) :]) for i, p in enumerate(pieces[1:], 1) if s.startswith(p)), default=-1e9)

    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("ab▁é") for _ in range(rng.randint(1, 9))).encode()
        one = unigram.solve_one(m, word)
        assert abs(sum(m.scores[i] for i in one) - best(word)) < 1e-9
        many = unigram.np.frombuffer(unigram.solve_many(m, [word])[0], unigram.np.int32)
        assert abs(sum(m.scores[i] for i in many) - best(word)) < 1e-9


def test_unigram_round_trip(spark, texts):
    odd = [(910, "a  b\n\n▁ \U0001d4b3 漢字\x00\r"), (911, " lead"), (912, "trail "), (913, "x" * 5000)]
    rows = unigram.tokenize(frame(spark, [*texts, *odd]), unigram.load(MODEL)).collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows) and len(rows) == len(texts) + 4
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[901] == 0


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    words = ["w" + "".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["vileone", "viletwo", "grubby"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs = frame(spark, [*rows, *EMPTY])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in scored if r["held"] and r["doc_id"] < 900]
    assert len(held) > 100 and sum((r["tox_score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held) > 0.95 * len(held)
    assert all(0 <= r["tox_score"] <= 1 for r in scored) and len({r["tox_score"] for r in scored if r["doc_id"] in (900, 901, 902)}) == 1
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["tox_score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_scores_depend_on_the_text_alone(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 40)  # long texts in many pieces
    np, rng = toxicity.np, random.Random(6)
    draw = np.random.default_rng(6)
    filters = {w: draw.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}
    embedding = draw.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32)
    embedding[toxicity.PAD] = 0
    out = draw.normal(size=toxicity.FILTERS * len(filters)).astype(np.float32)
    model = toxicity.Model(embedding, filters, {w: np.zeros(toxicity.FILTERS, np.float32) for w in filters}, out, 0.0, (0.05, 0.0))
    terms = model.terms()
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for _ in range(3) for n in (0, 1, 2, 3, 5, 37, 38, 39, 40, 41, 42, 79, 80, 300)]
    rng.shuffle(texts)
    alone = [toxicity.scores([t], model, terms)[0] for t in texts]
    assert toxicity.scores(texts, model, terms).tolist() == alone and len({*alone}) > 30
    monkeypatch.setattr(toxicity, "WORDS", 1 << 16)
    assert toxicity.scores(texts, model, terms).tolist() == [toxicity.scores([t], model, terms)[0] for t in texts] == alone


def test_toxicity_training_does_not_mix_neighbours():
    """Texts of weight 0 among others teach nothing: the embeddings of their words stay at their start."""
    np = toxicity.np
    ids = lambda *words: np.array([toxicity.SEEN[w] for w in words], np.int32)
    weighed, idle = [ids("plain"), ids("dull")], ids("vileone", "viletwo")
    labels, weights = np.array([0.0, 0.0, 1.0, 0.0] * 24), np.array([1.0, 0.0, 1.0, 0.0] * 24)
    model = toxicity.train([weighed[0], idle, weighed[1], idle] * 24, labels, weights, epochs=2)
    start = np.random.default_rng(7).normal(0, 0.1, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32)
    rows = lambda x: np.concatenate([x >> 16, x & 0xFFFF])
    assert (model.embedding[rows(idle)] == start[rows(idle)]).all()
    assert (model.embedding[rows(weighed[0])] != start[rows(weighed[0])]).any()


def test_mixing_of_repeated_ids(spark):
    """Rows that repeat an id are documents of their own: each comes as often as its own plan says."""
    rows = [(1, "w " * 10), (1, "v " * 1000), *[(i, "u " * (5 + i)) for i in range(2, 40)]]
    docs = frame(spark, rows).withColumn("source", mixing.F.lit("s"))
    plan = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.curriculum(docs).collect()}
    got = [(r["doc_id"], len(r["text"].split())) for r in mixing.mixed_documents(docs).collect()]
    assert {k: got.count(k) for k in plan} == {k: round(t / k[1]) if t else 0 for k, t in plan.items()}


def test_toxicity_features_are_those_of_a_plain_convolution(monkeypatch):
    """Widths, padding and long texts in pieces, against loops over every window."""
    import numpy as np

    rng = np.random.default_rng(3)
    embedding = rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32)
    embedding[toxicity.PAD] = 0
    filters = {w: rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}
    bias = {w: rng.normal(size=toxicity.FILTERS).astype(np.float32) for w in toxicity.WIDTHS}
    model = toxicity.Model(embedding, filters, bias, np.zeros(toxicity.FILTERS * len(toxicity.WIDTHS)), 0.0)
    words = [f"w{i}" for i in range(40)]
    texts = ["", "one", "one two", " ".join(rng.choice(words, 9)), " ".join(rng.choice(words, 70)), "Zwei  ZWEI\nzwei"]
    want = []
    for text in texts:
        ids = toxicity.word_ids(text)
        vectors = [embedding[i >> 16] + embedding[i & 0xFFFF] for i in ids.tolist()] + [np.zeros(toxicity.DIM, np.float32)] * 2
        row = []
        for w in toxicity.WIDTHS:
            seen = [sum(vectors[p + k] @ filters[w][k] for k in range(w)) for p in range(len(vectors) - w + 1)]
            seen += [np.zeros(toxicity.FILTERS, np.float32)]  # padding alone
            row.append(np.maximum(np.max(seen, axis=0) + bias[w], 0))
        want.append(np.concatenate(row))
    for size in (toxicity.WORDS, 16):
        monkeypatch.setattr(toxicity, "WORDS", size)
        assert np.allclose(toxicity.features(texts, model, model.terms()), np.array(want), atol=1e-3)
