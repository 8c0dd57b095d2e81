"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by joining the ids' pieces.

``merged`` is the encoder: a fold of Spark's higher-order functions. Its state is one array with a number for each piece of a word: the rank of
the pair that begins there and the piece's place. The least number is the next merge; a literal map from bytes to ranks, dealt to
buckets by hash, gives the ranks of the two pairs that it makes. A word that is a token as a whole is that token.

Words are counted over all documents, and of the distinct ones the most frequent (at most ``WORDS`` words and ``BYTES`` bytes, whatever
the input) are folded once and broadcast with their ids. Any other word is folded where it stands, so what a document costs depends on its length
only and no text is shuffled; the lexicon steers cost, never results. Texts are cut into words by their characters' classes, a block of texts at a
time: the words of a text are slices of its bytes.

Defined cases: a null or empty text has no ids; rows that repeat a doc_id are documents of their own; an empty table gives an empty one; further columns
are left out. A word without a fitting pair for long is folded in a time that grows with the square of its length; words of over 64 bytes are cut first
wherever two bytes stand side by side that do so in no token, which changes no merge.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, alone, discard, written

WORDS, BYTES, LONGEST = 3 << 18, 3 << 22, 1024
BUCKETS = 1 << 14
BLOCK = 1 << 22  # bytes of text that a task looks at together
OTHER, LETTER, NUMBER, SPACE = range(4)

# Fixed value: the pattern whose matches are encoded separately. ``starts`` cuts by its rules.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Endings that go with an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@dataclass(frozen=True)
class Vocabulary:
    """``ranks``: bytes to id; ``classes``: of every code point, its class; ``met``: of each two bytes, whether they are neighbours in a token."""

    ranks: dict[bytes, int]
    classes: np.ndarray
    met: np.ndarray


def load(path: str, pattern: str = PATTERN) -> Vocabulary:
    """The ranks of a vocabulary file. Characters' classes are asked of the tokenizer library, so that both know the same characters."""
    if pattern != PATTERN:
        raise ValueError("words are cut by another pattern than the vocabulary's")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    single = {bytes([i]): i for i in range(256)}
    if not single.keys() <= ranks.keys():
        raise ValueError("a byte-level vocabulary has a token for every byte")
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.zeros(0x110000, np.uint8)
    for kind, pat in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding("class", pat_str=pat, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    met = np.zeros((256, 256), bool)
    for token in ranks:
        b = np.frombuffer(token, np.uint8)
        met[b[:-1], b[1:]] = True
    return Vocabulary(ranks, classes, met)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each character's first byte, its code point) of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        after = np.concatenate([data, np.zeros(3, np.uint8)])
        first, one, two, three = points[wide], *((after[at[wide] + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
        points[wide] = np.where(first < 0xE0, (first & 0x1F) << 6 | one, np.where(first < 0xF0, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three))
    return at, points


def starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The places in ``data`` where words begin; texts lie side by side and begin at ``offsets``, which ends with the length of the whole."""
    at, points = code_points(data)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    last = np.zeros(n + 1, bool)  # the character before a text's first, hence last of its own
    last[np.searchsorted(at, offsets)] = True
    first, last = last[:n], last[1:]
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= first
    space = kind == SPACE
    # Before a word, the last of several white-space characters stands apart; a blank there belongs to the word.
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:]
    before_word &= ~last
    held = np.zeros(n, bool)
    held[1:] = before_word[:-1] & (points[:-1] == 32)
    begins = (begins & ~held) | before_word
    marks = np.flatnonzero(begins & (points == 39) & ~last)
    if len(marks):
        after = np.concatenate([points, np.zeros(2, points.dtype)])
        for ending in ENDINGS:
            fits = after[marks + 1] == ord(ending[0])
            if len(ending) == 2:
                fits &= (after[marks + 2] == ord(ending[1])) & ~last[np.minimum(marks + 1, n - 1)]
            hit = marks[fits]
            begins[hit + 1] = False
            end = hit + 1 + len(ending)
            begins[end[end < n]] = True
    return at[begins]


def blocks(texts: pa.Array, classes: np.ndarray) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(first row, end row, words, number of words before each row and in all) of a column of texts, some megabytes at a time."""
    lengths = pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, row = np.cumsum(lengths), 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + BLOCK, "right")))
        own = pa.concat_arrays([pc.fill_null(texts.slice(row, end - row), "")])
        offsets = np.frombuffer(own.buffers()[1], np.int32)[: len(own) + 1]
        data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        at = starts(data, offsets, classes)
        cut = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
        yield row, end, pa.StringArray.from_buffers(len(at), cut, pa.py_buffer(data)), np.searchsorted(at, offsets)
        row = end


def word_counts(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(word, n): how often each word stands in all texts; counted within tasks first."""
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Batches) -> Batches:
        for b in batches:
            for _, _, words, _ in blocks(b.column(0), known.value):
                seen = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(alone(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ranks_of(ranks: dict[bytes, int]) -> Column:
    """A literal map from bytes in hexadecimal to their rank, dealt to buckets by hash."""
    dealt: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        name = token.hex().upper()
        dealt[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(dealt)), "array<map<string,int>>")


def merged(name: Column, ranks: Column) -> Column:
    """The ids, in decimal and joined by blanks, of bytes in hexadecimal: a fold over their merges. ``ranks`` is a lambda's variable, so that the literal stands
    in the plan once."""
    rank = lambda name: F.element_at(F.get(ranks, (F.crc32(name) % BUCKETS).cast("int")), name)
    unit, none = 1 << 32, 1 << 52
    end = F.length(name) + 1
    place = lambda x: (x % unit).cast("int")
    known = lambda a, b: F.coalesce(rank(F.substr(name, a, b - a)).cast("long") * unit, F.lit(none)) + a
    begin = F.transform(F.sequence(F.lit(1), F.length(name) - 1, F.lit(2)), lambda a: F.when(a + 2 < end, known(a, a + 4)).otherwise(a + F.lit(none)))

    def step(pieces: Column, _: Column) -> Column:
        least = F.array_min(pieces)

        def joined(k: Column) -> Column:
            k = k.cast("int")  # the pair begins at the k-th piece; the one after it goes
            stop = lambda j: F.coalesce(place(F.get(pieces, j)), end)
            pair = lambda x, i: F.when(i == k - 2, known(place(x), stop(k + 1))).when((i == k - 1) & (k + 1 < F.size(pieces)), known(place(x), stop(k + 2))).when(i == k - 1, place(x) + F.lit(none)).otherwise(x)
            return F.transform(F.filter(pieces, lambda _, i: i != k), pair)

        # A one-element array binds a value that several places below need.
        return F.when(least >= none, pieces).otherwise(F.element_at(F.transform(F.array(F.array_position(pieces, least)), joined), 1))

    pieces = F.aggregate(F.sequence(F.lit(2), (F.length(name) / 2).cast("int")), begin, step)
    ids = lambda p: F.transform(p, lambda x, i: rank(F.substr(name, place(x), F.coalesce(place(F.get(p, i + 1)), end) - place(x))).cast("string"))
    return F.array_join(F.element_at(F.transform(F.array(pieces), ids), 1), " ")


def with_ranks(ranks: Column, use) -> Column:
    """``use`` of the literal map as a variable: a one-element array binds it."""
    return F.element_at(F.transform(F.array(ranks), use), 1)


def lexicon(docs: DataFrame, vocabulary: Vocabulary, ranks: Column) -> pa.Table:
    """(word, ids) of the vocabulary's own words and of the most frequent others: at most ``WORDS`` and ``BYTES`` of them."""
    counts = written(word_counts(docs, vocabulary.classes), "words")
    level = F.floor(F.log2("n") * 4)
    short = counts.where((F.octet_length("word") <= LONGEST) & (F.col("n") > 1))
    levels = short.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("level")).collect()  # 256 at most
    least, words, size = None, 0, 0
    for r in levels:
        words, size = words + r["words"], size + r["bytes"]
        if words > WORDS or size > BYTES:
            break
        least = r["level"]
    own = pa.table({"word": pa.array([t for t in vocabulary.ranks if valid(t)], pa.binary()).cast(pa.string()), "ids": pa.array([str(i) for t, i in vocabulary.ranks.items() if valid(t)])})
    if least is not None:
        name = F.hex(F.encode("word", "utf-8"))
        got = short.where(level >= least).select("word", name.alias("name"))
        # Dealt anew, since folding takes far longer than reading.
        got = got.repartition(F.xxhash64("word")).select("word", with_ranks(ranks, lambda r: merged(F.col("name"), r)).alias("ids"))
        found = got.toArrow().cast(own.schema)
        # A word that is a token as a whole is that token, whatever its merges give.
        own = pa.concat_tables([own, found.filter(pc.invert(pc.is_in(found.column("word"), value_set=own.column("word").combine_chunks())))])
    discard(counts)
    return own.combine_chunks()


def valid(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def parts(word: str, met: np.ndarray) -> list[str]:
    """A word's bytes in hexadecimal, if it is long cut where no token has its neighbouring bytes."""
    data = word.encode()
    if len(data) <= 64:
        return [data.hex().upper()]
    b = np.frombuffer(data, np.uint8)
    cut = [0, *(np.flatnonzero(~met[b[:-1], b[1:]]) + 1).tolist(), len(data)]
    return [data[i:j].hex().upper() for i, j in zip(cut, cut[1:], strict=False)]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids): each text's ids, in decimal and joined by one blank."""
    ranks = ranks_of(vocabulary.ranks)
    context = docs.sparkSession.sparkContext
    known = context.broadcast((lexicon(docs, vocabulary, ranks), vocabulary.classes, vocabulary.met))

    def run(batches: Batches) -> Batches:
        table, classes, met = known.value
        words_known, ids_known = table.column("word").chunk(0), table.column("ids").chunk(0)
        for b in batches:
            for row, end, words, before in blocks(b.column(1), classes):
                found = pc.index_in(words, value_set=words_known)
                missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
                ids = ids_known.take(found.drop_null())
                # Between words that the lexicon lacks, ids are joined; such a word's bytes go along.
                begins = np.sort(np.concatenate([before[:-1], missing + 1]), kind="stable")
                runs = np.append(begins - np.searchsorted(missing, begins), len(ids)).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(runs), ids), " ")
                lacks = np.searchsorted(missing, before)
                texts = pa.ListArray.from_arrays(pa.array((lacks + np.arange(len(before))).astype(np.int32)), joined)
                bytes_of = [parts(w, met) for w in words.take(pa.array(missing)).to_pylist()]
                lacking = pa.ListArray.from_arrays(pa.array(lacks.astype(np.int32)), pa.array(bytes_of, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), texts, lacking], names=["doc_id", "joined", "lacking"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(alone(run), f"doc_id {kind}, joined array<string>, lacking array<array<string>>")
    folded = with_ranks(ranks, lambda r: F.transform("lacking", lambda w: F.array_join(F.transform(w, lambda name: merged(name, r)), " ")))
    both = F.flatten(F.zip_with("joined", folded, lambda a, b: F.array(a, b)))
    return rows.select("doc_id", F.array_join(F.filter(both, lambda x: F.length(x) > 0), " ").alias("ids"))


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of ids in decimal: their pieces, joined."""
    pieces: list[str] = [""] * (max(vocabulary.ranks.values()) + 1)
    for token, rank in vocabulary.ranks.items():
        pieces[rank] = token.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")
    joined = F.array_join(F.transform(F.split(ids, " "), lambda x: F.get(literal, x.cast("int"))), "")
    return F.unhex(F.when(ids == "", "").otherwise(joined))


def tokenize(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(" "))) + 1)
    return encoded(docs, vocabulary).select(
        "doc_id", n.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids"), vocabulary), 256).alias("decoded_sha256")
    )
