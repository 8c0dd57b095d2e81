"""Unigram tokenization: Viterbi over a double-array trie of pieces with log scores.

White space is written as a marker that pieces may begin with; characters without a piece fall back to byte
pieces. Decoding joins pieces, turns markers into spaces and bytes into text, so the round trip is exact: a marker
character that the text itself holds is encoded in bytes.

No piece of the vocabularies used here has a marker after another character, so that the best path of a text is the best
paths of its words, and the words of a batch are solved side by side: one numpy step per place and depth. Vocabularies
for which this does not hold are searched text by text with the same trie.

The trie and scores are built on the driver from the vocabulary file and sent to the executors; their size is that of the vocabulary.

Defined cases: null and empty texts have no tokens; texts of any length are encoded whole; repeated rows are equal; ties go to the
path whose last piece is longest; a character without piece in a vocabulary without byte pieces becomes the unknown piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHES, claim, give_back

MARK = "▁"
PIECE = 1 << 20  # characters that are cut into words at once
WIDE = 40  # bytes of the longest word that is solved side by side
NONE = -1e18


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of state s by byte c is base[s] + c + 1 if check there is s; value is a key's number or -1."""
    root: dict = {}
    for n, key in enumerate(keys):
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = n
    size = 1 << 12
    base, check, value = (np.full(size, -1, np.int32) for _ in range(3))
    taken = bytearray(size)
    taken[0] = 1
    free, last, queue = 1, 0, [(0, root)]
    for state, node in queue:
        value[state] = node.get(-1, -1)
        codes = sorted(c + 1 for c in node if c >= 0)
        if not codes:
            base[state] = 0
            continue
        while free < size and taken[free]:
            free += 1
        b, tries = max(0, free - codes[0]), 0  # after a few tries, behind all that is taken
        while True:
            while b + 258 >= size:
                grow = size
                base, check, value = (np.append(x, np.full(grow, -1, np.int32)) for x in (base, check, value))
                taken.extend(bytes(grow))
                size += grow
            if not any(taken[b + c] for c in codes):
                break
            b, tries = (b + 1, tries + 1) if tries < 200 else (last + 1, 0)
        base[state] = b
        last = max(last, b + codes[-1])
        for c in codes:
            taken[b + c] = 1
            check[b + c] = state
            queue.append((b + c, node[c - 1]))
    end = last + 258
    return base[:end], check[:end], value[:end]


@dataclass
class Unigram:
    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: list[int]  # of the 256 bytes, or empty
    unknown: int
    special: set[int] = field(default_factory=set)
    base: np.ndarray = None
    check: np.ndarray = None
    value: np.ndarray = None
    unk_score: float = 0.0
    by_word: bool = True
    key: str = ""

    def __post_init__(self) -> None:
        skip = self.special | set(self.byte_ids) | {self.unknown}
        used = [i for i in range(len(self.pieces)) if i not in skip and self.pieces[i]]
        self.base, self.check, value = double_array([self.pieces[i] for i in used])
        self.value = np.where(value >= 0, np.array(used + [0], np.int32)[value], -1).astype(np.int32)
        self.unk_score = float(min(self.scores[used], default=0.0)) - 10.0
        mark = MARK.encode()
        bare = [_bare(self.pieces[i], mark) for i in used]
        self.by_word = not any(mark in p for p in bare) and not any(b"\n" in self.pieces[i] and len(self.pieces[i]) > 1 for i in used)


def _bare(piece: bytes, mark: bytes) -> bytes:
    while piece.startswith(mark):
        piece = piece[len(mark) :]
    return piece


def load(path: str, ranked: bool | None = None) -> Unigram:
    """A SentencePiece model file. Where its scores are merge ranks rather than log probabilities (BPE models), the log
    probability of the piece of rank r is taken as log(1 / (r + 2)), normalised: Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces, special, byte_ids = [], set(), {}
    scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
    for i in range(n):
        p = sp.id_to_piece(i)
        pieces.append(p.encode())
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        elif sp.is_control(i) or sp.is_unused(i):
            special.add(i)
    if ranked is None:
        ranked = bool(scores.min() < -1000)
    if ranked:
        scores = -np.log(-scores + 2)
        scores -= math.log(np.exp(scores).sum())
    return Unigram(pieces, scores, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [], sp.unk_id(), special, key=path)


def width(first: int) -> int:
    """Bytes of the UTF-8 character that begins with this byte."""
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def solve_one(m: Unigram, word: bytes, literal: bool = False) -> list[int]:
    """Best path of any string. ``literal``: the word is a marker that the text itself holds."""
    if literal:
        return [m.byte_ids[b] for b in word] if m.byte_ids else [m.unknown]
    n = len(word)
    best, back, by = [NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = m.base, m.check, m.value, m.scores
    for i in range(n):
        if best[i] == NONE:
            continue
        state, end, single = 0, i + width(word[i]), False
        for j in range(i, n):
            nxt = int(base[state]) + word[j] + 1
            if nxt >= len(check) or check[nxt] != state:
                break
            state = nxt
            v = int(value[state])
            if v >= 0:
                s = best[i] + scores[v]
                single |= j + 1 == end
                if s > best[j + 1]:
                    best[j + 1], back[j + 1], by[j + 1] = s, i, v
        if not single and best[i] + m.unk_score > best[min(end, n)]:
            best[min(end, n)], back[min(end, n)], by[min(end, n)] = best[i] + m.unk_score, i, -1
    out, at = [], n
    while at:
        out.append((back[at], at, by[at]))
        at = back[at]
    ids = []
    for a, b, v in reversed(out):
        ids += [v] if v >= 0 else [m.byte_ids[x] for x in word[a:b]] if m.byte_ids else [m.unknown]
    return ids


def solve_many(m: Unigram, words: list[bytes]) -> list[bytes]:
    """Best paths of many short words, as int32 ids in bytes; words of one length at a time, side by side."""
    out: list[bytes] = [b""] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) <= WIDE:
            by_length.setdefault(len(w), []).append(i)
        else:
            out[i] = np.array(solve_one(m, w), np.int32).tobytes()
    top = len(m.check) - 1
    for n, every in by_length.items():
        if not n:
            continue
        for start in range(0, len(every), 1 << 15):
            rows = every[start : start + (1 << 15)]
            text = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), n).astype(np.int32)
            k = len(rows)
            best = np.full((n + 1, k), NONE)
            best[0] = 0
            back, by = np.zeros((n + 1, k), np.int16), np.full((n + 1, k), -1, np.int32)
            long = np.select([text < 0x80, text < 0xE0, text < 0xF0], [1, 2, 3], 4)
            for i in range(n):
                at = np.nonzero(best[i] > NONE / 2)[0]
                if not len(at):
                    continue
                state, here, single, whole = np.zeros(len(at), np.int32), at, np.zeros(k, bool), at
                for j in range(i, n):
                    nxt = m.base[state] + text[here, j] + 1
                    np.minimum(nxt, top, out=nxt)
                    ok = m.check[nxt] == state
                    here, state = here[ok], nxt[ok]
                    if not len(here):
                        break
                    v = m.value[state]
                    hit = v >= 0
                    h, u = here[hit], v[hit]
                    single[h[long[h, i] == j + 1 - i]] = True
                    s = best[i, h] + m.scores[u]
                    up = s > best[j + 1, h]
                    h, u = h[up], u[up]
                    best[j + 1, h], back[j + 1, h], by[j + 1, h] = s[up], i, u
                lone = whole[~single[whole]]
                if len(lone):
                    end = np.minimum(i + long[lone, i], n)
                    s = best[i, lone] + m.unk_score
                    up = s > best[end, lone]
                    lone, end = lone[up], end[up]
                    best[end, lone], back[end, lone], by[end, lone] = s[up], i, -1
            back_rows, by_rows = back.T.tolist(), by.T.tolist()
            for r, i in enumerate(rows):
                p, b, at, ids = back_rows[r], by_rows[r], n, []
                while at:
                    v = b[at]
                    if v >= 0:
                        ids.append(v)
                    elif m.byte_ids:
                        ids += [m.byte_ids[x] for x in reversed(words[i][p[at] : at])]
                    else:
                        ids.append(m.unknown)
                    at = p[at]
                ids.reverse()
                out[i] = np.array(ids, np.int32).tobytes()
    return out


WORDS = re.compile(f"\n| +[^ \n{MARK}]*|[^ \n{MARK}]+|{MARK}")
CACHE: dict[str, dict[str, bytes]] = {}
CACHES.append(CACHE)
MOST = 600_000  # words that a worker remembers


def pieces_of(text: str) -> Iterator[str]:
    """The text after its leading marker, cut where no piece can span: before a space that follows another character."""
    text, at = " " + text, 0
    while at < len(text):
        end = text.find(" ", at + PIECE)
        while end > 0 and text[end - 1] == " ":
            end = text.find(" ", end + 1)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def encode(m: Unigram, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of each text."""
    if not m.by_word:
        out = []
        for t in texts:
            ids: list[int] = []
            for part in re.split(f"({MARK})", " " + t) if t else []:
                ids += solve_one(m, part.replace(" ", MARK).encode(), part == MARK)
            out.append(np.array(ids, np.int32))
        return out
    known = CACHE.setdefault(m.key, {})
    out = []
    for t in texts:
        got = []
        for part in pieces_of(t) if t else ():
            words = WORDS.findall(part)
            new = list(set(words).difference(known))
            if new:
                if len(known) + len(new) > MOST:
                    known.clear()
                    new = list(set(words))
                plain = [w for w in new if w != MARK]
                known.update(zip(plain, solve_many(m, [w.replace(" ", MARK).encode() for w in plain]), strict=True))
                known[MARK] = np.array(solve_one(m, MARK.encode(), True), np.int32).tobytes()
            got.append(b"".join(map(known.__getitem__, words)))
        out.append(np.frombuffer(b"".join(got), np.int32))
    return out


def learn(m: Unigram, texts: list[str | None]) -> None:
    """Solve the unseen words of many texts at once, so that ``encode`` finds them."""
    if not m.by_word:
        return
    known, new = CACHE.setdefault(m.key, {}), set()
    for t in texts:
        for part in pieces_of(t) if t else ():
            new.update(WORDS.findall(part))
    new = [w for w in new.difference(known) if w != MARK]
    if len(known) + len(new) > MOST:
        known.clear()
    known.update(zip(new, solve_many(m, [w.replace(" ", MARK).encode() for w in new]), strict=True))
    known[MARK] = np.array(solve_one(m, MARK.encode(), True), np.int32).tobytes()


def surface(m: Unigram) -> list[bytes]:
    """What each id decodes to."""
    out = [p.replace(MARK.encode(), b" ") for p in m.pieces]
    for b, i in enumerate(m.byte_ids):
        out[i] = bytes([b])
    for i in m.special:
        out[i] = b""
    if m.byte_ids or m.unknown not in m.special:
        out[m.unknown] = b" \xe2\x81\x87 "
    return out


def decode(table: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(table.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def tokenize(docs: DataFrame, model: Unigram, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, round_trip, ids): ``round_trip`` says whether decoding gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(CACHE)
        m = shared.value
        table = surface(m)
        for b in batches:
            at, texts = 0, b.column(1)
            while at < b.num_rows:
                some, size = [], 0
                while at + len(some) < b.num_rows and size < 2 * PIECE:
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1] or "") + 100
                if size < 4 * PIECE:
                    learn(m, some)
                ids = encode(m, some)
                same = [decode(table, x) == (t or "") for x, t in zip(ids, some, strict=True)] if check else [None] * len(some)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(some)), pa.array(np.diff(ends).astype(np.int64)), pa.array(same, pa.bool_()), lists], names=["doc_id", "n_tokens", "round_trip", "ids"]
                )
                at += len(some)
        give_back()

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, round_trip boolean, ids array<int>")
