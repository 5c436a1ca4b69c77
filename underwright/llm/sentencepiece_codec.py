"""SentencePiece encoding and decoding by suffix-array matching.

Different words of a batch of texts are laid out as one text and its suffixes are sorted by as many characters as the
longest piece has. Every piece is binary-searched: its occurrences are one range of the suffix array, and each is an edge
from its first character to its end. Edges are sorted by the place where they end and relaxed from left to right.

The model is a BPE model, so the sum of scores doesn't decide, but the order of merges does: an edge extends the encoding of
what stands before it if no merge across the seam would have come first. Exactly one edge passes at each place, so its
result is what the merges give. Pieces don't cross word starts, so words are encoded apart.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.llm.common import pieces, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")
#: Bytes of text that are encoded at once, one text at least, and words of it.
AT_ONCE, AT_ONCE_WORDS = 2 << 20, 500_000
#: Characters of different words that are matched at once, one word at least, and different words that a worker remembers.
RUN_CHARS, MOST_WORDS = 1 << 18, 500_000
NEVER = np.int64(2**40)
WIDE = 2**32
ENCODED = "doc_id long, n_chars long, n_tokens long, ids array<int>"
ROUND_TRIP = "doc_id long, n_chars long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"


def merged(text: str, rank: dict[str, int]) -> list[tuple[str, str]]:
    """The merges that plain BPE makes of ``text``, in order."""
    parts, made = list(text), []
    while True:
        found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        if not found:
            return made if len(parts) == 1 else []
        k = min(found)[1]
        made.append((parts[k], parts[k + 1]))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


class Vocabulary:
    """The tables that matching needs, from a model file's bytes."""

    def __init__(self, model: bytes):
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = n = p.get_piece_size()
        names = [p.id_to_piece(k) for k in range(n)]
        normal = [k for k in range(n) if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k) or p.is_unused(k))]
        ids = {names[k]: k for k in normal}
        merges = sorted((k for k in normal if len(names[k]) > 1), key=lambda k: (-p.get_score(k), k))
        rank = {names[k]: r for r, k in enumerate(merges)}
        self.rank = np.full(n + 1, -1, np.int64)  # characters are there before all merges; the last entry is any unknown character
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.length = np.ones(n + 1, np.int64)
        matched = []
        for name, k in ids.items():
            self.length[k] = len(name)
            if len(name) == 1:
                matched.append(k)
                continue
            self.rank[k] = rank[name]
            if made := merged(name, rank):  # others are never the result of merges
                self.left[k], self.right[k] = ids[made[-1][0]], ids[made[-1][1]]
                matched.append(k)
        splits = [(ids[name[:c]] * WIDE + ids[name[c:]], rank[name]) for name in rank for c in range(1, len(name)) if name[:c] in ids and name[c:] in ids]
        splits.sort()
        self.pairs = np.array([s for s, _ in splits] + [2**62], np.int64)
        self.pair_rank = np.array([r for _, r in splits] + [NEVER], np.int64)
        chars = sorted({c for name in ids for c in name})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.pieces = np.array(matched)
        self.depth = max(len(names[k]) for k in matched)
        if self.depth > 63:
            raise ValueError("pieces of more than 63 characters")
        self.low, self.high = self.bounds([names[k] for k in matched])
        byte = {bytes([b]): p.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.byte_ids = byte if all(p.is_byte(k) for k in byte.values()) else None
        self.bytes_of = [b"" if p.is_control(k) else " ⁇ ".encode() if p.is_unknown(k) else bytes([int(names[k][3:5], 16)]) if p.is_byte(k) else names[k].replace(SPACE, " ").encode() for k in range(n)]

    def bounds(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first and of the place after the last suffix that begin with each name."""
        table = np.zeros((len(names), 4 * math.ceil(self.depth / 4)), np.uint64)
        upper = np.full_like(table, 0xFFFF)
        for k, name in enumerate(names):
            table[k, : len(name)] = upper[k, : len(name)] = self.code[[ord(c) for c in name]]
        return packed(table), packed(upper)

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte_ids[bytes([b])] for b in char.encode()] if self.byte_ids else [self.processor.unk_id()]


def packed(codes: np.ndarray) -> np.ndarray:
    """Four 16-bit codes to a number, so that numbers sort as the codes do."""
    shifts = np.array([48, 32, 16, 0], np.uint64)
    return (codes.reshape(len(codes), -1, 4) << shifts).sum(axis=2, dtype=np.uint64)


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def seam_holds(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the merges leave a seam between the pieces a and b.

    Undo the merges at the seam, latest first. Between two of them the pieces next to the seam could merge with each other;
    the seam is gone if that merge ranks before the one that was undone (or is equal to one on the right, as merges go from the left).
    """
    holds = np.ones(len(a), bool)
    at, limit = np.arange(len(a)), np.full(len(a), 2 * NEVER)
    while len(at):
        found = np.searchsorted(v.pairs, a * WIDE + b)
        rank = np.where(v.pairs[found] == a * WIDE + b, v.pair_rank[found], NEVER)
        gone = 2 * rank < limit
        holds[at[gone]] = False
        made_a, made_b = v.rank[a], v.rank[b]
        go = ~gone & ((made_a >= 0) | (made_b >= 0))
        at, a, b, made_a, made_b = at[go], a[go], b[go], made_a[go], made_b[go]
        last_b = made_b >= made_a
        limit = np.where(last_b, 2 * made_b + 1, 2 * made_a)
        a, b = np.where(last_b, a, v.right[a]), np.where(last_b, v.left[b], b)
    return holds


def suffix_order(four: np.ndarray, words: int) -> np.ndarray:
    """Suffix array by the first ``4 * words`` characters: ranks of the first four, then of twice as many each time."""
    order, key, width = np.argsort(four), four, 1
    while width < words:
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        key = rank << 32
        key[: -4 * width] |= rank[4 * width :]
        order, width = np.argsort(key), 2 * width
    return order


def occurrences(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece) of every occurrence of every piece, by binary search in the suffix array."""
    n, words = len(codes), math.ceil(v.depth / 4)
    padded = np.concatenate((codes.astype(np.uint64), np.zeros(4 * words + 4, np.uint64)))
    four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
    keys = [four[4 * k : 4 * k + n] for k in range(words)]
    suffixes = suffix_order(keys[0], words)
    suffixes = suffixes[codes[suffixes] > 0]

    def search(wanted: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(suffixes), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            place = suffixes[np.minimum(middle, len(suffixes) - 1)]
            less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
            for k in range(words):
                own = keys[k][place]
                less |= same & (own < wanted[:, k])
                same &= own == wanted[:, k]
            less = (less | same if after else less) & open_
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    first, last = search(v.low, False), search(v.high, True)
    count = last - first
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return suffixes[at], np.repeat(v.pieces, count)


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after the other, and their number per word."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - (length + 1)  # a gap after each word keeps matches inside
    chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(chars)) + word
    codes = np.zeros(int((length + 1).sum()), np.uint16)
    codes[place] = v.code[chars]
    begin = np.zeros(len(codes), np.int64)
    begin[place] = start[word]
    unknown = place[codes[place] == 0]
    at, piece = occurrences(v, codes)
    at, piece = np.concatenate((at, unknown)), np.concatenate((piece, np.full(len(unknown), v.size)))
    end = at + v.length[piece]
    # by distance from the word's begin, then by end, the longest first: one sort of packed numbers, one stable sort by distance
    bits = v.size.bit_length()
    packs = np.sort((end * 64 + (63 - v.length[piece])) << bits | piece)
    piece = packs & ((1 << bits) - 1)
    end = packs >> (bits + 6)
    at = end - v.length[piece]
    step = end - begin[at]
    order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
    at, piece, end, step = at[order], piece[order], end[order], step[order]
    new = np.ones(len(end), bool)
    new[1:] = end[1:] != end[:-1]
    nth = np.arange(len(end)) - np.maximum.accumulate(np.where(new, np.arange(len(end)), 0))  # candidates of one end, longest first
    edges = np.searchsorted(step, np.arange(int(step.max(initial=0)) + 2))
    last = np.full(len(codes), -1, np.int64)
    for k in range(1, len(edges) - 1):
        here = slice(edges[k], edges[k + 1])
        for n in range(int(nth[here].max(initial=-1)) + 1):
            pick = edges[k] + np.flatnonzero((nth[here] == n) & (last[end[here]] < 0))
            before = np.where(at[pick] == begin[at[pick]], -2, last[at[pick]])
            fits = before == -2
            check = np.flatnonzero(before >= 0)
            fits[check] = seam_holds(v, before[check], piece[pick[check]])
            last[end[pick[fits]]] = piece[pick[fits]]
    found, node, left = [], start + length, np.flatnonzero(length > 0)
    while len(left):
        token = last[node[left]]
        if (token < 0).any():
            raise AssertionError("a word has no encoding")
        found.append((left, token, node[left] - 1))
        node[left] -= v.length[token]
        left = left[node[left] > start[left]]
    owner = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
    token = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
    where = np.concatenate([f[2] for f in found] or [np.zeros(0, np.int64)])
    order = np.argsort(where)  # places grow with the words
    owner, token, where = owner[order], token[order], where[order]
    spelled = np.flatnonzero(token == v.size)
    copies = np.ones(len(token), np.int64)
    back = np.zeros(len(codes), np.int64)
    back[place] = np.arange(len(chars))
    own = [v.unknown_ids(chr(chars[back[where[s]]])) for s in spelled]
    copies[spelled] = [len(x) for x in own]
    out = np.repeat(token, copies)
    out[out == v.size] = [x for ids in own for x in ids]
    return out.astype(np.int32), np.bincount(np.repeat(owner, copies), minlength=len(words))


class Words:
    """Ids of words that were met. New words are matched in runs of bounded length; beyond ``most_words`` the table starts anew."""

    def __init__(self, v: Vocabulary, most_words: int | None = None):
        self.v = v
        self.most_words = MOST_WORDS if most_words is None else most_words
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def match(self) -> None:
        """Ids of the words that have a number and no ids yet."""
        runs, size = [[]], 0
        for word in islice(self.number, len(self.count), None):
            if runs[-1] and size + len(word) > RUN_CHARS:
                runs.append([])
                size = 0
            runs[-1].append(word)
            size += len(word) + 1
        found = [encode_words(self.v, run) for run in runs if run]
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.count = np.concatenate([self.count, *(count for _, count in found)])

    def ids_of(self, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers one after the other, and their number per word."""
        self.match()
        start = np.cumsum(self.count) - self.count
        words = np.array(order, np.int64)
        lengths = self.count[words]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(start[words], lengths)
        out = self.ids[at], lengths
        if len(self.number) > self.most_words:
            self.clear()
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and their number per text."""
        found, count, order, owner = [], np.zeros(len(texts), np.int64), [], []

        def flush() -> None:
            ids, lengths = self.ids_of(order)
            found.append(ids)
            count[:] += np.bincount(np.repeat([k for k, _ in owner], [n for _, n in owner]).astype(np.int64), lengths, len(texts)).astype(np.int64)
            order.clear()
            owner.clear()

        for k, text in enumerate(texts):
            for words in word_lists(self.v.processor.Normalize(text)) if text else ():
                number = self.number
                order.extend([number.setdefault(w, len(number)) for w in words])
                owner.append((k, len(words)))
                if len(order) >= AT_ONCE_WORDS:
                    flush()
        flush()
        return np.concatenate(found), count


def word_lists(text: str) -> Iterator[list[str]]:
    """The words of a normalised text, those of a long one in parts."""
    if len(text) < RUN_CHARS:
        yield WORD.findall(text)
        return
    words = (m[0] for m in WORD.finditer(text))
    while part := list(islice(words, AT_ONCE_WORDS)):
        yield part


@lru_cache(maxsize=1)
def known_words(model: bytes, most_words: int | None = None) -> Words:
    """The table of a worker, which later tasks go on with."""
    return Words(vocabulary(model), most_words)


def encode_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after the other, and their number per text."""
    return Words(v).encode(texts)


def decode(v: Vocabulary, ids: Sequence[int]) -> str:
    """Text of token ids; the space that the encoder puts before a text is taken off."""
    parts = (b"".join(map(v.bytes_of.__getitem__, ids[k : k + AT_ONCE_WORDS])) for k in range(0, len(ids), AT_ONCE_WORDS))
    text = b"".join(parts).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _encoded(model: bytes, decoded: bool, most_words: int | None = None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words(model, most_words)
        v = words.v
        for batch in batches:
            for part in pieces(batch, "text", AT_ONCE):
                texts = part.column("text").to_pylist()
                ids, count = words.encode(texts)
                ends = np.concatenate(([0], np.cumsum(count)))
                columns = [part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(count, pa.int64()), pa.ListArray.from_arrays(ends.astype(np.int32), ids)]
                names = ["doc_id", "n_chars", "n_tokens", "ids"]
                if decoded:
                    back = (decode(v, ids[a:b]) for a, b in zip(ends, ends[1:], strict=False))
                    checks = [(hashlib.sha256(t.encode()).hexdigest(), t == text) for t, text in zip(back, texts, strict=True)]
                    columns += [pa.array([c[k] for c in checks], kind) for k, kind in enumerate((pa.string(), pa.bool_()))]
                    names += ["decoded_sha256", "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return encode


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, decoded: bool = False,
                     most_words: int | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids of every whole text; with ``decoded`` also what the ids decode to, as a digest, and whether that is the text.

    Null texts count as empty, and empty texts have no ids. Characters that no piece has become byte pieces. A text that holds U+2581 itself
    decodes with spaces there, as the format has it. Repeated rows and null ids stay; empty tables give
    empty results; other columns aren't read. No shuffle. Words are matched in runs of ``RUN_CHARS`` characters and their ids
    remembered, so memory is bounded by the longest text with its ids and the longest word. Models with pieces of over 63 characters are refused.
    A worker remembers ``most_words`` different words (``MOST_WORDS`` if not given); fewer take less memory and more time, with the same ids.
    The driver reads the model file, whose bytes go to the tasks.
    """
    with open(model, "rb") as file:
        data = file.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_encoded(data, decoded, most_words), ROUND_TRIP if decoded else ENCODED)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id and text of token ids; null ids count as none."""
    with open(model, "rb") as file:
        data = file.read()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(data)
        for batch in batches:
            texts = [decode(v, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decoded, "doc_id long, text string")
