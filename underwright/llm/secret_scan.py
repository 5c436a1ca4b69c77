"""Secret scan: keyword automaton, anchored expressions near its hits, embedded checksums.

One Aho-Corasick pass over the lower-cased text finds keywords; an expression is tried only where a keyword begins. Runs of
hex digits have no keyword: a run of 32 covers a place whose number is a multiple of 32, so only those places are
looked at. Tokens that carry a checksum count only if it is right.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.llm.common import text_or_empty

#: Fixed values of the base kinds: expression, and the least length of the secret.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
BASE = ("assign", "access", "hex")
#: Added kinds: tokens with an embedded CRC-32 in base 62, web tokens with a header that decodes, private keys.
CHECKED = re.compile(r"(?:gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WEB = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
#: Where WEB fails at a place, it fails at all places of the run of these characters, as its first part ends with the run.
WEB_RUN = re.compile(r"[A-Za-z0-9_-]*")
KINDS = (*BASE, "checked", "web", "key")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "web": ("eyj",), "key": ("-----begin ",)}
    for kind, words in kinds.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def checksum_holds(match: re.Match) -> bool:
    crc, digits = zlib.crc32(match[1].encode()), ""
    while crc:
        crc, digit = divmod(crc, 62)
        digits = BASE62[digit] + digits
    return match[2] == digits.rjust(6, "0")


def header_decodes(match: re.Match) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


#: Expression and test of each kind that has keywords.
TESTS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= LEAST_ASSIGN),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST_ACCESS),
    "checked": (CHECKED, checksum_holds),
    "web": (WEB, header_decodes),
    "key": (KEY, lambda m: True),
}


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Whole runs of hex digits of the least length."""
    out, end = [], 0
    for k, char in enumerate(text[LEAST_HEX - 1 :: LEAST_HEX], 1):
        at = k * LEAST_HEX - 1
        if at >= end and char in "0123456789abcdef":
            start = at
            while start > end and text[start - 1] in "0123456789abcdef":
                start -= 1
            end = HEX.match(text, at).end()
            if end - start >= LEAST_HEX:
                out.append((start, end))
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all secrets in order; matches of a kind don't overlap."""
    spans = [(start, KINDS.index("hex"), end) for start, end in hex_runs(text)]
    taken = dict.fromkeys(TESTS, 0)
    hits = sorted((last - length + 1, kind) for last, (kind, length) in automaton().iter(lowered(text)))
    for start, kind in hits:
        expression, holds = TESTS[kind]
        if start < taken[kind]:
            continue
        if match := expression.match(text, start):
            taken[kind] = match.end()
            if holds(match):
                spans.append((start, KINDS.index(kind), match.end()))
        elif kind == "web":
            taken[kind] = WEB_RUN.match(text, start).end()
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [scan(text) for text in batch.column("text").to_pylist()]
        counts = [pa.array([sum(kind == n for _, kind, _ in s) for s in spans], pa.int64()) for n in range(len(BASE))]
        digests = [hashlib.sha256(listed([x for x in s if x[1] < len(BASE)]).encode()).hexdigest() for s in spans]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(listed, spans), pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans (code points, end exclusive) of the secrets in every whole text; no shuffle.

    Null texts count as empty and have no spans. Null ids and repeated rows stay as they are. Empty tables give
    empty results; other columns aren't read. Memory is bounded by Arrow's batch size and the longest text; time is
    linear in the text, whatever it repeats.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_scanned, SCHEMA)
