r"""Secret scan: patterns for known kinds, and a token-efficiency test for strings that no pattern knows.

A string of letters, digits and `+/_=-` that a vocabulary of natural text cuts into many short tokens is random. It is
reported as kind `random` where its characters per token are below `MAX_RATIO`, unless it is made of known digests, words
and numbers (see `is_known`). Where a whole string is not random, each part of it between `+/_=-` is tested alone. Of a
string that a pattern's span overlaps, what the spans leave is tested. Spans are (kind, start, end) in code points, end
exclusive.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import arrow_columns
from .bpe import PATTERN

KINDS = ("assign", "access", "hex", "random")
#: Characters per token under which a string counts as random; prose has 4 and more, base64 of random bytes about 1.6.
MAX_RATIO = 2.2
#: Shortest string that the token-efficiency test takes.
MIN_RUN = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_HINTS = ("passw", "secret", "token", "api")
#: Every access key, hex string and candidate lies in one of these.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])")
_PART = re.compile(r"[A-Za-z0-9]+")
#: Letters between changes of case: `HTTPServer` is `HTTP` and `Server`.
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Share of a string's letters and digits that may be letters outside of words (the T of a time, the v of a version).
MAX_ODD = 0.2


def is_word(piece: str, encode, max_ratio: float = MAX_RATIO) -> bool:
    """Three letters and more that the vocabulary cuts into few tokens, as they are or in lower case."""
    return len(piece) >= 3 and any(len(piece) >= max_ratio * len(encode(p)) for p in {piece, piece.lower()})


def is_known(run: str, encode, max_ratio: float = MAX_RATIO) -> bool:
    """Known digests (hex of the usual sizes, UUIDs), and identifiers: words and plain numbers between `+/_=-` and changes
    of case, with few other letters."""
    rest = [p for p in _PART.findall(_UUID.sub("-", run)) if not (len(p) in _DIGEST_SIZES and _DIGEST.fullmatch(p))]
    size = sum(map(len, _PART.findall(run)))
    odd = sum(len(x) for p in rest for x in _PIECE.findall(p) if not is_word(x, encode, max_ratio))
    return odd <= MAX_ODD * size


def is_random(run: str, encode, max_ratio: float = MAX_RATIO) -> bool:
    return len(run) >= MIN_RUN and len(run) < max_ratio * len(encode(run)) and not is_known(run, encode, max_ratio)


def base_spans(text: str, low: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches that are long enough, leftmost and non-overlapping per kind."""
    found = []
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for i, j in runs:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, i, j) if m.end() - m.start() >= 16]
        if j - i >= 32:
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, i, j) if m.end() - m.start() >= 32]
    return sorted(found)


@lru_cache(maxsize=1)
def encoding(path: str):
    """The vocabulary at `path` (ranks); one for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def find(text: str, encode, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    runs = [m.span() for m in _RUN.finditer(text)]
    base = base_spans(text, text.lower(), runs)
    extra = []
    over, nxt = [], 0  # spans that begin before the run ends and may reach into it; runs are in order, as spans are
    for i, j in runs:
        over = [s for s in over if s[2] > i]
        while nxt < len(base) and base[nxt][0] < j:
            over += [base[nxt]] if base[nxt][2] > i else []
            nxt += 1
        # What the patterns' spans leave of the run.
        left, at = [], i
        for start, _, end in over:
            left.append((at, start))
            at = max(at, end)
        for x, y in [*left, (at, j)]:
            if is_random(text[x:y], encode, max_ratio):
                extra.append((x, 3, y))
            else:
                extra += [(m.start(), 3, m.end()) for m in _PART.finditer(text, x, max(x, y)) if is_random(m[0], encode, max_ratio)]
    return sorted(base + extra) if extra else base


def scan(docs: DataFrame, vocabulary_path: str, text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """`docs` with `secrets`, an array of (kind, start, end) by start, then kind as in KINDS.

    A null or empty text has none. Whole texts; rows stay one for one; an input column named secrets is replaced. The
    path must hold on executors too.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def start():
        encode = encoding(vocabulary_path).encode_ordinary

        def work(texts):
            out = [[{"kind": KINDS[k], "start": i, "end": j} for i, k, j in find(t.as_py() or "", encode, max_ratio)] for t in texts]
            return [pa.array(out, kind)]

        return work

    return arrow_columns(docs, [text_col], [T.StructField("secrets", T.ArrayType(span))], start)
