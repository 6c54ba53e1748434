r"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pre-tokens with the tokenizer's pattern. All pre-tokens of a lot that the task's cache lacks lie one after the
other in one array of symbols, linked to their neighbours. An index maps the rank of each pair to all its positions.
The ranks that occur are applied in ascending order: all occurrences of a pair are merged in one step and the lists
of the pairs that this makes are extended. Each text's ids are then gathered from those of its pre-tokens.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import arrow_columns

#: Fixed value: the pattern of byte-level tokenizers that cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as that pattern's \s has it; Python's \s also has \x1c-\x1f.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Up to this letter the Unicode tables of all libraries agree; beyond it the tokenizer's own splitter is asked.
_PLAIN = re.compile("[\x00-\u052f]*")
#: Pieces that no pre-token crosses, for texts that are not plain.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Pre-tokens that a task keeps from text to text, and characters of these (scripts without spaces have long ones).
CACHE_SIZE, CACHE_CHARS = 1 << 17, 1 << 21
#: Characters that are split at a time: the pre-tokens of a lot are the most that a worker holds beside its cache.
LOT_CHARS = 1 << 20
#: Bytes of a batch: texts, ids and decoded texts of one are held together.
BATCH_BYTES = 2 << 20


def _plain_pattern() -> re.Pattern:
    """PATTERN for plain texts, with its classes written out: the standard engine is several times as fast."""
    plain = [chr(c) for c in range(0x530)]

    def of(kind: str) -> str:
        runs: list[list[int]] = []
        for c in map(ord, regex.findall(kind, "".join(plain))):
            if runs and c == runs[-1][1] + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)

    letters, digits = of(r"\p{L}"), of(r"\p{N}")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{_WS}{letters}{digits}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next free code from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id, ids of single bytes, and the merges as sorted pair keys with ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


class PairIndex:
    """rank -> positions of the left symbols of its pair, with a heap of the ranks that have any."""

    def __init__(self):
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, at: np.ndarray) -> None:
        known = ranks >= 0
        ranks, at = ranks[known], at[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = ranks[np.concatenate(([0], cuts))].tolist()
        ends = [*cuts.tolist(), len(at)]
        begin = 0
        for rank, end in zip(firsts, ends):
            part = at[begin:end]
            begin = end
            if rank in self.lists:
                self.lists[rank].append(part)
            else:
                self.lists[rank] = [part]
                heapq.heappush(self.active, rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        parts = self.lists.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.concatenate(parts)


def merge_all(parts: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts one after the other, and where each part begins (one more for the end)."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    symbols = vocab.of_byte[data].astype(np.int32)
    after = np.arange(1, n + 1, dtype=np.int32)
    after[ends[sizes > 0] - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    begins = (ends - sizes)[sizes > 0]
    before[begins] = -1
    live = np.ones(n, bool)
    index = PairIndex()
    left = np.flatnonzero(after >= 0)
    index.add(vocab.ranks(symbols[left], symbols[left + 1]), left)
    while index.active:
        rank, at = index.pop()
        a, b, made = vocab.left[rank], vocab.right[rank], vocab.made[rank]
        nxt = after[at]
        held = live[at] & (nxt >= 0) & (symbols[at] == a)
        at, nxt = at[held], nxt[held]
        held = symbols[nxt] == b
        at, nxt = at[held], nxt[held]
        if not len(at):
            continue
        if a == b:
            # Runs of one symbol: merge the first two, the next two and so on, from the left.
            at = np.sort(at)
            nxt = after[at]
            follows = np.concatenate(([False], at[1:] == nxt[:-1]))
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at, nxt = at[run % 2 == 0], nxt[run % 2 == 0]
        symbols[at] = made
        live[nxt] = False
        beyond = after[nxt]
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        prior = before[at]
        new = np.sort(np.concatenate((at[linked], prior[prior >= 0])))
        new = new[np.concatenate((new[:1] >= 0, new[1:] != new[:-1]))]
        index.add(vocab.ranks(symbols[new], symbols[after[new]]), new)
    count = np.concatenate(([0], np.cumsum(live)))
    return symbols[live].astype(np.uint32), count[np.concatenate(([0], ends))]


class Encoder:
    """Encodes texts in lots and keeps the ids of up to CACHE_SIZE pre-tokens of CACHE_CHARS characters, or those of one lot."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.split = _plain_pattern().findall
        special = sorted(self.vocab.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.path, self.library = path, None
        self.cache: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.cache = {c: np.array([i], "<u4").tobytes() for c, i in self.vocab.special.items()}
        self.chars = 0

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token's string is one."""
        if self.specials is not None and self.specials.search(text):
            return [t for part in self.specials.split(text) for t in ([part] if part in self.vocab.special else self.pre_tokens(part))]
        if _PLAIN.fullmatch(text):
            return self.split(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        out: list[str] = []
        for chunk in _CHUNK.findall(text):
            out += self.split(chunk) if _PLAIN.fullmatch(chunk) else [chunk[i:j] for _, (i, j) in self.library.pre_tokenize_str(chunk)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, made in lots of LOT_CHARS characters of whole texts."""
        out: list[bytes] = []
        begin = held = 0
        for i, text in enumerate(texts):
            held += len(text)
            if held > LOT_CHARS or i + 1 == len(texts):
                out += self._encode_lot(texts[begin : i + 1])
                begin, held = i + 1, 0
        return out

    def _encode_lot(self, texts: list[str]) -> list[bytes]:
        split = [self.pre_tokens(t) for t in texts]
        used = set().union(*split)
        new = list(used - self.cache.keys())
        if len(self.cache) + len(new) > CACHE_SIZE or self.chars + sum(map(len, new)) > CACHE_CHARS:
            self.forget()
            new = list(used - self.cache.keys())
        self.chars += sum(map(len, new))
        ids, begins = merge_all([t.encode() for t in new], self.vocab)
        raw, cut = ids.astype("<u4").tobytes(), (begins * 4).tolist()
        self.cache.update((t, raw[i:j]) for t, i, j in zip(new, cut, cut[1:]))
        return [b"".join(map(self.cache.__getitem__, s)) for s in split]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process, which serves many tasks."""
    return Vocabulary(path)


def decoded_text(ids: bytes, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """`docs` with `ids` (the ids as little-endian unsigned 32-bit integers, one binary cell) and `n_tokens`.

    Ids are those of the tokenizers library without added special tokens; a special token's string inside a text is
    that token. A null or empty text has no ids. Whole texts; rows stay one for one; input columns named ids or
    n_tokens are replaced. With `decoded`, a column of that name has the ids decoded again, as `decode` does, in the
    same pass. The path must hold on executors too.
    """
    names = [("ids", T.BinaryType()), ("n_tokens", T.LongType())] + [(decoded, T.StringType())] * bool(decoded)

    def start():
        own = Encoder(tokenizer_path)

        def work(texts):
            ids = own.encode([t.as_py() or "" for t in texts])
            made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            return made + ([pa.array([decoded_text(x, own.vocab.token_bytes) for x in ids], pa.string())] if decoded else [])

        return work

    return arrow_columns(docs, [text_col], [T.StructField(n, t) for n, t in names], start, BATCH_BYTES)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """`df` with the text of `ids_col` in `to`, special tokens included; bytes that are no UTF-8 become U+FFFD.

    Null ids give an empty text; an id outside the vocabulary is an error. Rows stay one for one; an input column named as
    `to` is replaced.
    """

    def start():
        table = vocabulary(tokenizer_path).token_bytes

        def work(cells):
            return [pa.array([decoded_text(c.as_py() or b"", table) for c in cells], pa.string())]

        return work

    return arrow_columns(df, [ids_col], [T.StructField(to, T.StringType())], start)
