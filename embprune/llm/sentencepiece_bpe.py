r"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, with an agenda ordered by score.

A text is normalised as the model does (a space becomes U+2581, one more in front) and cut wherever no piece of the vocabulary
holds the two characters that meet, since no merge can cross such a place. Each different chunk is encoded once for each worker:
its adjacent pairs of symbols lie in an agenda by the score of the piece that they make, then by place; the best is taken and
merged, and the pairs that this makes are added. Characters that are no piece become bytes. Every lot of new chunks is also given
to the sentencepiece library, and a difference is an error.
"""

from __future__ import annotations

import codecs
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import arrow_columns

#: The library's sign for a space, its text for an unknown id, and how pieces of single bytes are written.
SPACE, UNKNOWN, BYTE = "▁", " ⁇ ", "<0x{:02X}>"
#: Chunks that a worker keeps from text to text, and characters of these; characters of a lot that the library checks at once.
CACHE_SIZE, CACHE_CHARS, CHECK_CHARS = 1 << 19, 1 << 23, 1 << 18
#: Between chunks of a checked lot: a character of private use, which a vocabulary must not have.
APART = "\ue000"
#: Characters up to which a chunk's agenda is a list.
SHORT = 64
_PLACE, NONE = (1 << 32) - 1, 1 << 62


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


#: As the library decodes bytes that are no UTF-8: U+FFFD for each.
codecs.register_error("each-byte", _each_byte)


class Vocabulary:
    """Pieces, the order of their scores, what each id decodes to, and which characters may lie side by side in a piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=path)
        probe = " a  Åﬁ\n　½ é "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models that keep characters as they are, with one space in front, are supported")
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        if any(map(model.is_unused, range(n))) or not all(model.piece_to_id(BYTE.format(b)) != model.unk_id() for b in range(256)):
            raise ValueError("only models with a piece for each byte and no unused pieces are supported")
        self.of_byte = [model.piece_to_id(BYTE.format(b)) for b in range(256)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        if any(APART in p for p in self.ids):
            raise ValueError("a piece holds U+E000")
        # Equal scores are one class, in which the place decides.
        scores = sorted({model.get_score(i) for i in self.ids.values()}, reverse=True)
        order = {s: at << 32 for at, s in enumerate(scores)}
        self.order = {p: order[model.get_score(i)] for p, i in self.ids.items() if len(p) > 1}
        self.text = [b"" if model.is_control(i) else UNKNOWN.encode() if model.is_unknown(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.of_byte):
            self.text[i] = bytes([b])
        self.leading = {i for i in range(n) if not special[i] and model.id_to_piece(i).startswith(SPACE)}
        # A number for each character of longer pieces, 0 for all others.
        letters = sorted({c for p in self.order for c in p})
        self.number = np.zeros(0x110000, np.int16)
        self.number[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        of = {c: at for at, c in enumerate(letters, 1)}
        self.meet = np.zeros((len(letters) + 1,) * 2, bool)
        for p in self.order:
            for a, b in zip(p, p[1:]):
                self.meet[of[a], of[b]] = True

    def chunks(self, text: str) -> list[str]:
        """A normalised text in pieces that no merge crosses."""
        number = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = (np.flatnonzero(~self.meet[number[:-1], number[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk."""
        symbols = self.merge_short(chunk) if len(chunk) <= SHORT else self.merge_long(chunk)
        found: list[int] = []
        for s in symbols:
            known = self.ids.get(s)
            if known is not None:
                found.append(known)
            else:
                found += [self.of_byte[b] for b in s.encode("utf-8", "surrogatepass")]
        return found

    def merge_short(self, chunk: str) -> list[str]:
        """The agenda of a short chunk is a list by place: its first smallest entry is the next."""
        order = self.order.get
        symbols = list(chunk)
        agenda = [order(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < NONE:
            i = agenda.index(best)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = order(symbols[i] + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + symbols[i], NONE)
        return symbols

    def merge_long(self, chunk: str) -> list[str]:
        """The agenda of a long chunk is a heap of (order of the score, place of the left symbol), each as one number."""
        order = self.order
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[int] = []
        made: dict[int, str] = {}

        def add(i: int, j: int) -> None:
            piece = symbols[i] + symbols[j]
            if piece in order:
                made[entry := order[piece] | i] = piece
                heapq.heappush(agenda, entry)

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & _PLACE
            left, j = symbols[i], after[i]
            # A symbol that has grown or gone since makes another piece, or none.
            if left is None or j >= n or left + symbols[j] != made[entry]:
                continue
            symbols[i], symbols[j] = made[entry], None
            beyond = after[i] = after[j]
            if beyond < n:
                before[beyond] = i
                add(i, beyond)
            if before[i] >= 0:
                add(before[i], i)
        return [s for s in symbols if s is not None]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process, which serves many tasks."""
    return Vocabulary(path)


class Encoder:
    """Encodes texts in lots; keeps the ids of up to CACHE_SIZE chunks of CACHE_CHARS characters, or those of one lot."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.cache: dict[str, bytes] = {}
        self.chars = 0

    def learn(self, new: list[str]) -> None:
        """Encode chunks that the cache lacks, and hold them against the library, many in one text."""
        lot: list[str] = []
        size = 0
        for chunk in new:
            self.cache[chunk] = array("i", self.vocab.merge(chunk)).tobytes()
            lot.append(chunk)
            size += len(chunk) + 1
            if size > CHECK_CHARS:
                self.check(lot)
                lot, size = [], 0
        self.check(lot)

    def check(self, lot: list[str]) -> None:
        if lot:
            apart = np.array([self.vocab.of_byte[b] for b in APART.encode()], "<i4").tobytes()
            first = np.array([self.vocab.ids[SPACE]], "<i4").tobytes()
            told = np.array(self.vocab.library.encode(APART + APART.join(lot)), "<i4").tobytes()
            if told != first + apart + apart.join(map(self.cache.__getitem__, lot)):
                raise ValueError(f"the library encodes one of {len(lot)} chunks otherwise")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [self.vocab.chunks(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        used = set().union(*split)
        new = used - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_SIZE or self.chars + sum(map(len, new)) > CACHE_CHARS:
            self.cache, self.chars, new = {}, 0, used
        self.chars += sum(map(len, new))
        self.learn(list(new))
        return [b"".join(map(self.cache.__getitem__, s)) for s in split]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process: what a task has encoded, the next need not."""
    return Encoder(path)


def decoded_text(ids: np.ndarray, vocab: Vocabulary) -> str:
    """As the library decodes: a space in front of the first piece is left out, control pieces are nothing."""
    found = ids.tolist()
    start = next((k for k, i in enumerate(found) if vocab.text[i]), 0)
    raw = b"".join(map(vocab.text.__getitem__, found))
    if found and found[start] in vocab.leading:
        raw = raw[1:]
    return raw.decode("utf-8", "each-byte")


def _lists(cells: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(c) // 4 for c in cells)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(cells), "<i4"), pa.int32()))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """`docs` with `ids` (array of int) and `n_tokens`, as the sentencepiece library encodes without begin and end.

    A null or empty text has no ids. Whole texts of any length; rows stay one for one, repeated rows too; input columns named
    ids or n_tokens are replaced, all others pass. An empty table stays empty. With `decoded`, a column of that name has the ids
    decoded again in the same pass. The path must hold on executors too. A worker needs some 200 bytes for each character of
    its longest chunk; a chunk is a word, or a run of one character.
    """
    names = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType())] + [(decoded, T.StringType())] * bool(decoded)

    def start():
        own = encoder(model_path)

        def work(texts):
            ids = own.encode([t.as_py() or "" for t in texts])
            made = [_lists(ids), pa.array([len(x) // 4 for x in ids], pa.int64())]
            return made + ([pa.array([decoded_text(np.frombuffer(x, "<i4"), own.vocab) for x in ids], pa.string())] if decoded else [])

        return work

    return arrow_columns(docs, [text_col], [T.StructField(n, t) for n, t in names], start)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """`df` with the text of the ids (array of int) in `to`, as the library decodes; bytes that are no UTF-8 become U+FFFD each.

    Null or no ids give an empty text, a null id or one outside the vocabulary is an error. Rows stay one for one; an input
    column named as `to` is replaced.
    """

    def start():
        vocab = vocabulary(model_path)

        def work(cells):
            return [pa.array([decoded_text(np.array(c.as_py() or [], np.int64), vocab) for c in cells], pa.string())]

        return work

    return arrow_columns(df, [ids_col], [T.StructField(to, T.StringType())], start)
