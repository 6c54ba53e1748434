"""Language identification with hyperdimensional profiles.

Each letter, and the gap between words, has a random vector of +1 and -1 drawn from its code point. An n-gram of three
letters is bound: its letters' vectors, rotated by their places, are multiplied. A text is the sum (bundle) of its n-grams,
a language the sum over its training texts. A text gets the language whose vector is nearest by cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import arrow_columns, bound_batches

DIM = 1024
SEED = 20240229
NONE = "und"
#: Texts and characters that are counted together; a longer text is counted in pieces of so many characters.
LOT_TEXTS, LOT_CHARS = 256, 1 << 20
#: Different n-grams whose vectors are made at once (4 MB), for all texts of a lot.
GRAMS = 1 << 10


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int64)


@lru_cache(maxsize=1 << 15)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng((SEED, code)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


def _pieces(texts: list[str]):
    """(characters, owners): texts in lower case for counting together, each between gaps, and the number of the text of each
    character. A long text comes in pieces that overlap by two, so that each n-gram is in one piece."""
    lot, owner, held = ["\0"], [0], 0
    for i, text in enumerate(texts):
        text = text.lower()
        if len(text) > LOT_CHARS:
            whole = f"\0{text}\0"
            for at in range(0, len(text), LOT_CHARS):
                piece = whole[at : at + LOT_CHARS + 2]
                yield piece, np.full(len(piece), i)
        else:
            if held + len(text) > LOT_CHARS:
                yield "".join(lot), np.repeat(owner, [len(x) for x in lot])
                lot, owner, held = ["\0"], [i], 0
            lot.append(text + "\0")
            owner.append(i)
            held += len(text)
    yield "".join(lot), np.repeat(owner, [len(x) for x in lot])


def ngram_counts(chars: str, owner: np.ndarray, texts: int):
    """(letters, left, middle, right, texts, counts): one row for each different n-gram in each text, by n-gram; the three
    columns are places in `letters`, of which the first is the gap. The middle of an n-gram is a letter."""
    codes = _letters()[np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero(codes[1:-1] > 0) + 1
    letters = np.flatnonzero(np.bincount(codes, minlength=1))
    letters = letters if len(letters) and letters[0] == 0 else np.concatenate(([0], letters))
    rank = np.zeros(letters[-1] + 1, np.int64)
    rank[letters] = np.arange(len(letters))
    codes, size = rank[codes], len(letters)
    key, counts = np.unique(((codes[at - 1] * size + codes[at]) * size + codes[at + 1]) * texts + owner[at], return_counts=True)
    gram = key // texts
    return letters, gram // (size * size), gram // size % size, gram % size, key % texts, counts


def bundle(texts: list[str]) -> np.ndarray:
    """One vector for each text; zero where a text has no letter. Memory grows with LOT_CHARS and GRAMS, not with a text."""
    out = np.zeros((len(texts), DIM))
    for chars, owner in _pieces(texts):
        letters, left, middle, right, text, counts = ngram_counts(chars, owner, len(texts))
        if not len(counts):
            continue
        table = np.stack([letter_vector(int(c)) for c in letters])
        before, after = np.roll(table, 2, 1), np.roll(table, 1, 1)
        new = np.concatenate(([True], (left[1:] != left[:-1]) | (middle[1:] != middle[:-1]) | (right[1:] != right[:-1])))
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        used, local = np.unique(text, return_inverse=True)
        for i in range(0, len(first), GRAMS):
            at = first[i : i + GRAMS]
            bound = before[left[at]] * after[middle[at]] * table[right[at]]
            j, k = at[0], first[i + GRAMS] if i + GRAMS < len(first) else len(number)
            weight = np.zeros((len(used), len(at)), np.float32)
            weight[local[j:k], number[j:k] - i] = counts[j:k]
            out[used] += weight @ bound.astype(np.float32)
    return out


def _lots(texts: pa.Array):
    lot, held = [], 0
    for text in texts:
        lot.append(text.as_py() or "")
        held += len(lot[-1])
        if len(lot) >= LOT_TEXTS or held > LOT_CHARS:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The vector of each language of `docs`; rows without language or text are passed over.

    Each task sums its own texts; what leaves it is one vector for each language, and a language's vectors are summed again
    by Spark. The result, DIM numbers a language, is held by the driver and every worker: 8 KB for each different value of
    `lang_col`, of which there should be thousands at most.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for lot in _lots(batch.column(0)):
                of, vectors = np.array(langs[at : at + len(lot)], object), bundle(lot)
                at += len(lot)
                for lang in set(of):
                    sums[lang] = sums.get(lang, 0) + vectors[of == lang].sum(0, dtype=np.float64)
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].astype(np.int64).tolist() for n in names], pa.list_(pa.int64()))], ["lang", "vector"])

    def add_up(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[lang] = sums.get(lang, 0) + vector.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    bound_batches(docs.sparkSession)
    known = docs.select(text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    schema = "lang string, vector array<long>"
    found = known.mapInArrow(run, schema).repartition("lang").mapInArrow(add_up, schema).toArrow()
    return {lang: np.array(v, np.float64) for lang, v in zip(found["lang"].to_pylist(), found["vector"].to_pylist())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (the cosine, 0 where it is negative).

    A text that is null or has no letter, and any text when there are no profiles, gets `und` and 0. Ties go to the
    language whose name comes first. Rows stay one for one; input columns named lang_pred or score are replaced.
    """
    names = sorted(profiles)
    table = np.array([profiles[n] / max(np.linalg.norm(profiles[n]), 1e-12) for n in names]).reshape(len(names), DIM).astype(np.float32)

    def start():
        def work(texts):
            langs, scores = [], []
            for lot in _lots(texts):
                vectors = bundle(lot)
                lettered = vectors.any(1)
                if not names:
                    lettered[:] = False
                cosine = vectors @ table.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None] if names else np.zeros((len(lot), 1))
                best = cosine.argmax(1)
                for i, b in enumerate(best.tolist()):
                    langs.append(names[b] if lettered[i] else NONE)
                    scores.append(min(1.0, max(0.0, float(cosine[i, b]))) if lettered[i] else 0.0)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return arrow_columns(docs, [text_col], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], start)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a letter."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([any(map(str.isalpha, t.as_py() or "")) for t in batch.column(batch.schema.get_field_index(text_col))], pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
