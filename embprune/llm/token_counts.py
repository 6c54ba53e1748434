r"""Token counts without a pre-token shuffle: a two-tier lookup in the map stage.

First tier: a hash table of the most frequent pre-tokens and their lengths in tokens, at most `TABLE_SIZE` entries (about
8 MB), broadcast. It comes from a pass over all texts in which each task hands on its `SUMMARY_SIZE` most frequent words
and no others; which pre-tokens get into the table changes only the speed. Second tier: each worker encodes the
pre-tokens that miss, with the tokenizer itself and in lots, and keeps them in a cache of at most `CACHE_SIZE`, which
lives as long as the worker's process.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import arrow_columns, bound_batches, most_frequent, stage_table

TABLE_SIZE = 1 << 16
SUMMARY_SIZE = 1 << 12
#: Units in the second tier, and characters of these.
CACHE_SIZE, CACHE_CHARS = 1 << 19, 1 << 23
LOT = 4096
#: Characters of text that are split at a time.
LOT_CHARS = 1 << 20

#: White space as the tokenizer's patterns have it: str.split() also splits at \x1c-\x1f.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[^{_WS}]+")
#: Up to this letter the Unicode tables of all libraries agree.
_PLAIN = re.compile("[\x00-\u052f]*")


@lru_cache(maxsize=1)
def _plain_pattern() -> re.Pattern:
    r"""The splitter of lower-case word vocabularies, 's|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+, for plain texts."""
    kinds = {k: [c for c in range(0x530) if category(chr(c))[0] == k] for k in "LN"}
    letters, digits = ("".join(f"\\u{c:04x}" for c in kinds[k]) for k in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_WS}{letters}{digits}]+")


def pre_tokens(text: str | None) -> list[str]:
    """Units of a text whose lengths add up to the text's: pre-tokens, normalised, of a plain text; else the pieces between
    white space, which no pre-token crosses, as they are. A piece that may hold a special token's string is not plain."""
    if not text:
        return []
    plain = normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
    if "<|" in text or not _PLAIN.fullmatch(plain):
        return _PIECE.findall(text)
    return _plain_pattern().findall(plain)


def lengths(tokenizer, parts: list[str]) -> list[int]:
    """Tokens of each unit; one call for a lot of them, so that the words of the result are the units."""
    out: list[int] = []
    for i in range(0, len(parts), LOT):
        lot = parts[i : i + LOT]
        of = tokenizer.encode(lot, is_pretokenized=True, add_special_tokens=False).word_ids
        out += np.bincount(np.array(of, dtype=np.int64), minlength=len(lot)).tolist()
    return out


@lru_cache(maxsize=1)
def load(path: str):
    """The tokenizer at `path`; one for each worker process, which serves many tasks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class SecondTier(dict):
    """unit -> tokens; forgets all before it would hold more than CACHE_SIZE units of CACHE_CHARS characters."""

    chars = 0

    def add(self, tokenizer, used: set[str]) -> None:
        new = list(used - self.keys())
        if len(self) + len(new) > CACHE_SIZE or self.chars + sum(map(len, new)) > CACHE_CHARS:
            self.clear()
            self.chars, new = 0, list(used)
        self.chars += sum(map(len, new))
        self.update(zip(new, lengths(tokenizer, new)))


@lru_cache(maxsize=1)
def _second_tier(path: str) -> SecondTier:
    return SecondTier()


def frequent_pre_tokens(docs: DataFrame, text_col: str, table_size: int = TABLE_SIZE, summary_size: int = SUMMARY_SIZE) -> list[str]:
    """The most frequent pre-tokens, by the sum of what the tasks' summaries say of them; ties by pre-token."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update((text.as_py() or "").lower().split())
                if len(seen) > CACHE_SIZE:
                    seen = Counter(dict(seen.most_common(CACHE_SIZE // 4)))
        top: Counter = Counter()
        for word, n in seen.most_common(summary_size):
            if len(word) <= 64:
                for t in pre_tokens(word):
                    top[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.string()), pa.array(list(top.values()), pa.int64())], ["unit", "n"])

    bound_batches(docs.sparkSession)
    counts = docs.select(text_col).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = stage_table(counts, "frequent-units")
    return [unit for unit, _ in most_frequent(counts, "unit", "n", table_size)]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 2048, table_size: int = TABLE_SIZE) -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), for the tokenizer at `tokenizer_path`.

    A null or empty text has 0 bytes and 0 tokens. Special tokens' strings inside a text count as the library's default
    has it: one token each. Rows stay one for one; input columns named as results are replaced. The path must hold on
    executors too.
    """
    frequent = frequent_pre_tokens(docs, text_col, table_size)
    held = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent, lengths(load(tokenizer_path), frequent))))

    def start():
        tokenizer, first, second = load(tokenizer_path), held.value, _second_tier(tokenizer_path)

        def count(split: list[list[str]]) -> list[int]:
            second.add(tokenizer, set().union(*split) - first.keys())
            return [sum(n if (n := first.get(p)) is not None else second[p] for p in s) for s in split]

        def work(texts):
            n: list[int] = []
            lot: list[list[str]] = []
            held_chars = 0
            for text in texts:
                text = text.as_py() or ""
                lot.append(pre_tokens(text))
                held_chars += len(text)
                if held_chars > LOT_CHARS:
                    n += count(lot)
                    lot, held_chars = [], 0
            return [pa.array(n + count(lot), pa.int64())]

        return work

    made = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c.lower() not in made]
    done = arrow_columns(docs.select(*kept), [text_col], [T.StructField("n_tokens", T.LongType())], start)
    done = done.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})
    return done.select(*kept, *made)
