r"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A-Z are lower-cased; words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. Windows are `WINDOW` consecutive words of a benchmark
item; an item of fewer words, but not none, is one window. Windows of one length form one search: a table of two-word
blocks gives how far the search may move on, a hash bucket of the windows' last two words gives those to test, and a
direct comparison of all bytes decides. A document word inside any occurrence is hit.

The benchmark is the broadcast side. It is cut into blocks of at most `BLOCK_BYTES` of text, which bounds what a
worker holds; a larger benchmark is searched block after block, with the hits so far kept in a table between. A worker process
builds the tables of a block once, for all its tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import arrow_columns, stage_table

WINDOW = 13
#: Bytes of benchmark text that are broadcast and searched at once (see the README for what their tables take).
BLOCK_BYTES = 16 << 20
#: Words whose places are Python numbers at once.
LOT = 1 << 16

#: Byte by byte: letters lower-cased, other ASCII that is no digit turned into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Items:
    """The words of many items one after the other: their bytes, joined by single spaces, where each word begins and ends, and hashes of
    the blocks that begin at each, of two words or, in an item of one, of that. Hashes hold for this process alone."""

    def __init__(self, texts: list[str | None]):
        joined, lengths, blocks = [], [], []
        for text in texts:
            seq = words(text)
            lengths.append(np.fromiter(map(len, seq), np.int32, len(seq)))
            if seq:
                joined.append(b" ".join(seq))
                # The last word of an item of several begins no block.
                made = map(hash, zip(seq, [*seq[1:], b""])) if len(seq) > 1 else map(hash, seq)
                blocks.append(np.fromiter(made, np.int64, len(seq)))
        self.bytes = b" ".join(joined)
        self.begins = np.cumsum([0, *map(len, lengths)])
        each = np.concatenate([np.zeros(0, np.int32), *lengths])
        self.ends = np.cumsum(each + 1, dtype=np.int32) - 1
        self.starts = self.ends - each
        self.blocks = np.concatenate([np.zeros(0, np.int64), *blocks])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from one word to another."""
        view = memoryview(self.bytes)
        parts = (zip(self.starts[first[k : k + LOT]].tolist(), self.ends[last[k : k + LOT]].tolist()) for k in range(0, len(first), LOT))
        return np.fromiter((hash(view[i:j]) for part in parts for i, j in part), np.int64, len(first))


class WuManber:
    """Search for the windows of `length` words of the given items: a shift for each hashed block of two words, windows in buckets by
    the hashed block at their end, and in a bucket by a hash of the whole; bytes decide. All tables are flat arrays."""

    def __init__(self, length: int, items: Items, numbers: np.ndarray):
        self.length, self.block, self.items = length, min(2, length), items
        self.default = length - self.block + 1
        begins, sizes = items.begins[numbers], items.begins[numbers + 1] - items.begins[numbers]

        def runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(place in an item, item) of its first n words, for all items."""
            return (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), np.repeat(np.arange(len(n), dtype=np.int32), n)

        # Blocks: the nearest end of a window behind one that begins at word i is that of the item's first, or its own.
        at, item = runs(sizes - self.block + 1)
        first = begins.astype(np.int32)[item] + at
        # Eight slots for each block, so that few others share one.
        self.mask = (1 << max(10, int(len(first) * 4).bit_length())) - 1
        slots = (items.blocks[first] & self.mask).astype(np.int32)
        shift = np.full(self.mask + 1, self.default, np.uint8)
        np.minimum.at(shift, slots, np.maximum(0, length - self.block - at).astype(np.uint8))
        self.shift = shift.tobytes()
        # Windows, by the slot of their last block, then by hash; those of equal hashes lie together.
        ends = np.flatnonzero(at >= length - self.block)
        begin = first[ends] - (length - self.block)
        whole = items.hashes(begin, begin + length - 1)
        seen = np.zeros(self.mask + 1, np.uint8)
        seen[whole & self.mask] = 1
        self.seen = seen.tobytes()
        slots, owner = slots[ends], numbers.astype(np.int32)[item[ends]]
        del at, item, first, ends
        order = np.lexsort((owner, whole, slots))
        self.begin, self.whole, self.owner, self.slots = begin[order], whole[order], owner[order], slots[order]

    def found(self, slot: int, text: bytes) -> np.ndarray | None:
        """The items that hold a window of these bytes whose last block has this slot."""
        key = hash(text)
        if not self.seen[key & self.mask]:
            return None
        low, high = (self.slots.searchsorted(np.int32(slot), side) for side in ("left", "right"))
        if low == high:
            return None
        part = self.whole[low:high]
        i, j = (low + part.searchsorted(np.int64(key), side) for side in ("left", "right"))
        starts, ends = self.items.starts[self.begin[i:j]], self.items.ends[self.begin[i:j] + self.length - 1]
        same = [k for k, a, b in zip(range(i, j), starts.tolist(), ends.tolist()) if self.items.bytes[a:b] == text]
        return self.owner[same] if same else None

    def occurrences(self, seq: list[bytes]):
        """(start, items) of each occurrence, by start."""
        at, m, n, shift, mask, one = self.length, self.length, len(seq), self.shift, self.mask, self.block == 1
        while at <= n:
            slot = hash(seq[at - 1] if one else (seq[at - 2], seq[at - 1])) & mask
            move = shift[slot]
            if move:
                at += move
                continue
            items = self.found(slot, b" ".join(seq[at - m : at]))
            if items is not None:
                yield at - m, items
            at += 1


def searches(texts: list[str | None], window: int) -> list[WuManber]:
    """One search for each length of windows."""
    items = Items(texts)
    sizes = np.minimum(np.diff(items.begins), window)
    return [WuManber(m, items, np.flatnonzero(sizes == m)) for m in np.unique(sizes[sizes > 0]).tolist()]


#: The searches of the block that this worker process had last, by the block's name.
_BUILT: dict[str, list[WuManber]] = {}


def searches_of(name: str, texts: list[str | None], window: int) -> list[WuManber]:
    """`searches`, built once for each worker process and block."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = searches(texts, window)
    return _BUILT[name]


def merge_spans(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, joined where they touch, as one flat list start, end, start, end ..."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += (start, end)
    return flat


def _search_block(df: DataFrame, text_col: str, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    spark = df.sparkSession
    held, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def start():
        ids = [i for i, _ in held.value]
        find = searches_of(name, [t for _, t in held.value], window)

        def work(texts, spans, found):
            n_words, out_spans, out_items = [], [], []
            for text, old, had in zip(texts.to_pylist(), spans.to_pylist(), found.to_pylist()):
                seq = words(text)
                hits, got = [], set()
                for search in find:
                    for at, numbers in search.occurrences(seq):
                        hits.append((at, at + search.length))
                        got.update(numbers.tolist())
                n_words.append(len(seq))
                out_spans.append(merge_spans(hits + list(zip(old[::2], old[1::2]))) if hits else old)
                out_items.append(had + [ids[g] for g in got] if got else had)
            return [pa.array(n_words, pa.int64()), pa.array(out_spans, pa.list_(pa.int32())), pa.array(out_items, pa.list_(pa.string()))]

        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    return arrow_columns(df, [text_col, "hit_spans", "item_ids"], fields, start)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, hit_spans (flat word positions start, end, ...), item_ids (text, sorted), n_hit, n_items and contaminated.

    Contaminated: n_hit > 0 and 20 * n_hit >= n_words. A null or empty text has no words and is clean. An item without
    words has no window; items that share an id count once in n_items; an item without an id counts by the empty text.
    An empty benchmark finds nothing. Rows stay one for one; input columns named as results are replaced.
    """
    made = ["n_words", "hit_spans", "item_ids", "n_hit", "n_items", "contaminated"]
    order = [c for c in docs.columns if c.lower() not in made]
    df = docs.select(*order, F.array().cast("array<int>").alias("hit_spans"), F.array().cast("array<string>").alias("item_ids"))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).distinct()
    size = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        df = _search_block(df, text_col, [tuple(r) for r in part.collect()], window)
        if b + 1 < blocks:
            df = stage_table(df, "contamination")
    spans = F.col("hit_spans")
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size(spans)), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.when(i % 2 == 1, F.get(spans, i)).otherwise(-F.get(spans, i)), F.lit(0)))
    df = df.withColumns({"item_ids": F.array_sort(F.array_distinct("item_ids")), "n_hit": n_hit})
    df = df.withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})
    return df.select(*order, *made)
