r"""Near-duplicates: MinHash signatures and a multi-index Hamming join.

A document's set holds its different shingles of `shingle_words` words `[^\x20\x09-\x0D]+`, A-Z lower-cased. Documents with
equal sets form a class. A class has a signature of `SYMBOLS` MinHash values cut down to 8 bits. Two sets of similarity
0.8 differ in 24 of 120 symbols on average, and in more than `DISTANCE` = 47 with a chance under 1e-6. By the pigeonhole
principle signatures within 47 agree, but for one symbol at most, in one of 24 chunks of 5 symbols: so each class gets
for each chunk the five keys that leave one symbol out, and all pairs within the distance meet under some key.

No group under a key is expanded into pairs. In each of `ROUNDS` rounds a class is held against `HUBS` hubs, those that it
shares most keys with among its groups' hubs; links found are made into components, and what lies in the largest component
of a group is not asked again. Only where a group still has several components are its remaining pairs across components
compared: in blocks of bounded size, each pair under its first common key alone, by signature, set size and a parity sketch
of the set, whose different bits are never more than the elements in which two sets differ. What passes is confirmed on the
full sets. So no link between components is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, bound_batches, drop_table, give_back, slices, stage_table

SYMBOLS, CHUNK = 120, 5
CHUNKS = SYMBOLS // CHUNK
#: Largest signature distance of which every pair is found: one error allowed in each of 24 chunks.
DISTANCE = 2 * CHUNKS - 1
#: Bytes of a set's parity sketch: the bit that an element's hash names is turned over by each element.
SKETCH = 128
#: Rounds of hubs before groups of several components are compared whole, and hubs that a class is held against in each.
ROUNDS, HUBS = 2, 3
#: Classes whose keys one task makes (120 rows of 16 bytes each).
KEY_LOT = 4096
#: Members of a group that are compared at once with as many others.
BLOCK = 2048
#: Bytes of sets that a verifying task holds of either side.
SET_BYTES = 16 << 20
#: Rows of (class, id) that are broadcast at most (40 bytes each).
BROADCAST_ROWS = 1 << 19
#: Stands for a null id where a row is looked up by it.
NO_ID = -(1 << 63)

_RNG = np.random.default_rng(20210701)
_MULTIPLY = (_RNG.integers(1, 1 << 32, SYMBOLS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIP = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted different 64-bit shingle hashes of a text; a text of fewer words is one shingle, one of none has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ h[j : len(h) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """SYMBOLS MinHash values of 8 bits."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        least = np.minimum(least, ((low[i : i + 1024, None] * _MULTIPLY) ^ _FLIP).min(0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def sketch(found: np.ndarray) -> np.ndarray:
    """The parity sketch of a set as SKETCH bytes."""
    bits = np.bincount((found & np.uint64(8 * SKETCH - 1)).astype(np.int64), minlength=8 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8))


def marks(cells) -> np.ndarray:
    """Binary cells of signature and sketch as rows of bytes."""
    return np.frombuffer(b"".join(cells), np.uint8).reshape(-1, SYMBOLS + SKETCH)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """Rows of CHUNKS * CHUNK keys: number of chunk and of the symbol left out, then the other four symbols."""
    out = []
    for c in range(CHUNKS):
        chunk = signatures[:, c * CHUNK : (c + 1) * CHUNK].astype(np.int64)
        for e in range(CHUNK):
            q = np.delete(chunk, e, 1)
            out.append((c * CHUNK + e) << 32 | q[:, 0] << 24 | q[:, 1] << 16 | q[:, 2] << 8 | q[:, 3])
    return np.stack(out, 1)


def first_key(equal: np.ndarray) -> np.ndarray:
    """Of each row of equal symbols, the number of the first key that both signatures have, -1 without any."""
    by_chunk = equal.reshape(*equal.shape[:-1], CHUNKS, CHUNK)
    same = by_chunk.sum(-1, dtype=np.uint8)
    meets = same >= CHUNK - 1
    c = meets.argmax(-1)
    chunk = np.take_along_axis(by_chunk, c[..., None, None], -2)[..., 0, :]
    # With all five equal the first key leaves out symbol 0, else it must leave out the one that differs.
    e = np.where(chunk.all(-1), 0, (~chunk).argmax(-1))
    return np.where(meets.any(-1), c * CHUNK + e, -1)


def similar(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


def may_be_similar(n_a, n_b, percent: int):
    """The sizes allow the similarity."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def near_marks(x: np.ndarray, y: np.ndarray, n_x, n_y, percent: int) -> np.ndarray:
    """Where the signatures are within DISTANCE and neither sizes nor sketches rule the similarity out."""
    total = n_x + n_y
    least_common = -(-percent * total // (100 + percent))
    apart = np.bitwise_count(x[..., SYMBOLS:] ^ y[..., SYMBOLS:]).sum(-1, dtype=np.int64)
    return may_be_similar(n_x, n_y, percent) & (apart <= total - 2 * least_common) & ((x[..., :SYMBOLS] != y[..., :SYMBOLS]).sum(-1) <= DISTANCE)


def signed_documents(docs: DataFrame, id_col: str, text_col: str, width: int, row_col: str | None = None) -> DataFrame:
    """(id, digest, n, sig, row, text_hash) of every row: digest of the set (null where it is empty), its size, its
    signature with its sketch, `row_col`, and a hash of the text."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            digest, size, sig = [], [], []
            for text in b.column(1):
                found = shingle_set(text.as_py(), width)
                size.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sig.append(signature(found).tobytes() + sketch(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), b.column(2), b.column(3)], ["id", "digest", "n", "sig", "row", "text_hash"])
        give_back()

    row = F.lit(None) if row_col is None else F.col(row_col)
    columns = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row.cast("long").alias("row"), F.xxhash64(text_col).alias("text_hash"))
    return columns.mapInArrow(run, "id long, digest binary, n long, sig binary, row long, text_hash long")


def key_rows(classes: DataFrame, percent: int) -> DataFrame:
    """(key, cid) of the classes that can be similar to another one: of sets under this size, a different set is too far."""
    least = percent / (100 - percent) if percent < 100 else float("inf")

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = keys_of(marks(b.column(1).to_pylist())[:, :SYMBOLS])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1]))], ["key", "cid"])

    tasks = max(-(-classes.count() // KEY_LOT), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return classes.where(F.col("n") >= least).select("cid", "sig").repartition(tasks).mapInArrow(run, "key long, cid long")


def hub_pairs(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(a, b): for each class outside the largest component of some group, the HUBS hubs of such groups that it shares most keys with.

    A group's hub is a member of its largest component, another one each turn. Groups of one component give nothing. Of each
    chunk's keys the first takes part, which finds near hubs; the rest of the pairs is left to `across_components`.
    """
    rows = members.where(F.shiftright("key", 32) % CHUNK == 0)
    comp = F.col("cid").alias("comp") if labels is None else F.coalesce("comp", "cid").alias("comp")
    rows = (rows if labels is None else rows.join(labels, "cid", "left")).select("key", "cid", comp)
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min_by("cid", F.xxhash64("cid", F.lit(turn))).alias("pick"))
    groups = sizes.groupBy("key").agg(F.max_by(F.struct("comp", "pick"), F.struct("n", F.xxhash64("comp", F.lit(turn)), "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    outside = sizes.join(groups.select("key", "top"), "key").where("comp <> top.comp").select("key", "comp", F.col("top.pick").alias("hub"))
    met = rows.join(outside, ["key", "comp"]).groupBy("cid", "hub").agg(F.count("*").alias("n"))
    # A class has a hub for each of its keys at most: 24.
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("n", "hub")))), 1, HUBS)
    return met.groupBy(F.col("cid").alias("a")).agg(best.alias("hubs")).select("a", F.explode("hubs.hub").alias("b"))


def near_in_signature(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that signature, sizes and sketch allow to be similar, as candidates (a, bs)."""
    one, two = (classes.select(F.col("cid").alias(x), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    known = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = marks(b.column(2).to_pylist()), marks(b.column(3).to_pylist())
            good = near_marks(x, y, b.column(4).to_numpy(), b.column(5).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[good]), pa.array([[v] for v in b.column(1).to_numpy()[good].tolist()], pa.list_(pa.int64()))], ["a", "bs"])

    return known.mapInArrow(run, "a long, bs array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int, involved: DataFrame) -> DataFrame:
    """(cid, n, hashes) of the classes in `involved` (cid, rep, digest), made anew from the text of a document of each.

    A document is found by id and hash of the text, so rows of one id or of none meet only their own class. Where it is
    there several times, each task makes its set once and Spark keeps one.
    """
    wanted = involved.select("cid", "digest", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    side = F.broadcast(wanted) if involved.count() <= BROADCAST_ROWS else wanted

    def run(batches):
        seen = set()
        for b in (part for whole in batches for part in slices(whole)):
            cids, sizes, sets = [], [], []
            for cid, digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if cid in seen:
                    continue
                found = shingle_set(text.as_py(), width)
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == digest:
                    seen.add(cid)
                    cids.append(cid)
                    sizes.append(len(found))
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], ["cid", "n", "hashes"])
        give_back()

    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rep_id"), F.xxhash64(text_col).alias("rep_hash"), F.col(text_col).alias("text"))
    made = texts.join(side, ["rep_id", "rep_hash"]).select("cid", "digest", "text").mapInArrow(run, "cid long, n long, hashes binary")
    return made.groupBy("cid").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))


def confirmed(candidates: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, work: Tables) -> DataFrame:
    """The links (a, b) among `candidates` (a, bs), on full sets.

    Sets lie in blocks by class; each candidate's own set goes to the blocks of its partners. Where many candidates meet
    at one block (partners of a hub), they are dealt over copies of it.
    """
    def names(batches):
        # The different classes of each batch: no row for each pair.
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.chunked_array([b.column(0), b.column(1).flatten()]).unique()], ["cid"])

    involved = candidates.select("a", "bs").mapInArrow(names, "cid long").distinct()
    involved = work.stage(involved.join(classes.select("cid", "rep", "digest"), "cid"), "nd-involved")
    sets = work.stage(full_sets(docs, id_col, text_col, width, involved), "nd-sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-8 * total // SET_BYTES))

    def block(c) -> F.Column:
        return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    parted = candidates.withColumn("bk", F.explode(F.array_distinct(F.transform("bs", block)))).withColumn("bs", F.filter("bs", lambda b: block(b) == F.col("bk")))
    parted = parted.join(classes.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a")
    copies = parted.groupBy("bk").agg(F.ceil(F.sum("na") * 8 / SET_BYTES).cast("int").alias("copies"))
    right = sets.withColumn("bk", block(F.col("cid"))).join(copies, "bk").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("bk", "copy", "cid", "hashes")
    left = parted.join(copies, "bk").join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("own")), "a").select("bk", F.pmod(F.xxhash64("a", F.lit(1)), F.col("copies")).cast("int").alias("copy"), "a", "own", "bs")

    def check(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = {c: np.frombuffer(h, np.uint64) for c, h in zip(theirs["cid"], theirs["hashes"])}
        out = []
        for a, h, bs in zip(mine["a"], mine["own"], mine["bs"]):
            own = np.frombuffer(h, np.uint64)
            for b in set(bs):
                other = found[b]
                small, large = (own, other) if len(own) < len(other) else (other, own)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if similar(int((large[at] == small).sum()), len(own), len(other), percent):
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return left.groupBy("bk", "copy").cogroup(right.groupBy("bk", "copy")).applyInPandas(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) of every class in `links` (a, b): comp is the smallest class that it reaches. A written table.

    Rounds of taking the smallest label around and then that label's own, each written to the shared folder, until
    nothing changes.
    """
    edges = stage_table(links.union(links.select("b", "a")).toDF("cid", "other").distinct(), "nd-edges")
    labels = stage_table(edges.groupBy("cid").agg(F.least(F.min("other"), F.col("cid")).alias("comp")), "nd-labels")
    while True:
        seen = labels.select(F.col("cid").alias("other"), F.col("comp").alias("theirs"))
        around = edges.join(seen, "other").groupBy("cid").agg(F.min("theirs").alias("theirs"))
        lowest = labels.join(around, "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "theirs").alias("comp"))
        jump = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("further"))
        new = stage_table(lowest.join(jump, "comp", "left").select("cid", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "nd-labels")
        drop_table(labels)
        changed = new.where("old <> comp").limit(1).count()
        labels = new.select("cid", "comp")
        if not changed:
            drop_table(edges)
            return labels


def across_components(members: DataFrame, labels: DataFrame | None, classes: DataFrame, percent: int, work: Tables) -> DataFrame:
    """Candidates (a, bs): the pairs of different components that share a key.

    In each group the largest component is set aside: every pair across components has a member outside of it. Those are
    compared with all, in blocks of BLOCK by BLOCK.
    """
    comp = F.col("cid").alias("comp") if labels is None else F.coalesce("comp", "cid").alias("comp")
    rows = (members if labels is None else members.join(labels, "cid", "left")).select("key", "cid", comp)
    rows = work.stage(rows, "nd-rows")
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("comps")).where("comps > 1")
    groups = work.stage(groups.select("key", "top", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("minor_blocks")), "nd-groups")
    mixed = rows.join(groups.hint("shuffle_hash"), "key")
    mixed = mixed.join(classes.select("cid", "sig", F.col("n").alias("n")), "cid")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = mixed.where("comp <> top").withColumn("mb", F.pmod(F.xxhash64("cid"), "minor_blocks").cast("int")).withColumn("ab", each(F.col("blocks")))
    everyone = mixed.withColumn("ab", F.pmod(F.xxhash64("cid", F.lit(1)), "blocks").cast("int")).withColumn("mb", each(F.col("minor_blocks")))
    columns = ["key", "mb", "ab", "cid", "comp", "top", "n", "sig"]
    both = outside.select(*columns, F.lit(True).alias("outside")).union(everyone.select(*columns, F.lit(False)))

    def compare(group: pa.Table) -> list[tuple[int, list[int]]]:
        out_of = group["outside"].to_numpy(zero_copy_only=False).astype(bool)
        if out_of.all() or not out_of.any():
            return []
        sig = marks(group["sig"].to_pylist())
        cid, comp, n = (group[c].to_numpy() for c in ("cid", "comp", "n"))
        number, top = group["key"][0].as_py() >> 32, group["top"][0].as_py()
        all_sig, all_cid, all_comp, all_n = sig[~out_of], cid[~out_of], comp[~out_of], n[~out_of]
        found = []
        for i in np.flatnonzero(out_of).tolist():
            # A partner outside the largest component meets this one twice; the smaller class takes it.
            maybe = (all_comp != comp[i]) & ((all_comp == top) | (all_cid > cid[i])) & may_be_similar(all_n, n[i], percent)
            at = np.flatnonzero(maybe)
            at = at[near_marks(all_sig[at], sig[i], all_n[at], n[i], percent)]
            at = at[first_key(all_sig[at, :SYMBOLS] == sig[i, :SYMBOLS]) == number]
            if len(at):
                found.append((int(cid[i]), all_cid[at].tolist()))
        return found

    def run(batches):
        # The partition is sorted by group; a group may lie across batches.
        held: list[pa.RecordBatch] = []

        def emit(tables):
            rows = compare(pa.Table.from_batches(tables))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.list_(pa.int64()))], ["a", "bs"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(i).to_numpy() for i in range(3)]
            cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names])) + 1
            bounds = [0, *cut.tolist(), batch.num_rows]
            done = []
            for i, j in zip(bounds, bounds[1:]):
                now = tuple(int(x[i]) for x in names)
                if now != last and held:
                    done.append(emit(held))
                    held = []
                last = now
                held.append(batch.slice(i, j - i))
            rows = [d for d in done if d.num_rows]
            if rows:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
        if held:
            yield emit(held)
        give_back()

    ordered = both.repartition("key", "mb", "ab").sortWithinPartitions("key", "mb", "ab")
    return ordered.mapInArrow(run, "a long, bs array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, row_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    With `row_col`, a written column of different numbers, also `row` and `stays`, which is true for one row of each
    component: that of the smallest id, nulls last, then of the smallest number.

    Links join documents of which 100 * intersection >= percent * union of the shingle sets; component_id is the smallest
    id reachable and kept marks its document. A null or empty text, or one without words, has an empty set and is linked
    with nothing. A null id never becomes a component's id while another is there; where there is none the id is null
    and its row kept. Rows that share an id are documents of their own. `percent` is 80 to 100.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100: signatures are laid out for that")
    bound_batches(docs.sparkSession)
    signed = stage_table(signed_documents(docs, id_col, text_col, shingle_words, row_col), "nd-signed")
    rep = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text_hash")).alias("rep")
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), rep, F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head"))
    classes = stage_table(classes.withColumn("cid", F.monotonically_increasing_id()), "nd-classes")
    keys = key_rows(classes, percent)
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = stage_table(keys.join(shared.hint("shuffle_hash"), "key").select("key", "cid"), "nd-members")
    links = labels = None
    work, found_links = Tables(), Tables()

    def link(candidates: DataFrame, name: str) -> bool:
        """Adds the links among the candidates; whether there are any."""
        nonlocal links, labels
        candidates = work.stage(candidates, f"nd-candidates-{name}")
        found = found_links.stage(confirmed(candidates, classes, docs, id_col, text_col, shingle_words, percent, work), f"nd-links-{name}")
        work.drop()
        if found.isEmpty():
            return False
        if labels is not None:
            drop_table(labels)
        links = found if links is None else links.union(found)
        labels = components(links)
        return True

    for turn in range(ROUNDS):
        if not link(near_in_signature(hub_pairs(members, labels, turn), classes, percent), f"hubs-{turn}"):
            break
    link(across_components(members, labels, classes, percent, work), "rest")
    drop_table(members)
    if labels is None:
        labels = classes.select("cid", F.col("cid").alias("comp")).limit(0)
    placed = classes.select("digest", "cid", "least", "head").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    ids = stage_table(placed.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("head").getField("row").alias("first_row")), "nd-ids")
    placed = stage_table(placed.select("digest", "comp").join(ids, "comp").select("digest", "component_id", "first_row"), "nd-placed")
    for table in (ids, classes, *([] if links is None else [labels])):
        drop_table(table)
    found_links.drop()
    alone = signed.where("digest IS NULL").select("id", "n", F.col("id").alias("component_id"), "row", F.lit(True).alias("stays"))
    done = signed.where("digest IS NOT NULL").select("id", "n", "digest", "row").join(placed, "digest").select("id", "n", "component_id", "row", (F.col("row") == F.col("first_row")).alias("stays")).union(alone)
    rows = () if row_col is None else ("row", "stays")
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *rows)
