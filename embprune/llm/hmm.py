r"""Hidden Markov language model over words.

Tokens: A-Z lower-cased words `[^\x20\x09-\x0D]+` of a text, then one end token. In the passes of Baum-Welch the
`STATE_WORDS` - 2 most frequent words and the end have emissions of their own in each state, all other words share one
symbol. The last pass also gathers the expected counts by state of every other training word, as a Spark table keyed by
word; in each state a word has its add-half share of the symbol there, an unseen word that of a word with count 0. So every
training word has emissions by state, and every text a probability.

Counting, Baum-Welch and scoring see all texts. Baum-Welch takes the training texts in segments of `SEGMENT` tokens with up to
`CONTEXT` tokens of the text on either side, from which the state at a cut is weighed; starts are counted at the beginnings
of texts only and moves across cuts too. Each task sums expected counts and Spark adds them up. Scoring runs the scaled
forward recursion over whole texts. The figures of the `TIER_WORDS` most frequent words are broadcast (about 80 MB in a
worker), those of all others are joined, one row for each text and different word.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bound_batches, drop_table, most_frequent, slices, stage_table

STATES = 4
ITERATIONS = 5
#: First probability of staying in a state: long stays let states become topics and languages.
STAY = 0.9
#: Symbols with emissions of their own: 0 is the end, 1 all words beyond the most frequent, then those.
STATE_WORDS = 1 << 15
#: At most 2^18 - 2: symbols have 18 bits.
TIER_WORDS = (1 << 18) - 2
SEGMENT, CONTEXT = 480, 32
SEED = 7
END, RARE = 0, 1
#: Partial counts of a task are handed on when they have so many words.
COUNT_LOT = 1 << 19


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, c) over all texts; the end token is the empty string."""

    def run(batches):
        def rows(seen):
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                seen[b""] += 1
                if len(seen) > COUNT_LOT:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    return docs.select(text_col).mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Corpus:
    """Figures of the training tokens; `words` and `counts` are the most frequent words, most frequent first."""

    n: int
    v: int
    ends: int
    words: list[str]
    counts: list[int]

    @property
    def own(self) -> int:
        return min(len(self.words), STATE_WORDS - 2)

    @property
    def rare_n(self) -> int:
        return self.n - self.ends - sum(self.counts[: self.own])

    @property
    def rare_v(self) -> int:
        return self.v - (self.ends > 0) - self.own

    @property
    def base_log(self) -> float:
        return math.log10(self.n + 0.5 * (self.v + 1))


def corpus_of(counts: DataFrame, tier_words: int = TIER_WORDS) -> Corpus:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("token") == "", F.col("c"))).alias("e")).first()
    top = most_frequent(counts.where("token <> ''"), "token", "c", tier_words)
    return Corpus(total.n or 0, total.v, total.e or 0, [w for w, _ in top], [c for _, c in top])


_CODED = T.StructType(
    [T.StructField(n, t) for n, t in (("rid", T.LongType()), ("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("symbols", T.BinaryType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("misses", T.ArrayType(T.StringType())), ("which", T.BinaryType()))]
)


def packed(symbols: np.ndarray) -> bytes:
    """Symbols of up to 18 bits: the low 16 of each, then one bit of each, then the other."""
    return symbols.astype("<u2").tobytes() + np.packbits(symbols >> 16 & 1).tobytes() + np.packbits(symbols >> 17 & 1).tobytes()


def unpacked(cell: bytes) -> np.ndarray:
    n = 8 * len(cell) // 18
    out = np.frombuffer(cell, "<u2", n).astype(np.int32)
    for bit in (0, 1):
        plane = np.frombuffer(cell, np.uint8, -(-n // 8), 2 * n + bit * -(-n // 8))
        if plane.any():
            out |= np.unpackbits(plane, count=n).astype(np.int32) << (16 + bit)
    return out


def coded(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """`docs` (doc_id, text, held_out) as symbols: the end, 2 + its place for a word of the broadcast tier, else RARE; with the
    tier's part of the base score, the different words that it lacks, and which of them each RARE is."""
    held = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches):
        c = held.value
        index = {w.encode(): i + 2 for i, w in enumerate(c.words)}
        base = np.concatenate(([math.log10(c.ends + 0.5) - c.base_log, 0.0], np.log10(np.array(c.counts, np.float64) + 0.5) - c.base_log))
        rid = TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = tokens(text.as_py())
                at = np.fromiter(map(index.get, words, repeat(RARE)), np.int64, len(words))
                place: dict[bytes, int] = {}
                which = [place.setdefault(words[i], len(place)) for i in np.flatnonzero(at == RARE).tolist()]
                rows.append((rid, doc_id, out, packed(np.append(at, END)), len(words) + 1, len(words) - len(which) + (c.ends > 0), float(base[at].sum() + base[END]), [w.decode() for w in place], np.array(which, "<u4").tobytes()))
                rid += 1
            columns = list(zip(*rows)) or [[] for _ in _CODED]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], _CODED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, _CODED)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x symbols


def first_model(corpus: Corpus, states: int, seed: int) -> Model:
    """The unigram distribution with random weights in each state, which breaks the symmetry."""
    rng = np.random.default_rng(seed)
    share = np.array([corpus.ends, corpus.rare_n, *corpus.counts[: corpus.own]], np.float64) + 0.5
    emit = share * rng.uniform(0.25, 1.75, (states, len(share)))
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def expected(model: Model, sequences: list[np.ndarray], inner: list[tuple[int, int]] | None = None, gammas: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over sequences, by the scaled forward and backward recursions.

    Step by step over all sequences at once, longest first, so that those still running are the first ones. `inner` has the
    bounds of the part of each sequence that is counted: emissions in it and moves into it; a sequence that is not counted
    from 0 begins in the middle of a text, in the states in which the model is after many moves, and has no start. `gammas`
    gets the array (counted tokens x states) of each sequence.
    """
    states, symbols = model.emit.shape
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    inner = [(0, len(s)) for s in sequences] if inner is None else inner
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
    if not order:
        return starts, moves, emits
    size = np.array([len(sequences[i]) for i in order])
    begin, end = np.array([inner[i] for i in order]).T
    running = [int(np.searchsorted(-size, -t, side="left")) for t in range(size[0])]
    symbol = np.zeros((size[0], len(order)), np.int32)
    for j, i in enumerate(order):
        symbol[: size[j], j] = sequences[i]
    step = np.arange(size[0])[:, None]
    inside = (step >= begin) & (step < end)
    weight = inside[..., None].astype(np.float64)
    emit = np.ascontiguousarray(model.emit.T)[symbol]
    first = np.where((begin == 0)[:, None], model.start, model.start @ np.linalg.matrix_power(model.move, 256))
    alpha, scale = np.zeros((size[0], len(order), states)), np.ones((size[0], len(order), 1))
    for t, k in enumerate(running):
        now = (alpha[t - 1, :k] @ model.move if t else first) * emit[t, :k]
        scale[t, :k] = now.sum(1, keepdims=True)
        np.divide(now, scale[t, :k], out=alpha[t, :k])
    # With the forward scales alpha * beta is the probability of each state.
    beta, pairs, back = np.ones((len(order), states)), np.zeros((states, states)), np.ascontiguousarray(model.move.T)
    for t in range(size[0] - 1, -1, -1):
        k = running[t]
        if t:
            ahead = emit[t, :k] * beta[:k]
            ahead /= scale[t, :k]
            alpha[t, :k] *= beta[:k]
            pairs += alpha[t - 1, :k].T @ (ahead * weight[t, :k])
            np.matmul(ahead, back, out=beta[:k])
        else:
            alpha[0] *= beta
    moves += model.move * pairs
    starts += alpha[0][begin == 0].sum(0)
    flat = symbol[inside]
    for s in range(states):
        emits[:, s] = np.bincount(flat, alpha[..., s][inside], minlength=symbols)
    if gammas is not None:
        found = {i: alpha[begin[j] : end[j], j] for j, i in enumerate(order)}
        gammas += [found.get(i, np.zeros((0, states))) for i in range(len(sequences))]
    return starts, moves, emits


#: Kinds of rows of expected counts below the symbols' own: starts, and the moves out of each state.
_STARTS, _MOVES = -1, -2


def expected_rows(model: Model, table: DataFrame, tail: int | None = None, segment: int = SEGMENT, context: int = CONTEXT) -> DataFrame:
    """(kind, token, c, s0, s1, ...): the expected counts of one pass over `table` (symbols, misses, which), summed in each task.

    Kinds are symbols, _STARTS and _MOVES - state. With `tail`, the number of the tier's symbols that the model has not, there
    are also rows of those, and of the words that the tier lacks (kind null), one for each text and different word. For these words
    c is the exact number of occurrences, 0 for all other rows.
    """
    states, symbols = model.emit.shape
    held = table.sparkSession.sparkContext.broadcast(model)
    names = [f"s{s}" for s in range(states)]

    def rows(kind, token, counts):
        none = pa.array(np.zeros(len(counts), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(token, pa.string()), none, *(pa.array(counts[:, s].astype(np.float32)) for s in range(states))], ["kind", "token", "c", *names])

    def counted(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, weights[:, s], minlength=size) for s in range(states)], 1)

    def run(batches):
        m = held.value
        starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
        rest = np.zeros((tail or 0, states))

        def add(cells, misses, which):
            texts = [unpacked(c) for c in cells]
            lot, inner = [], []
            for seq in texts:
                seq = np.where(seq < symbols, seq, RARE)
                for i in range(0, len(seq), segment):
                    left, right = max(0, i - context), min(len(seq), i + segment + context)
                    lot.append(seq[left:right])
                    inner.append((i - left, min(i + segment, len(seq)) - left))
            gammas: list | None = None if tail is None else []
            for total, part in zip((starts, moves, emits), expected(m, lot, inner, gammas)):
                total += part
            if gammas:
                flat, weights = np.concatenate(texts), np.concatenate(gammas)
                known = flat >= symbols
                rest[:] += counted(flat[known] - symbols, weights[known], len(rest))
                # One row for each text and different word.
                offset = np.concatenate(([0], np.cumsum(misses.value_lengths().to_numpy())))
                at = np.concatenate([np.frombuffer(w, "<u4") + o for w, o in zip(which, offset)])
                words, at = misses.flatten(), at.astype(np.int64)
                counts = counted(at, weights[flat == RARE], offset[-1])
                own = pa.array(np.bincount(at, minlength=offset[-1]))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), words, own, *(pa.array(counts[:, s].astype(np.float32)) for s in range(states))], ["kind", "token", "c", *names])

        for batch in batches:
            cells, which = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            lots = np.cumsum([len(c) for c in cells]) // (9 << 17)  # 18 bits a token: about 2^19 tokens
            cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(cells)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    yield from add(cells[i:j], batch.column(1).slice(i, j - i), which[i:j])
        for kinds, counts in ((np.arange(symbols), emits), (symbols + np.arange(len(rest)), rest)):
            used = counts.any(1)
            yield rows(kinds[used], [None] * int(used.sum()), counts[used])
        yield rows(np.concatenate(([_STARTS], _MOVES - np.arange(states))), [None] * (states + 1), np.concatenate((starts[None], moves)))

    return table.select("symbols", "misses", "which").mapInArrow(run, "kind long, token string, c long, " + ", ".join(f"{n} float" for n in names))


def summed(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in parts.columns if n not in ("kind", "token")))


def baum_welch_step(model: Model, sums: DataFrame) -> tuple[Model, dict[int, np.ndarray], np.ndarray]:
    """The model that follows from sums of `expected_rows` by kind; the counts of symbols that it has not; those of RARE."""
    states, symbols = model.emit.shape
    starts, moves, emits = np.full(states, 0.5), np.full((states, states), 0.5), np.full((symbols, states), 0.5)
    table = sums.where(F.col("kind").isNotNull()).toArrow()
    counts = np.stack([table[f"s{s}"].to_numpy() for s in range(states)], 1) if table.num_rows else np.zeros((0, states))
    others: dict[int, np.ndarray] = {}
    for kind, row in zip(table["kind"].to_pylist(), counts):
        if kind >= symbols:
            others[kind] = row
        elif kind >= 0:
            emits[kind] += row
        elif kind == _STARTS:
            starts += row
        else:
            moves[_MOVES - kind] += row
    return Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), (emits / emits.sum(0)).T.copy()), others, emits[RARE] - 0.5


def log10_forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole sequence of symbols, by the scaled forward recursion."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    size = np.array([len(sequences[i]) for i in order])
    out = np.zeros(len(sequences))
    if not len(size) or not size[0]:
        return out
    flat = np.concatenate([sequences[i] for i in order])
    begin = np.cumsum(size) - size
    emit, total = np.ascontiguousarray(model.emit.T), np.zeros(len(order))
    running = np.searchsorted(-size, -np.arange(size[0]), side="left")
    alpha = np.broadcast_to(model.start, (len(order), len(model.start)))
    for t, k in enumerate(running.tolist()):
        now = (alpha[:k] @ model.move if t else alpha[:k]) * emit[flat[begin[:k] + t]]
        scale = now.sum(1)
        alpha = now / scale[:, None]
        total[:k] += np.log10(scale)
    out[order] = total
    return out


@dataclass
class Scorer:
    """The model with emissions for all words of the tier; `emit` has a row for each symbol, and that of RARE is of an unseen word.

    A word that the tier lacks, of the expected counts g, has `unit` * (g + 0.5).
    """

    model: Model
    unit: np.ndarray
    base_log: float


def scorer(model: Model, others: dict[int, np.ndarray], rare: np.ndarray, corpus: Corpus) -> Scorer:
    states, symbols = model.emit.shape
    unit = model.emit[:, RARE] / (rare + 0.5 * (corpus.rare_v + 1))
    emit = np.zeros((states, len(corpus.words) + 2))
    emit[:, :symbols] = model.emit
    emit[:, symbols:] = 0.5 * unit[:, None]
    for symbol, counts in others.items():
        emit[:, symbol] = unit * (counts + 0.5)
    emit[:, RARE] = 0.5 * unit
    return Scorer(Model(model.start, model.move, emit), unit, corpus.base_log)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(table: DataFrame, held: Scorer) -> DataFrame:
    """Scores of coded texts with `found`, an array of (k, c, counts by state): k is the place among the text's different misses, c
    the number of a word's occurrences in training."""
    states = len(held.unit)
    own = table.sparkSession.sparkContext.broadcast(held)
    log_unseen = math.log10(0.5)

    def run(batches):
        c = own.value
        emit = np.ascontiguousarray(c.model.emit.T)
        for batch in (part for whole in batches for part in slices(whole)):
            if not batch.num_rows:
                continue
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = [unpacked(x) for x in columns["symbols"].to_pylist()]
            which = [np.frombuffer(x, "<u4").astype(np.int64) for x in columns["which"].to_pylist()]
            # All different misses of all texts in one row; those that were found have a row of emissions of their own.
            offset = np.concatenate(([0], np.cumsum(columns["misses"].value_lengths().to_numpy())))
            n_found = columns["found"].value_lengths().fill_null(0).to_numpy()
            found = columns["found"].flatten()
            counts = np.stack([found.field(f"s{s}").to_numpy().astype(np.float64) for s in range(states)], 1)
            known = np.repeat(offset[:-1], n_found) + found.field("k").to_numpy()
            place, logs = np.full(offset[-1], RARE), np.zeros(offset[-1])
            place[known] = len(emit) + np.arange(len(known))
            logs[known] = np.log10(found.field("c").to_numpy() + 0.5) - log_unseen
            at, of = np.concatenate([w + o for w, o in zip(which, offset)]), np.repeat(np.arange(len(texts)), [len(w) for w in which])
            flat = np.concatenate(texts)
            flat[flat == RARE] = place[at]
            n_miss = np.bincount(of, minlength=len(texts))
            n_known = columns["n_known"].to_numpy() + np.bincount(of, place[at] != RARE, minlength=len(texts)).astype(np.int64)
            base = columns["base"].to_numpy() + n_miss * (log_unseen - c.base_log) + np.bincount(of, logs[at], minlength=len(texts))
            whole = Model(c.model.start, c.model.move, np.concatenate((emit, c.unit * (counts + 0.5))).T)
            score = log10_forward(whole, np.split(flat, np.cumsum([len(t) for t in texts])[:-1]))
            yield pa.RecordBatch.from_arrays([columns["doc_id"], columns["held_out"], columns["n_tokens"], pa.array(n_known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return table.mapInArrow(run, _SCORES)


def score_texts(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS, tier_words: int = TIER_WORDS, seed: int = SEED, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Learns from the rows for which `held_out` is false, in `iterations` passes, at least one. base_score is the add-half
    unigram score, score the model's log10 probability of the whole text. A null or empty text is the end token alone. Rows
    stay one for one, repeated rows and null ids too. Without training rows every token has probability 1 in the base and the
    model is near uniform.
    """
    if iterations < 1:
        raise ValueError("at least one pass is needed")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = stage_table(word_counts(rows.where(~F.col("held_out")), "text"), "lm-counts")
    corpus = corpus_of(counts, tier_words)
    drop_table(counts)
    table = stage_table(coded(rows, corpus), "lm-coded")
    training = table.where(~F.col("held_out"))
    model = first_model(corpus, states, seed)
    for _ in range(iterations - 1):
        model, _, _ = baum_welch_step(model, summed(expected_rows(model, training, segment=segment), "kind"))
    sums = stage_table(summed(expected_rows(model, training, len(corpus.words) - corpus.own, segment), "kind", "token"), "lm-expected")
    model, others, rare = baum_welch_step(model, sums)
    words = sums.where(F.col("token").isNotNull()).drop("kind")
    # One row for each text and different word; what comes back for a text is no more than its words.
    misses = table.select("rid", F.posexplode("misses").alias("k", "token"))
    names = [F.col(f"s{s}").cast("float").alias(f"s{s}") for s in range(states)]
    found = misses.join(words, "token").groupBy("rid").agg(F.collect_list(F.struct("k", "c", *names)).alias("found"))
    done = scored(table.join(found, "rid", "left"), scorer(model, others, rare, corpus))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.n).cast("long").alias("train_tokens"), "base_score", "score")
