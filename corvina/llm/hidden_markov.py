"""A hidden Markov language model: trained by Baum-Welch over all training texts, exact likelihoods of whole texts.

Tokens are the words of a text (ASCII white space between them, A-Z lower-cased) and one end. Words are counted over the whole
training corpus as a distributed table (hash, bucket, count). The states emit symbols: the ``SYMBOLS`` most frequent words have one
each, all others share that of their bucket, a hash of their last three bytes, and so does a word that was never seen; the end has
its own. Within a bucket of N tokens and V words a word of count c has the probability (c+1)/(N+V+1), which leaves the one that
is left to unseen words, so the model is a proper distribution over words and the emission table is bounded however large the
vocabulary is.

Training: the first state of a token is told by the symbol before it, which gives the first counts. Each round of Baum-Welch
then sends the model to the tasks, which return expected counts by symbol and state; these are summed by a shuffle, so every
partition counts and none is gathered. ``SHARES`` says which share of the training texts (by a hash of their row) each round goes over: the
first ones take a part, which grows with the corpus, the last ones take all. For these sums a text is a row of windows of
``WINDOW`` tokens, each token in one, with a distribution of first states for the text's first window and one for the others.

Scoring: the scaled forward recursion over the whole text, without windows, for many texts at a time. A text of more than ``LONG``
tokens is cut into segments whose K x K products are made side by side and multiplied in order: the same likelihood.

Counts of words reach the texts in two ways. Words in the most frequent classes of counts, ``KNOWN`` of them at most, are broadcast
(16 bytes each); the others are joined by their hash and summed by row. Words are named by 64-bit hashes.

Null and empty texts have the end only. Rows that repeat count and get a result each; a null id isn't held out. Without training
texts every count is zero: an unseen word has probability 1 in its bucket, and symbols are evenly spread. Texts of any length
are read whole. Only id and text are read, whatever other columns are called. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut

STATES, SYMBOLS, BUCKETS, KNOWN = 8, 8192, 1024, 1 << 17
SHARES = (1 / 16,) * 12 + (1 / 4, 1.0, 1.0)
WINDOW, LONG, SEGMENT = 256, 8192, 1024
#: Bytes of text that are taken apart together; tokens in a batch of windows, and in a batch of texts to score.
BYTES, TOKENS, SCORED = 1 << 25, 1 << 20, 1 << 22
#: No word is spelled like the end, as words hold no white space.
END = b"\n"


def name_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 42) - (1 << 63)


def bucket_of(word: bytes, buckets: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word[-3:], 42) % buckets


def slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Of about ``BYTES`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, "right")))
        yield b.slice(at, end - at)
        at = end


def words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(words of each text, distinct words, the number of each word among these)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    every = split.flatten()
    row = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(every), 0).to_numpy(zero_copy_only=False).astype(bool)
    coded = every.filter(pa.array(full)).dictionary_encode()
    return np.bincount(row[full], minlength=len(split)), coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy()


def counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(h, b, c): each word of docs (text) by its hash, with bucket and count; the end's bucket is -1. Materialised."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                _, distinct, which = words(b.column(0))
                n = np.bincount(which, minlength=len(distinct)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([*map(name_of, distinct), name_of(END)], [*(bucket_of(w, buckets) for w in distinct), -1], [*n, b.num_rows])], ["h", "b", "c"])

    return cut(docs.select("text").mapInArrow(apply, "h long, b long, c long").groupBy("h").agg(F.max("b").alias("b"), F.sum("c").alias("c")))


def log_sums(of: np.ndarray, counts: np.ndarray, n: int, end: int) -> np.ndarray:
    """For each of n texts the sum of log10(c+1) over its tokens (``of``: their texts) and the end, which has the count ``end``. Tokens of equal counts are one product, and products are added without rounding, so that a long text, where the same few
    logarithms come again and again, is as exact as a short one."""
    value, kind = np.unique(counts, return_inverse=True)
    pair, k = np.unique(of.astype(np.int64) * max(1, len(value)) + kind, return_counts=True)
    text = pair // max(1, len(value))
    parts = (k * np.log10(value[pair % max(1, len(value))] + 1.0)).tolist()
    edge = np.searchsorted(text, np.arange(n + 1)).tolist()
    return np.array([math.fsum([*parts[lo:hi], math.log10(end + 1)]) for lo, hi in zip(edge[:-1], edge[1:], strict=True)])


@dataclass
class Vocabulary:
    """What tasks know of the words: name, count and symbol of the most frequent ones, tokens and words of each bucket."""

    names: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    n_symbols: int
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return self.n_symbols + len(self.bucket_tokens) + 1


def vocabulary(counted: DataFrame, symbols: int = SYMBOLS, buckets: int = BUCKETS, known: int = KNOWN) -> Vocabulary:
    """From (h, b, c). Words are known in whole classes of counts (64 for each power of two), the most frequent first, as long as they
    are ``known`` at most; of these the first ``symbols`` have a symbol of their own."""
    tokens, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    class_ = F.floor(F.log2("c") * 64).cast("int")
    least, room = 1 << 30, known
    for r in counted.filter("b >= 0 and c > 0").groupBy(class_.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect():
        if r.n > room:
            break
        least, room = r.k, room - r.n
    frequent = counted.filter(F.col("b") >= 0).filter(class_ >= least).toArrow()
    h, b, c = (frequent.column(x).to_numpy() for x in ("h", "b", "c"))
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort([h, -c])] = np.arange(len(h))
    n_symbols = min(symbols, len(h))
    bucket_tokens, bucket_words = np.zeros(buckets), np.zeros(buckets)
    for r in counted.filter("b >= 0").groupBy("b").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        bucket_tokens[r.b], bucket_words[r.b] = r.c, r.n
    own = rank < n_symbols
    bucket_tokens -= np.bincount(b[own], c[own], buckets)
    bucket_words -= np.bincount(b[own], minlength=buckets)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], np.where(own, rank, n_symbols + b)[order], bucket_tokens, bucket_words, n_symbols, tokens, distinct)


def encoded(docs: DataFrame, vocabulary: Vocabulary, end_count: int, buckets: int) -> DataFrame:
    """(r, doc_id, held, n_tokens, n_known, base, inner, seq, rest) from (doc_id, held, text), materialised: r names the row; n_known, base and inner
    (the logarithms of counts, and of probabilities in the buckets) are sums over the words that tasks know; seq has the symbols as
    16 bits each; rest has the hashes of the other words, whose logarithm of c+1 is to be added to both sums."""
    if vocabulary.size > 1 << 16:
        raise ValueError("symbols have 16 bits")
    v = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v_, row = v.value, TaskContext.get().partitionId() << 40
        spread = np.log10(v_.bucket_tokens + v_.bucket_words + 1)
        for whole in batches:
            for b in slices(whole, 2):
                n, distinct, which = words(b.column(2))
                h = np.fromiter(map(name_of, distinct), np.int64, len(distinct))
                at = np.minimum(np.searchsorted(v_.names, h), max(0, len(v_.names) - 1))
                there = v_.names[at] == h if len(v_.names) else np.zeros(len(h), bool)
                symbol = np.fromiter((v_.n_symbols + bucket_of(w, buckets) for w in distinct), np.int64, len(distinct))
                symbol[there] = v_.symbols[at[there]]
                log = np.zeros(len(h))
                log[there] = np.log10(v_.counts[at[there]] + 1.0)
                # within its symbol: a word with its own has probability 1
                inner = np.where(symbol < v_.n_symbols, 0.0, log - spread[np.maximum(symbol - v_.n_symbols, 0)] if len(h) else 0.0)
                of = np.repeat(np.arange(len(n)), n)
                sums = [np.bincount(of, x[which], len(n)) for x in (there.astype(float), inner)]
                seen = np.zeros(len(h), np.int64)
                seen[there] = v_.counts[at[there]]
                logs = log_sums(of, seen[which], len(n), end_count)
                place = np.arange(len(which)) + of  # each text before this one has an end
                seq = np.full(len(which) + len(n), v_.size - 1, np.uint16)
                seq[place] = symbol[which]
                edge = np.cumsum(n + 1)
                body = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, 2 * edge).astype(np.int64)), pa.py_buffer(seq)])
                far = ~there[which]
                rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of[far], minlength=len(n)))), pa.int32()), pa.array(h[which[far]]))
                made = [pa.array(row + np.arange(len(n))), b.column(0), b.column(1), pa.array(n + 1), pa.array(sums[0].astype(np.int64) + (end_count > 0)), pa.array(logs), pa.array(sums[1]), body.cast(pa.binary()), rest]
                row += len(n)
                yield pa.RecordBatch.from_arrays(made, ["r", "doc_id", "held", "n_tokens", "n_known", "base", "inner", "seq", "rest"])

    return cut(docs.mapInArrow(apply, "r long, doc_id long, held boolean, n_tokens long, n_known long, base double, inner double, seq binary, rest array<long>"))


@dataclass
class Model:
    """first: distributions of the first state of a text, and of its later windows; move: K x K; emit: symbols x K."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def fitted(first: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, weight: float = 100.0) -> Model:
    """From (expected) counts, with a weak prior: even moves, the symbols as often as in the corpus."""
    even = lambda x: (x + 1) / (x + 1).sum(-1, keepdims=True)
    emit = emit + weight * prior[:, None]
    return Model(even(first), even(move), np.ascontiguousarray(emit / emit.sum(0)))


def first_counts(symbols: np.ndarray, starts: np.ndarray, size: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state of a token is told by the symbol before it, that of a text's first token by none."""
    before = np.append(0, symbols[:-1].astype(np.int64) + 1)
    before[starts] = 0
    state = (before * 2654435761 % (1 << 32) >> 7) % states
    first, move = np.zeros((2, states)), np.zeros((states, states))
    first[0] = np.bincount(state[starts], minlength=states)
    first[1] = np.bincount(state, minlength=states)
    inside = np.ones(len(state), bool)
    inside[starts] = False
    inside = np.flatnonzero(inside)
    move += np.bincount(state[inside - 1] * states + state[inside], minlength=states * states).reshape(states, states)
    emit = np.bincount(symbols.astype(np.int64) * states + state, minlength=size * states).reshape(size, states).astype(float)
    return first, move, emit


def expected_counts(symbols: np.ndarray, lengths: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all windows of the probabilities of first states, moves and emissions, given the window's symbols."""
    size, k = m.emit.shape
    ends = np.cumsum(lengths)
    parts = -(-lengths // WINDOW)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(ends - lengths, parts) + number * WINDOW
    n = np.minimum(WINDOW, np.repeat(ends, parts) - start)
    first, move, emit = np.zeros((2, k)), np.zeros((k, k)), np.zeros((size, k))
    table, step = m.emit.astype(np.float32), m.move.astype(np.float32)
    by_length = np.argsort(-n, kind="stable")
    for at in range(0, len(by_length), TOKENS // WINDOW):
        these = by_length[at : at + TOKENS // WINDOW]
        s, length, later = start[these], n[these], (number[these] > 0).astype(int)
        steps = int(length[0])
        live = np.searchsorted(-length, -np.arange(steps), "left")  # windows longer than t
        e, alpha, scale = [], [], []
        for t in range(steps):
            e.append(table[symbols[s[: live[t]] + t]])
            a = (m.first.astype(np.float32)[later] if t == 0 else alpha[-1][: live[t]] @ step) * e[t]
            total = a.sum(1, keepdims=True)
            a /= total
            alpha.append(a)
            scale.append(total)
        beta, moved = None, np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            new = np.ones((live[t], k), np.float32)
            if t + 1 < steps:
                w = e[t + 1] * beta / scale[t + 1]
                moved += alpha[t][: live[t + 1]].T @ w
                new[: live[t + 1]] = w @ step.T
            beta = new
            alpha[t] = alpha[t] * beta  # from here on the probabilities of the states
        move += moved * m.move
        for i in (0, 1):
            first[i] += alpha[0][later == i].sum(0)
        which, state = np.concatenate([symbols[s[: live[t]] + t] for t in range(steps)]), np.concatenate(alpha)
        for i in range(k):
            emit[:, i] += np.bincount(which, state[:, i], size)
    return first, move, emit


def segment_products(symbols: np.ndarray, start: int, end: int, m: Model) -> float:
    """The logarithm of the likelihood of a long run of symbols: the products of its segments side by side, then in order."""
    k = len(m.move)
    starts = np.arange(start, end, SEGMENT)
    n = np.minimum(SEGMENT, end - starts)
    product, log = np.broadcast_to(np.eye(k), (len(starts), k, k)).copy(), np.zeros(len(starts))
    for t in range(int(n.max())):
        live = len(starts) if t < n[-1] else len(starts) - 1  # only the last one can be shorter
        p = product[:live] if t == 0 else product[:live] @ m.move
        p = p * m.emit[symbols[starts[:live] + t]][:, None, :]
        most = p.max((1, 2))
        product[:live] = p / most[:, None, None]
        log[:live] += np.log(most)
    a, total = m.first[0], 0.0
    for i in range(len(starts)):
        a = (a if i == 0 else a @ m.move) @ product[i]
        total += math.log(a.sum()) + log[i]
        a = a / a.sum()
    return total


def likelihoods(symbols: np.ndarray, lengths: np.ndarray, m: Model) -> np.ndarray:
    """The logarithm (base 10) of the likelihood of each text by the scaled forward recursion."""
    ends = np.cumsum(lengths)
    out = np.zeros(len(lengths))
    for i in np.flatnonzero(lengths > LONG):
        out[i] = segment_products(symbols, int(ends[i] - lengths[i]), int(ends[i]), m)
    order = np.argsort(-lengths, kind="stable")
    order = order[(lengths[order] <= LONG) & (lengths[order] > 0)]
    s, n = (ends - lengths)[order], lengths[order]
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(steps), "left")
    a, log = None, np.zeros(len(order))
    for t in range(steps):
        few = live[t]
        a = (np.broadcast_to(m.first[0], (few, len(m.move))) if t == 0 else a[:few] @ m.move) * m.emit[symbols[s[:few] + t]]
        total = a.sum(1)
        a /= total[:, None]
        log[:few] += np.log(total)
    out[order] = log
    return out / math.log(10)


def batched(batches: Iterator[pa.RecordBatch], column: int, tokens: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their symbols and lengths, of about so many tokens together."""
    held, n = [], 0

    def give() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        body = [x.as_buffer() for x in one.column(column)]
        return one, np.frombuffer(b"".join(body), np.uint16), np.array([x.size // 2 for x in body], np.int64)

    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) // 2)
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + tokens - n, "right")))
            held.append(b.slice(at, end - at))
            n += int(size[end - 1] - before)
            at = end
            if n >= tokens or at < b.num_rows:
                yield give()
                held, n = [], 0
    if held:
        yield give()


def gathered(rows: DataFrame, count, size: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Counts of first states, moves and emissions by ``count(symbols, lengths)``, summed over all partitions: a row for each first
    state (symbol -1 and -2), each state moved from (-3 and less) and each symbol that occurs."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, symbols, lengths in batched(batches, 0, TOKENS):
            new = count(symbols, lengths)
            sums = new if sums is None else tuple(x + y for x, y in zip(sums, new, strict=True))
        if sums is not None:
            first, move, emit = sums
            some = np.flatnonzero(emit.any(1))
            label = np.concatenate([[-1, -2], -3 - np.arange(states), some])
            values = np.concatenate([first, move, emit[some]])
            yield pa.RecordBatch.from_arrays([pa.array(label), *(pa.array(np.ascontiguousarray(x)) for x in values.T)], ["symbol", *(f"s{i}" for i in range(states))])

    found = rows.select("seq").mapInArrow(apply, "symbol long, " + ", ".join(f"s{i} double" for i in range(states)))
    found = found.groupBy("symbol").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(states))).toArrow()
    label = found.column("symbol").to_numpy()
    values = np.stack([found.column(f"s{i}").to_numpy() for i in range(states)], 1).reshape(-1, states)
    first, move, emit = np.zeros((2, states)), np.zeros((states, states)), np.zeros((size, states))
    first[-1 - label[(label < 0) & (label >= -2)]] = values[(label < 0) & (label >= -2)]
    move[-3 - label[label <= -3]] = values[label <= -3]
    emit[label[label >= 0]] = values[label >= 0]
    return first, move, emit


def trained(rows: DataFrame, v: Vocabulary, end_count: int, states: int = STATES, shares: tuple[float, ...] = SHARES) -> Model:
    """From the training rows (r, seq), materialised."""
    prior = np.zeros(v.size)
    own = v.symbols < v.n_symbols
    prior[v.symbols[own]] = v.counts[own]
    prior[v.n_symbols : -1], prior[-1] = v.bucket_tokens, end_count
    prior = (prior + 1) / (prior + 1).sum()
    size, part = v.size, lambda share: rows.filter(F.pmod(F.xxhash64("r"), F.lit(1 << 20)) < int(share * (1 << 20)))
    model = fitted(*gathered(part(shares[0]), lambda s, n: first_counts(s, np.cumsum(n) - n, size, states), size, states), prior)
    for share in shares:
        sent = rows.sparkSession.sparkContext.broadcast(model)
        model = fitted(*gathered(part(share), lambda s, n, sent=sent: expected_counts(s, n, sent.value), size, states), prior)
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows of :func:`encoded` without seq and rest, with ``chain``, the likelihood of the symbols. No shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kept = ["r", "doc_id", "held", "n_tokens", "n_known", "base", "inner"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, symbols, lengths in batched(batches, len(kept), SCORED):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(likelihoods(symbols, lengths, sent.value))], [*kept, "chain"])

    return rows.select(*kept, "seq").mapInArrow(apply, "r long, doc_id long, held boolean, n_tokens long, n_known long, base double, inner double, chain double")


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", states: int = STATES, symbols: int = SYMBOLS, buckets: int = BUCKETS, known: int = KNOWN, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, learned from those not held out.
    base_score: the add-one unigram model; score: the hidden Markov model."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    counted = counts(given.filter(~F.col("held")), buckets)
    end = counted.filter("b < 0").first()
    end_count = end.c if end else 0
    v = vocabulary(counted, symbols, buckets, known)
    rows = encoded(given, v, end_count, buckets)
    model = trained(rows.filter(~F.col("held")), v, end_count, states, shares)
    far = rows.select("r", F.explode("rest").alias("h")).join(counted.select("h", "c"), "h").select("r", "c").repartition("r")
    far = far.groupBy("r", "c").agg(F.count("*").alias("k"))  # as in log_sums; both groupings use the rows' partitions
    far = far.groupBy("r").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("l"))
    out = scored(rows, model).join(far, "r", "left")
    k, l = F.coalesce("k", F.lit(0)), F.coalesce("l", F.lit(0.0))  # noqa: E741
    return out.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + k).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + l - F.col("n_tokens") * math.log10(v.tokens + v.distinct + 1)).alias("base_score"), (F.col("inner") + l + F.col("chain")).alias("score"),
    )
