"""Language-model scores of whole documents: a gated recurrent network trained in numpy inside Spark tasks.

Words are counted over all training documents. The most frequent ones, and buckets
of rarer words by their last byte, are the network's tokens; a rare word's
probability is its bucket's times its share of the bucket, so every word of every
text has one and they sum to 1. The output is factored into a class and a word
within the class.

Training is truncated backpropagation on all runs of windows of every training
document, each in one round that a hash chooses, so it grows with the input
(``share`` above 1 learns from one run in so many only). In a round each task starts
from the same parameters and learns from its part; changes are averaged in a tree of
small sums and only the result, of fixed size, comes to the driver. Scoring carries the state over all windows of a document.

Counts of words beyond the table that tasks hold (``table_words``) meet their
occurrences in a join, so that no vocabulary has to fit anywhere.

Defined results: a null or empty text is the end token alone; rows that repeat are
scored alike; without training documents all words are unknown and the network is
untrained; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import arrow_batches, stored, text_of

HIDDEN, CLASSES, CLASS_SIZE = 16, 64, 64
TOKENS = CLASSES * CLASS_SIZE
#: Rare words fall into buckets by their last byte.
BUCKETS = 32
WINDOW, RUN = 32, 8
END = b""
#: Targets of one class worked on together: their logits stay in a core's cache.
CHUNK = 256


def is_held_out(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 5 == 1


def split_words(text: str) -> list[bytes]:
    """Words with A-Z in lower case; ``bytes`` methods touch ASCII only."""
    return text.encode().lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a one-column table of texts; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split_words(text))
                seen[END] += 1
                if len(seen) > 300_000:  # parts are summed after the shuffle
                    yield table()
        yield table()

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def bucket_of(word: bytes) -> int:
    return word[-1] % BUCKETS if word else 0


@dataclass
class Vocabulary:
    """What tasks know of the words: the table's ids and counts, and the rare buckets' totals."""

    words: list[bytes]  # by falling count, the end token among them
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    bucket_total: np.ndarray
    bucket_distinct: np.ndarray

    def __post_init__(self):
        self.named = min(len(self.words), TOKENS - BUCKETS)
        mass = np.concatenate((self.counts[: self.named], self.bucket_total)).astype(float)
        #: Place of each named word and bucket among the network's tokens, by falling mass.
        self.place = np.empty(len(mass), np.int64)
        self.place[np.argsort(-mass, kind="stable")] = np.arange(len(mass))
        self.mass = np.zeros(TOKENS)
        self.mass[self.place] = mass
        floor = self.total + 0.5 * (self.distinct + 1)
        self.base = np.log10((self.counts + 0.5) / floor) if len(self.counts) else np.zeros(0)
        self.base_unknown = math.log10(0.5 / floor)
        self.bucket_floor = self.bucket_total + 0.5 * (self.bucket_distinct + 1)
        self.end_id = self.words.index(END) if END in self.words else -1

    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Word -> index; per index the network's token, and the log10 share within it."""
        index = {w: i for i, w in enumerate(self.words)}
        token = np.zeros(len(self.words) + BUCKETS, np.uint16)
        share = np.zeros(len(self.words) + BUCKETS)
        token[: self.named] = self.place[: self.named]
        for i in range(self.named, len(self.words)):
            b = bucket_of(self.words[i])
            token[i] = self.place[self.named + b]
            share[i] = math.log10((self.counts[i] + 0.5) / self.bucket_floor[b])
        token[len(self.words) :] = self.place[self.named :]
        return index, token, share


def vocabulary(counts: DataFrame, table_words: int) -> Vocabulary:
    """Totals and the table of the most frequent words, at most ``table_words`` and the end token.

    A histogram of the counts says how frequent a word must be, so nothing is sorted
    in one task.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    hist = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect()
    totals = sum(r["c"] for r in hist), sum(r["v"] for r in hist)
    least, taken = 1 << 30, 0
    for r in sorted(hist, key=lambda r: -r["level"]):
        if taken + r["v"] > table_words:
            break
        least, taken = r["level"], taken + r["v"]
    top = counts.where((level >= least) | (F.length("word") == 0)).toArrow()
    pairs = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    words, c = [w for w, _ in pairs], np.array([n for _, n in pairs], np.int64)
    last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int")
    bucket = F.when(F.length("word") > 0, F.pmod(last, F.lit(BUCKETS))).otherwise(0).alias("b")
    sums = counts.groupBy(bucket).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    total, distinct = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        total[r["b"]], distinct[r["b"]] = r["c"], r["v"]
    for w, n in zip(words[: TOKENS - BUCKETS], c[: TOKENS - BUCKETS]):
        total[bucket_of(w)] -= n
        distinct[bucket_of(w)] -= 1
    return Vocabulary(words, c, totals[0], totals[1], total, distinct)


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per row (row, id, held_out, text): the network's tokens, sums over the table's words, and the words beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, token, share = vocab.tables()
        n_table, base, known = len(vocab.words), vocab.base, vocab.counts > 0
        end = index.get(END, n_table)
        for batch in batches:
            ids, n_tokens, n_known, base_sum, share_sum, beyond, times = [], [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                words = split_words(text)
                seq = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                seq = np.append(seq, end)
                lost = np.nonzero(seq < 0)[0].tolist()
                rest = Counter([words[i] for i in lost])
                seq[lost] = [n_table + bucket_of(words[i]) for i in lost]
                inside = seq[seq < n_table]
                ids.append(token[seq].tobytes())
                n_tokens.append(len(seq))
                n_known.append(int(known[inside].sum()))
                base_sum.append(float(base[inside].sum()))
                share_sum.append(float(share[inside].sum()))
                beyond.append(list(rest))
                times.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                 pa.array(base_sum, pa.float64()), pa.array(share_sum, pa.float64()), pa.array(ids, pa.binary()),
                 pa.array(beyond, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["row", "id", "held_out", "n_tokens", "n_known", "base", "share", "tokens", "beyond", "times"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, share double, tokens binary, beyond array<binary>, times array<bigint>")


# The network. Arrays are float32; gates are ordered update, reset, candidate.


def initial(vocab: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters that begin as the unigram model."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    mass = (vocab.mass + 0.5).reshape(CLASSES, CLASS_SIZE)
    of_class = mass.sum(axis=1)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "E": normal(0.3, TOKENS, 3 * h), "U": normal(0.25, h, 3 * h), "b": np.zeros(3 * h, np.float32),
        "Wc": normal(0.05, h, CLASSES), "bc": np.log(of_class / of_class.sum()).astype(np.float32),
        "Wo": normal(0.05, TOKENS, h), "bo": np.log(mass / of_class[:, None]).reshape(-1).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


def forward(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, batch, hidden) after each input (steps, batch)."""
    k = HIDDEN
    out = np.empty((len(x), len(h), k), np.float32)
    table = p["E"] + p["b"]
    for t in range(len(x)):
        a, u = table[x[t]], h @ p["U"]
        zr = _sigmoid(a[:, : 2 * k] + u[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
        if keep is not None:
            keep.append((h, z, r, n, u[:, 2 * k :]))
        h = n + z * (h - n)
        out[t] = h
    return out


#: Logits beyond this are shifted by their largest before ``exp``; parameters that bound them below need no shift.
SAFE = 60.0
#: Sums of the two softmaxes that stand side by side.
SIDES = np.repeat(np.eye(2, dtype=np.float32), [CLASSES, CLASS_SIZE], axis=0)


def side_by_side(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights and biases of the class softmax and each class's word softmax as one matrix per class; whether logits may be large."""
    weights = np.empty((CLASSES, HIDDEN, CLASSES + CLASS_SIZE), np.float32)
    weights[:, :, :CLASSES] = p["Wc"]
    weights[:, :, CLASSES:] = p["Wo"].reshape(CLASSES, CLASS_SIZE, HIDDEN).transpose(0, 2, 1)
    bias = np.empty((CLASSES, CLASSES + CLASS_SIZE), np.float32)
    bias[:, :CLASSES] = p["bc"]
    bias[:, CLASSES:] = p["bo"].reshape(CLASSES, CLASS_SIZE)
    # States lie between -1 and 1. Sums of exponentials neither overflow nor vanish within the bound.
    reach = np.abs(weights).sum(axis=1)
    large = float((reach + bias).max()) > SAFE or min(float((bias - reach)[:, k].max(axis=1).min()) for k in (slice(None, CLASSES), slice(CLASSES, None))) < -SAFE
    return weights, bias, large


def output(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None, sides: tuple | None = None):
    """Natural log-probabilities of targets ``y`` given states ``h``; with ``grads``, also the gradient of h.

    Targets are sorted by class once; a class's targets meet both softmaxes in one small matrix.
    """
    of = (y // CLASS_SIZE).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    hs, words = h[order], CLASSES + (y % CLASS_SIZE)[order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=CLASSES)))).tolist()
    weights, bias, large = sides or side_by_side(p)
    size = CLASSES + CLASS_SIZE
    logits, rows = np.empty((CHUNK, size), np.float32), np.arange(CHUNK)
    sums, hit = np.empty((len(y), 2), np.float32), np.empty(len(y), np.float32)
    if grads is not None:
        sorted_dh = np.empty_like(hs)
        by_weight, by_bias = np.zeros((CLASSES, HIDDEN, size), np.float32), np.zeros((CLASSES, size), np.float32)
    for c in range(CLASSES):
        for a in range(starts[c], starts[c + 1], CHUNK):
            b = min(a + CHUNK, starts[c + 1])
            q, near, word = logits[: b - a], rows[: b - a], words[a:b]
            np.matmul(hs[a:b], weights[c], out=q)
            q += bias[c]
            if large:
                sided = q.reshape(b - a, 2, -1)
                sided -= sided.max(axis=2, keepdims=True)
            np.add(q[:, c], q[near, word], out=hit[a:b])
            np.exp(q, out=q)
            s = np.matmul(q, SIDES, out=sums[a:b])
            if grads is not None:
                q.reshape(b - a, 2, -1)[...] *= np.reciprocal(s)[:, :, None]
                q[:, c] -= 1
                q[near, word] -= 1
                np.matmul(q, weights[c].T, out=sorted_dh[a:b])
                by_weight[c] += hs[a:b].T @ q
                by_bias[c] += q.sum(axis=0)
    sorted_score = hit - np.log(sums).sum(axis=1)
    if grads is not None:
        grads["Wc"], grads["bc"] = by_weight[:, :, :CLASSES].sum(axis=0), by_bias[:, :CLASSES].sum(axis=0)
        grads["Wo"] = np.ascontiguousarray(by_weight[:, :, CLASSES:].transpose(0, 2, 1)).reshape(TOKENS, HIDDEN)
        grads["bo"] = by_bias[:, CLASSES:].reshape(TOKENS)
    score = np.empty_like(sorted_score)
    score[order] = sorted_score
    dh = None
    if grads is not None:
        dh = np.empty_like(sorted_dh)
        dh[order] = sorted_dh
    return score, dh


def backward(p: dict[str, np.ndarray], x: np.ndarray, kept: list, dout: np.ndarray, grads: dict[str, np.ndarray]) -> None:
    """Backpropagation through one window; ``dout`` (steps, batch, hidden) is the gradient of its states."""
    k = HIDDEN
    dU = np.zeros_like(p["U"])
    da = np.empty((*x.shape, 3 * k), np.float32)
    carry = np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, un = kept[t]
        d = dout[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        g = np.concatenate((d * (h - n) * z * (1 - z), dn * un * r * (1 - r), dn * r), axis=1)
        dU += h.T @ g
        carry = d * z + g @ p["U"].T
        da[t, :, : 2 * k], da[t, :, 2 * k :] = g[:, : 2 * k], dn
    grads["U"], grads["b"] = dU, da.sum(axis=(0, 1))
    ids, flat = x.reshape(-1), da.reshape(-1, 3 * k)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.nonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))[0]
    grads["E_rows"], grads["E"] = sorted_ids[first], np.add.reduceat(flat[order], first, axis=0)


class Learner:
    """Adagrad on windows of runs, with the counts that weigh each row's change."""

    def __init__(self, start: dict[str, np.ndarray], rate: float):
        self.start, self.rate = start, rate
        self.p = {k: v.copy() for k, v in start.items()}
        self.sq = {k: np.full_like(v, 1e-6) for k, v in start.items()}
        self.tokens = 0
        self.inputs, self.classes = np.zeros(TOKENS), np.zeros(CLASSES)

    def learn(self, runs: list[np.ndarray], end: int) -> None:
        """One pass over runs (previous token, then the targets) of up to RUN windows, state carried within a run."""
        runs = sorted(runs, key=len, reverse=True)
        lengths = np.array([len(r) - 1 for r in runs])
        seqs = np.full((lengths[0] + 1, len(runs)), -1, np.int64)
        for i, r in enumerate(runs):
            seqs[: len(r), i] = r
        h = np.zeros((len(runs), HIDDEN), np.float32)
        for w in range(0, int(lengths[0]), WINDOW):
            live = int((lengths > w).sum())
            h = h[:live]
            y = seqs[w + 1 : w + 1 + WINDOW, :live]
            x = seqs[w : w + len(y), :live]
            x = np.where(x < 0, end, x)
            kept: list = []
            states = forward(self.p, x, h, kept)
            h = states[-1]
            real = y.reshape(-1) >= 0
            grads: dict[str, np.ndarray] = {}
            flat = states.reshape(-1, HIDDEN)
            _, dh = output(self.p, flat[real], y.reshape(-1)[real], grads)
            dout = np.zeros_like(flat)
            dout[real] = dh
            backward(self.p, x, kept, dout.reshape(states.shape), grads)
            self._step(grads, int(real.sum()))
            self.tokens += int(real.sum())
            self.inputs += np.bincount(x.reshape(-1), minlength=TOKENS)
            self.classes += np.bincount(y.reshape(-1)[real] // CLASS_SIZE, minlength=CLASSES)

    def _step(self, grads: dict[str, np.ndarray], n: int) -> None:
        rows = grads.pop("E_rows")
        for k, g in grads.items():
            g = np.clip(g / np.float32(n), -1, 1)
            at = rows if k == "E" else slice(None)
            self.sq[k][at] += g * g
            self.p[k][at] -= np.float32(self.rate) * g / np.sqrt(self.sq[k][at])

    def changes(self) -> np.ndarray:
        """All changes times their weights, then the weights: one vector of fixed length."""
        d = {k: self.p[k] - self.start[k] for k in self.p}
        per_class = np.repeat(self.classes, CLASS_SIZE)
        dense = np.concatenate([d[k].reshape(-1) for k in ("U", "b", "Wc", "bc")]) * self.tokens
        return np.concatenate((
            (d["E"] * self.inputs[:, None]).reshape(-1), (d["Wo"] * per_class[:, None]).reshape(-1), d["bo"] * per_class, dense,
            self.inputs, self.classes, [self.tokens])).astype(np.float64)


def averaged(start: dict[str, np.ndarray], total: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters after a round, from the sum of all tasks' ``changes``."""
    h, at = HIDDEN, 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        size = math.prod(shape)
        at += size
        return total[at - size : at].reshape(shape)

    e, wo, bo = take(TOKENS, 3 * h), take(TOKENS, h), take(TOKENS)
    dense = {k: take(*start[k].shape) for k in ("U", "b", "Wc", "bc")}
    inputs, classes, tokens = np.maximum(take(TOKENS), 1), np.maximum(take(CLASSES), 1), max(1.0, float(take(1)[0]))
    per_class = np.repeat(classes, CLASS_SIZE)
    change = {"E": e / inputs[:, None], "Wo": wo / per_class[:, None], "bo": bo / per_class} | {k: v / tokens for k, v in dense.items()}
    return {k: (start[k] + change[k]).astype(np.float32) for k in start}


def _mix(row: int, run: int) -> int:
    """A well-mixed number of a run of a row, the same in every attempt."""
    x = (row * 0x9E3779B97F4A7C15 + run * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & (2**64 - 1)
    x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & (2**64 - 1)
    return x ^ (x >> 32)


FAN = 32
#: Batches that are put together from runs sorted by length.
SORTED_BATCHES = 8


def train(rows: DataFrame, vocab: Vocabulary, rounds: int, share: int, rate: float, batch_runs: int = 256) -> dict[str, np.ndarray]:
    """Rounds over (row, tokens): each learns from its own ``1 / (share * rounds)`` of the runs, all together from ``1 / share``."""
    p = initial(vocab)
    end = int(vocab.place[vocab.end_id]) if 0 <= vocab.end_id < vocab.named else 0
    step = WINDOW * RUN

    def learn(learner: Learner, runs: list[np.ndarray]) -> None:
        """Batches of runs of like length: few steps are taken for some of a batch's runs only."""
        runs.sort(key=len)
        for k in range(0, len(runs), batch_runs):
            learner.learn(runs[k : k + batch_runs], end)

    def one(params: dict[str, np.ndarray], turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learner, runs = Learner(params, rate), []
            for batch in batches:
                for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n = len(raw) // 2
                    for k in range(0, (n + step - 1) // step):
                        if _mix(row, k) % (share * rounds) != turn:
                            continue
                        seq = np.frombuffer(raw, np.uint16)
                        before = end if k == 0 else int(seq[k * step - 1])
                        runs.append(np.concatenate(([before], seq[k * step : (k + 1) * step])).astype(np.int64))
                        if len(runs) == SORTED_BATCHES * batch_runs:
                            learn(learner, runs)
                            runs = []
            learn(learner, runs)
            if learner.tokens:
                yield _blocks(learner.changes())

        return run

    for turn in range(rounds):
        parts = rows.mapInArrow(one(p, turn), "block int, size int, data binary").withColumn("part", F.spark_partition_id())
        total = summed(parts)
        if total is None:
            break
        p = averaged(p, total)
    return p


BLOCK = 1 << 14


def _blocks(vector: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(vector), BLOCK)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(cuts)), pa.int32()), pa.array([len(vector)] * len(cuts), pa.int32()), pa.array([vector[i : i + BLOCK].tobytes() for i in cuts], pa.binary())],
        ["block", "size", "data"])


def summed(parts: DataFrame) -> np.ndarray | None:
    """Sum of the vectors that tasks gave in blocks (part, block, size, data), in a tree of ``FAN`` children."""

    def add(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        total = sum(np.frombuffer(x, np.float64) for x in table["data"].to_pylist())
        return pa.table({"part": first["part"], "block": first["block"], "size": first["size"], "data": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, block int, size int, data binary"
    level = stored(parts.select("part", "block", "size", "data"))
    most = level.agg(F.max("part")).first()[0]
    if most is None:
        return None
    while most > 0:
        level = level.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("part", "block").applyInArrow(add, schema)
        most //= FAN
    blocks = level.select("block", "data").collect()  # one vector of fixed length
    return np.concatenate([np.frombuffer(r["data"], np.float64) for r in sorted(blocks, key=lambda r: r["block"])])


def log_probs(p: dict[str, np.ndarray], docs: list[np.ndarray], end: int, targets: int = 1 << 14) -> np.ndarray:
    """log10-likelihood of whole token sequences, the state carried from window to window.

    A window has about ``targets`` targets: it gets longer as fewer documents go on.
    """
    lengths = np.array([len(d) for d in docs])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([docs[i] for i in order]).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    total = np.zeros(len(docs))
    h = np.zeros((len(docs), HIDDEN), np.float32)
    sides = side_by_side(p)
    w = 0
    while w < lengths[0]:
        live = int(np.searchsorted(-lengths, -w, side="left"))  # documents longer than w
        h = h[:live]
        steps = min(max(16, targets // live), int(lengths[0]) - w)
        at = w + np.arange(steps)
        real = at[:, None] < lengths[None, :live]
        where = np.minimum(starts[None, :live] + at[:, None], len(flat) - 1)
        y = flat[where]
        x = np.where(at[:, None] > 0, flat[np.maximum(where - 1, 0)], end)
        states = forward(p, x, h)
        h = states[-1]
        score, _ = output(p, states[real], y[real], sides=sides)
        total[:live] += np.bincount(np.nonzero(real)[1], weights=score, minlength=live)
        w += steps
    out = np.empty(len(docs))
    out[order] = total / math.log(10)
    return out


#: Documents of like length that are scored together, so that states stay in a core's
#: cache and few steps are taken for one document alone; and their tokens at most.
POOL, POOL_TOKENS = 640, 4_000_000


def network_scores(rows: DataFrame, p: dict[str, np.ndarray], vocab: Vocabulary) -> DataFrame:
    """(row, network) for (row, tokens)."""
    end = int(vocab.place[vocab.end_id]) if 0 <= vocab.end_id < vocab.named else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(pool: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            found = log_probs(p, [d for _, d in pool], end)
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in pool], pa.int64()), pa.array(found, pa.float64())], ["row", "network"])

        pools: dict[int, list] = {}
        sizes: Counter = Counter()
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.frombuffer(raw, np.uint16)
                kind = len(tokens).bit_length()
                pools.setdefault(kind, []).append((row, tokens))
                sizes[kind] += len(tokens)
                if len(pools[kind]) >= POOL or sizes[kind] >= POOL_TOKENS:
                    yield scored(pools.pop(kind))
                    sizes[kind] = 0
        # What is left is scored in turn of length, so that long documents run beside each other.
        left = [x for kind in sorted(pools) for x in pools[kind]]
        while left:
            size = take = 0
            while take < min(POOL, len(left)) and size < POOL_TOKENS:
                take += 1
                size += len(left[-take][1])
            yield scored(left[-take:])
            del left[-take:]

    return rows.mapInArrow(run, "row bigint, network double")


def score(
    docs: DataFrame, id: str = "doc_id", text: str = "text", held_out: Column | None = None,
    table_words: int = 1 << 18, rounds: int = 3, share: int = 1, rate: float = 0.2,
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text)."""
    arrow_batches(docs.sparkSession)
    held = is_held_out(F.col(id)) if held_out is None else held_out
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.coalesce(held, F.lit(False)).alias("held_out"), text_of(text).alias("text"))
    counts = stored(word_counts(rows.where(~F.col("held_out")).select("text")))
    vocab = vocabulary(counts, table_words)
    seen = stored(encoded(rows, vocab))
    learned = train(seen.where(~F.col("held_out")).select("row", "tokens"), vocab, rounds, share, rate)
    network = network_scores(seen.select("row", "tokens"), learned, vocab)

    # Words beyond the table: rare, so no key of this join is hot.
    beyond = seen.select("row", F.explode(F.arrays_zip("beyond", "times")).alias("w")).select("row", F.col("w.beyond").alias("word"), F.col("w.times").alias("n"))
    last = F.pmod(F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int"), F.lit(BUCKETS))
    floors = F.array(*[F.lit(float(x)) for x in vocab.bucket_floor])
    c = F.coalesce("c", F.lit(0))
    rest = beyond.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * F.log10((c + 0.5) / (vocab.total + 0.5 * (vocab.distinct + 1)))).alias("base2"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.get(floors, last))).alias("share2"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    # The end token is unknown only when there is nothing to learn from.
    lost = F.lit(0.0 if vocab.end_id >= 0 else vocab.base_unknown)
    return seen.drop("tokens", "beyond", "times").join(network, "row").join(rest, "row", "left").select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("n_known") + zero("known2")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2") + lost).alias("base_score"), (F.col("network") + F.col("share") + zero("share2")).alias("score"))
