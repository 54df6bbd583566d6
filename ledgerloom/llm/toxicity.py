"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word enters as its own vector and as the sum of its character 4-grams' vectors. The
network reads overlapping windows of words; a document's score is that of its worst
window. Trained in numpy; scoring is numpy inside Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, labelled_sample, mix, split_words

SAMPLE_ROWS = 8_000
PREDICT_AT = 0.3
WINDOW, STRIDE = 48, 40
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
CHAR_SLOTS = 1 << 16
WORD_SLOTS = 1 << 18
LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.0025
STEPS, BATCH = 400, 64
HIDE = 0.3
SLICE_WORDS = 150_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def char_slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all character 4-grams, and where each word's grams start.

    A word of fewer bytes is one gram; the gram at a word's start has a slot of its own.
    """
    lengths = words.end - words.start
    grams = np.maximum(1, lengths - 3)
    first = np.concatenate([[0], np.cumsum(grams)[:-1]]) if len(grams) else np.zeros(0, np.int64)
    at = np.arange(int(grams.sum())) - np.repeat(first - words.start, grams)
    data = np.concatenate([words.data, np.zeros(4, np.uint8)]).astype(np.uint32)
    code = data[at] | data[at + 1] << np.uint32(8) | data[at + 2] << np.uint32(16) | data[at + 3] << np.uint32(24)
    short = np.minimum(lengths, 4).astype(np.uint32)
    if len(grams):
        code[first] &= ((np.uint64(1) << (np.uint64(8) * short)) - np.uint64(1)).astype(np.uint32)
        mixed = code * np.uint32(0x9E3779B1)
        mixed[first] = code[first] * np.uint32(0x85EBCA6B) + np.uint32(1)
        return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64), first
    return np.zeros(0, np.int64), first


@dataclass
class Network:
    """Parameters; gates stand in the order update, reset, candidate."""

    keys: np.ndarray  # word hash held by each slot
    rows: np.ndarray  # its row of ``word``; 0 for any other word
    word: np.ndarray
    char: np.ndarray
    dense: dict[str, np.ndarray] = field(default_factory=dict)

    def word_rows(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(46)).astype(np.int64)
        return np.where(self.keys[slot] == hashes, self.rows[slot], 0)

    def inputs(self, rows: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Word vectors beside scaled sums of character vectors."""
        if not len(rows):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        sums = np.add.reduceat(self.char[slots], first, axis=0)
        return np.concatenate([self.word[rows], sums * _scale(first, len(slots))[:, None]], axis=1)


def _scale(first: np.ndarray, total: int) -> np.ndarray:
    return (1 / np.sqrt(np.diff(np.append(first, total)))).astype(np.float32)


def fresh_network(hashes: np.ndarray, seed: int = 7) -> Network:
    """Random parameters; ``hashes`` are the words with vectors of their own."""
    rng = np.random.default_rng(seed)
    keys, rows = np.zeros(WORD_SLOTS, np.uint64), np.zeros(WORD_SLOTS, np.int64)
    slot = (hashes >> np.uint64(46)).astype(np.int64)
    keys[slot], rows[slot] = hashes, np.arange(1, len(hashes) + 1)
    normal = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    net = Network(keys, rows, normal(len(hashes) + 1, WORD_DIM, scale=0.1), normal(CHAR_SLOTS, CHAR_DIM, scale=0.1))
    for side in ("f", "b"):
        net.dense[f"w{side}"] = normal(d, 3 * h, scale=0.4)
        net.dense[f"u{side}"] = normal(h, 3 * h, scale=0.3)
        net.dense[f"c{side}"] = np.zeros(3 * h, np.float32)
    net.dense |= {"attend": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3), "bias": np.full(1, -1, np.float32)}
    return net


def _recur(xw: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States of one direction over (time, windows, 3 * hidden) projected inputs."""
    steps, n, h = xw.shape[0], xw.shape[1], u.shape[0]
    state, states, trail = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32), []
    for t in range(steps):
        a = state @ u
        gates = sigmoid(xw[t, :, : 2 * h] + a[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        cand = np.tanh(xw[t, :, 2 * h :] + r * a[:, 2 * h :])
        new = state + mask[t] * (1 - z) * (cand - state)
        if keep:
            trail.append((state, z, r, cand, a[:, 2 * h :]))
        state = states[t] = new
    return states, trail


def _recur_back(d_states: np.ndarray, trail: list, u: np.ndarray, mask: np.ndarray):
    steps, n, h = d_states.shape
    d_xw, d_u, carry = np.empty((steps, n, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        state, z, r, cand, a = trail[t]
        d = carry + d_states[t]
        inner = d * mask[t]
        d_cand = inner * (1 - z) * (1 - cand * cand)
        d_z = inner * (state - cand) * z * (1 - z)
        d_r = d_cand * a * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_cand * r], axis=1)
        d_xw[t] = np.concatenate([d_z, d_r, d_cand], axis=1)
        d_u += state.T @ d_a
        carry = d - inner * (1 - z) + d_a @ u.T
    return d_xw, d_u


def _pool(states: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, attention weights, pooled state) per window."""
    energy = np.where(mask[:, :, 0] > 0, states @ p["attend"], -np.inf)
    weights = np.exp(energy - energy.max(axis=0))
    weights /= weights.sum(axis=0)
    pooled = (states * weights[:, :, None]).sum(axis=0)
    return pooled @ p["out"] + p["bias"][0], weights, pooled


def window_logits(projected: np.ndarray, index: np.ndarray, mask: np.ndarray, p: dict) -> np.ndarray:
    """Logit of each window; ``index`` and ``mask`` are (time, windows)."""
    h3 = 3 * HIDDEN
    m = mask[:, :, None].astype(np.float32)
    x = projected[index]
    forward, _ = _recur(x[:, :, :h3], p["uf"], m)
    backward, _ = _recur(x[::-1, :, h3:], p["ub"], m[::-1])
    return _pool(np.concatenate([forward, backward[::-1]], axis=2), m, p)[0]


def project(x: np.ndarray, p: dict) -> np.ndarray:
    return np.concatenate([x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]], axis=1)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows that cover every word: (time, windows) index and mask, owner."""
    counts = np.diff(first)
    number = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    owner = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    begin = np.minimum(k * STRIDE, np.maximum(0, counts[owner] - WINDOW))
    index = (first[owner] + begin)[None, :] + np.arange(WINDOW)[:, None]
    mask = (np.arange(WINDOW)[:, None] + begin[None, :]) < counts[owner][None, :]
    return np.where(mask, index, first[owner][None, :]), mask, owner


def score_texts(texts: list[str | None], net: Network) -> np.ndarray:
    """Probability of each whole text; 0 without words."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size < SLICE_WORDS):
            size += len(texts[end] or "") // 5
            end += 1
        words = split_words(texts[at:end])
        slots, first = char_slots(words)
        projected = project(net.inputs(net.word_rows(words.hashes()), slots, first), net.dense)
        index, mask, owner = windows_of(words.first)
        worst = np.full(end - at, -np.inf)
        for i in range(0, len(owner), 2048):
            logits = window_logits(projected, index[:, i : i + 2048], mask[:, i : i + 2048], net.dense)
            np.maximum.at(worst, owner[i : i + 2048], logits)
        out[at:end] = np.where(np.isfinite(worst), sigmoid(worst), 0.0)
        at = end
    return out


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, ..."""
    counts = end - start
    return np.arange(int(counts.sum())) + np.repeat(start - (np.cumsum(counts) - counts), counts)


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            params[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


def _scatter_step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """Adagrad on the touched rows of a table."""
    touched, inverse = np.unique(rows, return_inverse=True)
    total = np.zeros((len(touched), table.shape[1]), np.float32)
    np.add.at(total, inverse, grads)
    seen[touched] += (total * total).mean(axis=1)
    table[touched] -= rate * total / np.sqrt(seen[touched] + 1e-8)[:, None]


@dataclass
class Sample:
    """Words of the sampled documents as flat arrays, and the windows over them."""

    hashes: np.ndarray  # of each word
    grams: np.ndarray  # number of character grams of each word
    slots: np.ndarray  # of all grams, word by word
    first: np.ndarray  # first[d]:first[d + 1] are the words of document d

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> Sample:
        words = split_words(texts)
        slots, first = char_slots(words)
        grams = np.diff(np.append(first, len(slots)))
        return cls(words.hashes(), grams.astype(np.int32), slots.astype(np.uint16), words.first)

    @classmethod
    def joined(cls, parts: list[Sample]) -> Sample:
        counts = np.concatenate([np.diff(p.first) for p in parts])
        flat = (np.concatenate([getattr(p, c) for p in parts]) for c in ("hashes", "grams", "slots"))
        return cls(*flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def fit_network(texts: list[str | None], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> Network:
    """Trains on whole texts; of each the worst window carries the label."""
    parts = [Sample.of_texts(texts[i : i + 256]) for i in range(0, max(1, len(texts)), 256)]
    return fit_sample(Sample.joined(parts), y, steps, batch, seed)


def fit_sample(sample: Sample, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> Network:
    """Trains on the sampled documents; those without words take no part."""
    index, mask, owner = windows_of(sample.first)
    begin_of, size_of = index[0].copy() if len(owner) else np.zeros(0, np.int64), mask.sum(axis=0)
    del index, mask
    worded = np.flatnonzero(np.diff(sample.first) > 0)
    y, number = y[worded], np.bincount(owner, minlength=len(sample.first) - 1)[worded]
    if not len(worded):
        net = fresh_network(np.zeros(0, np.uint64), seed)
        net.dense["out"][:], net.dense["bias"][:] = 0, -6.0
        return net
    hashes, slots, grams_of = sample.hashes, sample.slots, sample.grams
    first = np.concatenate([[0], np.cumsum(grams_of)[:-1]]).astype(np.int64)
    doc_of_word = np.repeat(np.arange(len(sample.first) - 1, dtype=np.int32), np.diff(sample.first))
    # Each word once per document; words of several documents get vectors of their own.
    order = np.lexsort((doc_of_word, hashes))
    h, d = hashes[order], doc_of_word[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    found, documents = np.unique(h[fresh], return_counts=True)
    common = documents >= max(LEAST_DOCUMENTS, LEAST_SHARE * len(worded))
    net = fresh_network(found[common], seed)
    del h, d, order, fresh, doc_of_word
    if len(np.unique(y)) < 2:
        net.dense["out"][:] = 0
        net.dense["bias"][:] = -6.0 if not y.any() else 6.0
        return net
    gram_ends = first + grams_of
    rows, scale = net.word_rows(hashes).astype(np.int32), (1 / np.sqrt(grams_of)).astype(np.float32)
    spans = np.concatenate([[0], np.cumsum(number)])
    rng, adam = np.random.default_rng(seed), _Adam(0.01)
    seen_word, seen_char = np.zeros(len(net.word), np.float32), np.zeros(CHAR_SLOTS, np.float32)
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    span = np.arange(WINDOW)[:, None]
    p, h3 = net.dense, 3 * HIDDEN
    for step in range(steps):
        docs = np.concatenate([rng.choice(c, batch // 2) for c in classes])
        windows = _ranges(spans[docs], spans[docs + 1])
        of = np.repeat(np.arange(len(docs)), spans[docs + 1] - spans[docs])
        begin, size = begin_of[windows], size_of[windows]
        mask = span < np.minimum(size, WINDOW)[None, :]
        index = np.where(mask, begin[None, :] + span, begin[None, :])
        if step < steps // 5:  # at first any window of a document
            pick = rng.random(len(windows))
        else:
            used, at = np.unique(index, return_inverse=True)
            grams = _ranges(first[used], gram_ends[used])
            local = np.concatenate([[0], np.cumsum((gram_ends - first)[used])[:-1]])
            x = net.inputs(rows[used], slots[grams], local)
            pick = window_logits(project(x, p), at.reshape(index.shape), mask, p)
        last = np.lexsort((pick, of))
        chosen = last[np.append(np.flatnonzero(of[last][1:] != of[last][:-1]), len(last) - 1)]
        index, mask, target = index[:, chosen], mask[:, chosen], y[docs[of[chosen]]].astype(np.float32)
        used, at = np.unique(index, return_inverse=True)
        at = at.reshape(index.shape)
        grams = _ranges(first[used], gram_ends[used])
        counts = (gram_ends - first)[used]
        local = np.concatenate([[0], np.cumsum(counts)[:-1]])
        own = np.where(rng.random(len(used)) < HIDE, 0, rows[used])  # hidden words leave the characters to tell
        x = net.inputs(own, slots[grams], local)
        projected = project(x, p)[at]
        m = mask[:, :, None].astype(np.float32)
        forward, trail_f = _recur(projected[:, :, :h3], p["uf"], m, True)
        backward, trail_b = _recur(projected[::-1, :, h3:], p["ub"], m[::-1], True)
        states = np.concatenate([forward, backward[::-1]], axis=2)
        logit, weights, pooled = _pool(states, m, p)
        g = (sigmoid(logit) - target) / len(target)
        grads = {"bias": g.sum(keepdims=True), "out": pooled.T @ g}
        d_pooled = g[:, None] * p["out"]
        d_weights = (states * d_pooled).sum(axis=2)
        d_energy = weights * (d_weights - (weights * d_weights).sum(axis=0))
        d_states = weights[:, :, None] * d_pooled + d_energy[:, :, None] * p["attend"]
        grads["attend"] = np.einsum("tnh,tn->h", states, d_energy)
        half = HIDDEN
        d_f, grads["uf"] = _recur_back(d_states[:, :, :half], trail_f, p["uf"], m)
        d_b, grads["ub"] = _recur_back(d_states[::-1, :, half:], trail_b, p["ub"], m[::-1])
        d_xw = np.concatenate([d_f, d_b[::-1]], axis=2).reshape(-1, 2 * h3)
        per_word = np.zeros((len(used), 2 * h3), np.float32)
        np.add.at(per_word, at.reshape(-1), d_xw)
        grads["cf"], grads["cb"] = per_word[:, :h3].sum(axis=0), per_word[:, h3:].sum(axis=0)
        grads["wf"], grads["wb"] = x.T @ per_word[:, :h3], x.T @ per_word[:, h3:]
        d_x = per_word[:, :h3] @ p["wf"].T + per_word[:, h3:] @ p["wb"].T
        _scatter_step(net.word, seen_word, own, d_x[:, :WORD_DIM], 0.1)
        d_char = np.repeat(d_x[:, WORD_DIM:] * scale[used][:, None], counts, axis=0)
        _scatter_step(net.char, seen_char, slots[grams], d_char, 0.1)
        adam.step(p, grads)
    return net


def train_toxicity(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text: str = "text"
) -> Network:
    """Trains on about ``rows`` labelled documents (``labels``: doc_id, toxic).

    The sample is chosen by a hash of the id and its ids are broadcast (about ``rows``
    numbers). Of each sampled document all words reach the driver, as hashes and gram
    slots and not as text, so that the worst of all its windows carries the label. The
    number of training steps is fixed. Without labels nothing is rejected.
    """
    known = labelled_sample(docs.sparkSession, labels, "toxic", rows)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                s = Sample.of_texts(part.column(1).to_pylist())
                at = np.concatenate([[0], np.cumsum(s.grams)])[s.first]
                heads = [" ".join((t or "").lower()[:400].split()) for t in part.column(1).to_pylist()]
                spans = list(zip(s.first[:-1], s.first[1:], at[:-1], at[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(heads, pa.string()), pa.array([s.hashes[a:e].tobytes() for a, e, _, _ in spans], pa.binary()),
                        pa.array([s.grams[a:e].tobytes() for a, e, _, _ in spans], pa.binary()),
                        pa.array([s.slots[a:e].tobytes() for _, _, a, e in spans], pa.binary()),
                    ],
                    names=["y", "head", "hashes", "grams", "slots"],
                )

    chosen = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(known), "id")
    found = chosen.select("y", "t").mapInArrow(run, "y int, head string, hashes binary, grams binary, slots binary").toArrow()
    # An order of the rows that no partitioning changes.
    keys = zip(found.column("y").to_pylist(), found.column("head").to_pylist(), found.column("hashes").to_pylist(), strict=True)
    order = [n for _, n in sorted((key, n) for n, key in enumerate(keys))]
    y = found.column("y").to_numpy()[order]

    def flat(column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
        values = found.column(column).take(pa.array(order, pa.int64())).to_pylist()
        return np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64)

    hashes, sizes = flat("hashes", "<u8")
    first = np.concatenate([[0], np.cumsum(sizes // 8)]).astype(np.int64)
    sample = Sample(hashes, flat("grams", "<i4")[0], flat("slots", "<u2")[0], first)
    del found
    return fit_sample(sample, y.astype(int))


def score_toxicity(docs: DataFrame, net: Network, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row: the probability that the whole text is toxic.

    Every overlapping window of every text is scored. Null, empty and wordless texts score
    0; null ids and repeated rows stay; further columns are ignored; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                p = score_texts(part.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def accepted_documents(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` would not reject, all columns as they are.

    Rows are judged where they stand, so null and repeated ids make no difference.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                p = score_texts(part.column(at).to_pylist(), shared.value)
                yield part.filter(pa.array(p < PREDICT_AT))

    return docs.mapInArrow(run, docs.schema)
