"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads runs of SPAN bytes forwards and backwards, labels every byte
position, and a document's language is the one with the largest mean probability
over all its positions.  It is trained in numpy by backpropagation through time on
a bounded sample of labelled documents, and applied to whole texts inside tasks,
thousands of runs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import tokens
from postlake.llm.common import NO_ID, batch_texts, id_of

#: Bytes that the network reads in one run.
SPAN = 48
_RUNS = 2048  # runs computed together


@dataclass
class Network:
    """x: 256 x 3H inputs of the gates (update, reset, candidate) for each byte; h: H x 3H; one pair each direction."""

    langs: list[str]
    x: list[np.ndarray]
    h: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @property
    def size(self) -> int:
        return self.h[0].shape[0]

    def weights(self) -> list[np.ndarray]:
        return [*self.x, *self.h, self.out, self.bias]


def new_network(langs: list[str], size: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Network(langs, [draw(256, 3 * size) for _ in range(2)], [draw(size, 3 * size) for _ in range(2)], draw(2 * size, len(langs)), np.zeros(len(langs), np.float32))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    v *= np.float32(0.5)
    np.tanh(v, out=v)
    v += 1
    v *= np.float32(0.5)
    return v


def _pass(x: np.ndarray, u: np.ndarray, runs: np.ndarray, inside: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States after each position of one direction; positions outside a run keep the state at 0.  runs: positions x runs."""
    steps, number, size = len(runs), runs.shape[1], u.shape[0]
    states = np.zeros((steps, number, size), np.float32)
    h = np.zeros((number, size), np.float32)
    for t in range(steps):
        a, g = x[runs[t]], h @ u
        zr = _sigmoid(a[:, : 2 * size] + g[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(a[:, 2 * size :] + r * g[:, 2 * size :])
        new = n + z * (h - n)
        new *= inside[t][:, None]
        if trace is not None:
            trace.append((h, z, r, n, g[:, 2 * size :]))
        h = states[t] = new
    return states


def position_probabilities(net: Network, runs: np.ndarray, inside: np.ndarray, traces: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Softmax at each position (positions x runs x languages), and the states of both directions."""
    forth = _pass(net.x[0], net.h[0], runs, inside, None if traces is None else traces[0])
    back = _pass(net.x[1], net.h[1], runs[::-1], inside[::-1], None if traces is None else traces[1])[::-1]
    states = np.concatenate((forth, back), axis=2)
    logits = states @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    return logits / logits.sum(axis=2, keepdims=True), states


def loss_and_gradients(net: Network, runs: np.ndarray, inside: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over positions, and its gradients by backpropagation through time."""
    traces: list[list] = [[], []]
    probs, states = position_probabilities(net, runs, inside, traces)
    weight = inside.astype(np.float32) / max(float(inside.sum()), 1.0)
    rows = np.arange(len(labels))
    loss = float(-(np.log(probs[:, rows, labels] + 1e-12) * weight).sum())
    dlogits = probs.copy()
    dlogits[:, rows, labels] -= 1
    dlogits *= weight[:, :, None]
    flat = dlogits.reshape(-1, dlogits.shape[2])
    dout, dbias = states.reshape(-1, states.shape[2]).T @ flat, flat.sum(0)
    dstates = dlogits @ net.out.T
    size, dx, dh_ = net.size, [], []
    for way in (0, 1):
        order = slice(None) if way == 0 else slice(None, None, -1)
        bytes_, within = runs[order], inside[order]
        given = dstates[order][:, :, way * size : (way + 1) * size]
        u, du, carried = net.h[way], np.zeros_like(net.h[way]), np.zeros((runs.shape[1], size), np.float32)
        inputs = np.zeros((len(runs), runs.shape[1], 3 * size), np.float32)
        for t in range(len(runs) - 1, -1, -1):
            h, z, r, n, gn = traces[way][t]
            d = (given[t] + carried) * within[t][:, None]
            dn = d * (1 - z) * (1 - n * n)
            dz, dr = d * (h - n) * z * (1 - z), dn * gn * r * (1 - r)
            dg = np.concatenate((dz, dr, dn * r), axis=1)
            inputs[t] = np.concatenate((dz, dr, dn), axis=1)
            du += h.T @ dg
            carried = d * z + dg @ u.T
        per_byte = np.zeros((256, 3 * size), np.float32)
        np.add.at(per_byte, bytes_.ravel(), inputs.reshape(-1, 3 * size))
        dx.append(per_byte)
        dh_.append(du)
    return loss, [*dx, *dh_, dout, dbias]


def train_network(samples: list[bytes], labels: list[str], size: int = 8, epochs: int = 3, batch: int = 256, rate: float = 0.02, least_steps: int = 300, seed: int = 0) -> Network:
    """Fit by Adam on runs of up to SPAN bytes, each position of which should get the run's label.

    Small samples are gone through more often than ``epochs`` times, until there
    were ``least_steps`` batches.
    """
    langs = sorted(set(labels))
    net = new_network(langs, size, seed)
    runs, inside = _runs_of(samples)
    target = np.array([langs.index(x) for x in labels])
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    batches = -(-len(samples) // batch)
    epochs = max(epochs, -(-least_steps // batches))
    total = epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for lo in range(0, len(order), batch):
            pick, step = order[lo : lo + batch], step + 1
            _, gradients = loss_and_gradients(net, runs[:, pick], inside[:, pick], target[pick])
            pace = rate * (1 - 0.9 * step / total)
            for w, g, m, v in zip(net.weights(), gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _runs_of(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    runs = np.zeros((SPAN, len(samples)), np.uint8)
    inside = np.zeros((SPAN, len(samples)), np.float32)
    for i, sample in enumerate(samples):
        part = np.frombuffer(sample[:SPAN], np.uint8)
        runs[: len(part), i], inside[: len(part), i] = part, 1
    return runs, inside


def fit(docs: DataFrame, max_docs: int = 4000, runs_each: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> Network | None:
    """Train on ``runs_each`` runs from random places of at most ``max_docs`` labelled documents.

    They are those with the smallest hashes of their texts; equal texts count once.
    Languages are those of the sample.  Without labelled text there is no network.
    """
    text = F.col(text_col).cast("string")
    room = F.greatest(F.length(text) - SPAN, F.lit(0)) + 1
    places = [F.substring(text, (F.pmod(F.xxhash64(text, F.lit(i)), room) + 1).cast("int"), F.lit(SPAN)) for i in range(runs_each)]
    rows = docs.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.xxhash64(text).alias("h"), F.col(lang_col).alias("lang"), F.array_distinct(F.array(*places)).alias("runs"))
    rows = rows.groupBy("h", "lang").agg(F.min("runs").alias("runs")).orderBy("h", "lang").limit(max_docs).collect()
    pairs = [(run.encode(), row["lang"]) for row in rows for run in row["runs"] if run]
    return train_network([p[0] for p in pairs], [p[1] for p in pairs], **training) if pairs else None


def _steps(x: np.ndarray, u: np.ndarray, runs: np.ndarray, inside: np.ndarray, order: range) -> Iterator[tuple[int, np.ndarray]]:
    """Position and states (H x runs) along one direction, in buffers that are used again.

    The same arithmetic as _pass: gates have half their weights, so that one tanh
    serves all, as sigmoid(v) = (1 + tanh(v / 2)) / 2.
    """
    size, number = u.shape[0], runs.shape[1]
    half = np.repeat(np.float32([0.5, 0.5, 1.0]), size)
    table, weights = np.ascontiguousarray((x * half).T), np.ascontiguousarray((u * half).T)
    h, a, g = np.zeros((size, number), np.float32), np.empty((3 * size, number), np.float32), np.empty((3 * size, number), np.float32)
    for t in order:
        np.take(table, runs[t], axis=1, out=a, mode="clip")
        np.matmul(weights, h, out=g)
        gates, n, gn = a[: 2 * size], a[2 * size :], g[2 * size :]
        gates += g[: 2 * size]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= np.float32(0.5)
        gn *= gates[size:]
        n += gn
        np.tanh(n, out=n)
        h -= n
        h *= gates[:size]
        h += n
        if inside[t] is not None:
            h *= inside[t]
        yield t, h


def pooled(net: Network, runs: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Sums of position_probabilities over the positions of each run (runs x languages)."""
    within = [None if row.all() else row for row in inside]
    forth, back = np.ascontiguousarray(net.out[: net.size].T), np.ascontiguousarray(net.out[net.size :].T)
    logits = np.empty((len(runs), len(net.langs), runs.shape[1]), np.float32)
    for t, h in _steps(net.x[0], net.h[0], runs, within, range(len(runs))):
        np.matmul(forth, h, out=logits[t])
    sums = np.zeros((len(net.langs), runs.shape[1]), np.float32)
    for t, h in _steps(net.x[1], net.h[1], runs, within, range(len(runs) - 1, -1, -1)):
        row = logits[t]
        row += back @ h
        row += net.bias[:, None]
        row -= row.max(axis=0)
        np.exp(row, out=row)
        row *= inside[t] / row.sum(axis=0)
        sums += row
    return sums.T


def document_probabilities(net: Network, text: pa.Array) -> np.ndarray:
    """Mean probability of each language over all byte positions of each row; rows without bytes have zeros."""
    data, offsets = tokens.text_bytes(text)
    lengths = np.diff(offsets)
    number = -(-lengths // SPAN)
    row = np.repeat(np.arange(len(lengths)), number)
    starts = offsets[row] + (np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(number)[:-1]), number)) * SPAN
    ends = np.minimum(starts + SPAN, offsets[row + 1])
    padded = np.append(data, np.zeros(SPAN, np.uint8))
    sums = np.zeros((len(lengths), len(net.langs)))
    for lo in range(0, len(row), _RUNS):
        part = slice(lo, lo + _RUNS)
        at = starts[part] + np.arange(SPAN)[:, None]
        np.add.at(sums, row[part], pooled(net, padded[at], (at < ends[part]).astype(np.float32)))
    return sums / np.maximum(lengths, 1)[:, None]


def detect_languages(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Label whole texts: the id, lang_pred, score (the mean probability of that language) and probabilities by language.

    ``und`` with score 0 is the answer for texts that are null or hold no letter,
    and for every text if there is no network.  Equal probabilities go to the
    language first in code point order.  Null and repeated ids are rows like
    others; other columns are not read.
    """
    batch_texts(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if net is None:
        none = F.array().cast("array<double>")
        return rows.select(id_of(F.col("k")).alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("probabilities"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for part in tokens.slices(batch):
                probs = document_probabilities(net, part.column("text"))
                letters, best = np.asarray(part.column("letters")), probs.argmax(1)
                langs = [net.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.minimum(probs[np.arange(len(best)), best], 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(langs, pa.string()), pa.array(score), pa.array(list(probs), pa.list_(pa.float64()))], names=["k", "lang_pred", "score", "probabilities"])

    out = rows.mapInArrow(run, "k long, lang_pred string, score double, probabilities array<double>")
    return out.select(id_of(F.col("k")).alias(id_col), "lang_pred", "score", "probabilities")
