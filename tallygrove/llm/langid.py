"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads one byte a step, with a gated unit that has one gate for forgetting and for what of the state goes into the new value; it labels every byte, and is trained in numpy by backpropagation through time. A document's language is the one of
highest probability, averaged over all its bytes. Many texts are read side by side, longest first, so that the ones still going on are the first ones.
A text of more than STRETCH bytes is read as stretches of that many; each direction reads the LEAD bytes before its stretch as well, whose labels count in the
stretch they lie in, so its state comes from the text there too.

Training takes at most per_language documents of each language (a bound, by hash order), and of each one at most piece characters from a place
the hash gives; only rows with a language whose crc32(doc_id as text) modulo 4 is not 2. Language, source and doc_id are no input of a prediction.

Defined cases: null text, and text without any letter, is "und" with score 0; a null doc_id is not held out and not trained on; where no row can be
trained on, every text is "und"; repeated rows get equal results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.llm.common import blocks, emit, frees

STRETCH, LEAD, HIDDEN = 2048, 128, 8
PREDICTIONS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Weights of both directions and of the labels; bytes come as arrays of windows x steps."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.w = {"o": scale(2 * hidden, len(labels), by=hidden**-0.5), "c": np.zeros(len(labels), dtype=np.float32)}
        for side in "fb":
            self.w[f"e{side}"] = scale(256, 2 * hidden, by=0.5)
            self.w[f"u{side}"] = scale(hidden, 2 * hidden, by=hidden**-0.5)
            self.w[f"i{side}"] = np.zeros(2 * hidden, dtype=np.float32)

    def step(self, side: str, letters: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(new state, what backpropagation needs of the step)."""
        h = self.hidden
        x = self.w[f"e{side}"].take(letters, axis=0) + self.w[f"i{side}"]
        a = state @ self.w[f"u{side}"]
        gate, recurrent = sigmoid(x[:, :h] + a[:, :h]), a[:, h:]
        new = np.tanh(x[:, h:] + gate * recurrent)
        return state + gate * (new - state), (gate, new, state, recurrent)

    def states(self, windows: np.ndarray, side: str, tape: list | None = None) -> np.ndarray:
        """Hidden states (steps x windows x hidden) of one direction; the tape takes what backpropagation needs."""
        n, steps = windows.shape
        kind = self.w["o"].dtype
        out, state = np.empty((steps, n, self.hidden), dtype=kind), np.zeros((n, self.hidden), dtype=kind)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            state, record = self.step(side, windows[:, t], state)
            out[t] = state
            if tape is not None:
                tape.append((t, *record))
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """steps x windows x labels."""
        both = np.concatenate([self.states(windows, "f"), self.states(windows, "b")], axis=2)
        return softmax(both @ self.w["o"] + self.w["c"])

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of every byte's label."""
        h, (n, steps) = self.hidden, windows.shape
        tapes = {"f": [], "b": []}
        both = np.concatenate([self.states(windows, side, tapes[side]) for side in "fb"], axis=2)
        delta = softmax(both @ self.w["o"] + self.w["c"])
        delta[:, np.arange(n), labels] -= 1
        delta /= n * steps
        out = {k: np.zeros_like(v) for k, v in self.w.items()}
        out["o"] = np.einsum("tnh,tnk->hk", both, delta)
        out["c"] = delta.sum(axis=(0, 1))
        back = delta @ self.w["o"].T
        for k, side in enumerate("fb"):
            u, flow, of_step = self.w[f"u{side}"], np.zeros((n, h), dtype=delta.dtype), np.empty((steps, n, 2 * h), dtype=delta.dtype)
            for t, gate, new, before, recurrent in reversed(tapes[side]):
                flow = flow + back[t, :, k * h : (k + 1) * h]
                d_new = flow * gate * (1 - new * new)
                d_gate = (flow * (new - before) + d_new * recurrent) * gate * (1 - gate)
                of_step[t, :, :h], of_step[t, :, h:] = d_gate, d_new
                d_a = np.concatenate([d_gate, d_new * gate], axis=1)
                out[f"u{side}"] += before.T @ d_a
                flow = flow * (1 - gate) + d_a @ u.T
            out[f"i{side}"] = of_step.sum(axis=(0, 1))
            np.add.at(out[f"e{side}"], windows.T.ravel(), of_step.reshape(-1, 2 * h))
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    p /= p.sum(axis=-1, keepdims=True)
    return p


def train(samples: list[tuple[bytes, int]], labels: list[str], *, rounds: int = 300, batch: int = 96, steps: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam, with a rate that falls to nothing, over random windows of the samples (bytes, number of the label), every third round shorter ones."""
    net, rng = Network(labels, seed=seed), np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    by_label = [[i for i, (_, k) in enumerate(samples) if k == label] for label in range(len(labels))]
    for step in range(1, rounds + 1):
        size = int(rng.integers(8, steps)) if step % 3 == 0 else steps
        chosen = [by_label[k][rng.integers(len(by_label[k]))] for k in rng.integers(len(labels), size=batch)]
        windows = np.empty((batch, size), dtype=np.uint8)
        for row, i in enumerate(chosen):
            text = samples[i][0]
            at = int(rng.integers(max(1, len(text) - size + 1)))
            windows[row] = np.resize(np.frombuffer(text, dtype=np.uint8)[at : at + size], size)  # a shorter text repeats
        grads = net.gradients(windows, np.array([samples[i][1] for i in chosen]))
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            slower = rate * 0.5 * (1 + np.cos(np.pi * step / rounds))
            net.w[k] -= (slower * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def stretches(lengths: list[int], stretch: int, lead: int) -> np.ndarray:
    """(text, where reading begins, where labels begin, where they end, where reading ends) of every stretch."""
    return np.array([(k, max(0, s - lead), s, min(n, s + stretch), min(n, s + stretch + lead)) for k, n in enumerate(lengths) for s in range(0, n, stretch)], dtype=np.int64).reshape(-1, 5)


def pooled(net: Network, texts: list[bytes], *, width: int = 1024, stretch: int = STRETCH, lead: int = LEAD) -> np.ndarray:
    """texts x labels: probabilities averaged over all bytes of each text (zeros for an empty one)."""
    lengths = [len(t) for t in texts]
    plan = stretches(lengths, stretch, lead)
    plan = plan[np.argsort(plan[:, 1] - plan[:, 4], kind="stable")]
    out = np.zeros((len(texts), len(net.labels)))
    for i in range(0, len(plan), width):
        of, begin, first, last, end = plan[i : i + width].T
        sizes = end - begin
        data = np.zeros((len(of), int(sizes[0])), dtype=np.uint8)
        for row, (k, a, b) in enumerate(zip(of.tolist(), begin.tolist(), end.tolist(), strict=True)):
            data[row, : b - a] = np.frombuffer(texts[k], dtype=np.uint8, count=b - a, offset=a)
        np.add.at(out, of, _sums(net, data, sizes, first - begin, last - begin))
    return out / np.maximum(lengths, 1)[:, None]


def _sums(net: Network, data: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows x labels: probabilities summed over the bytes first to last of each row of data; rows are in falling order of their sizes.

    What Network.step() does, for states and gates as hidden x rows; the gate's sigmoid is a tangent of halved inputs.
    """
    n, steps = data.shape
    h, rows = net.hidden, np.arange(n)
    going = np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()  # rows with a byte at a step
    logits = np.zeros((len(net.labels), steps * n), dtype=np.float32)
    columns = np.ascontiguousarray(data.T)
    half = np.where(np.arange(2 * h) < h, 0.5, 1).astype(np.float32)
    for side, own in (("f", net.w["o"][:h].T), ("b", net.w["o"][h:].T)):
        table, u = (net.w[f"e{side}"] + net.w[f"i{side}"]) * half, np.ascontiguousarray((net.w[f"u{side}"] * half).T)
        own, state = np.ascontiguousarray(own), np.zeros((h, n), dtype=np.float32)
        for t in range(steps):
            k = going[t]
            state = state[:, :k]
            at = None if side == "f" else sizes[:k] - 1 - t
            x = np.ascontiguousarray(table.take(columns[t, :k] if at is None else columns[at, rows[:k]], axis=0).T)
            a = u @ state
            gate, new = a[:h], a[h:]
            gate += x[:h]
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            new *= gate
            new += x[h:]
            np.tanh(new, out=new)
            new -= state
            new *= gate
            state = state + new
            if at is None:
                logits[:, t * n : t * n + k] += own @ state
            else:
                logits[:, at * n + rows[:k]] += own @ state
    out = np.zeros((n, len(net.labels)))
    lift = np.abs(net.w["o"]).sum(axis=0).max() + np.abs(net.w["c"]).max() > 60  # states lie within -1 and 1, so exponentials are safe below that
    for t in range(0, steps, 64):
        at = np.arange(t, min(t + 64, steps))[:, None]
        p = logits[:, t * n : (t + len(at)) * n] + net.w["c"][:, None]
        if lift:
            p -= p.max(axis=0)
        np.exp(p, out=p)
        p *= ((at >= first) & (at < last)).ravel() / p.sum(axis=0)
        out += p.reshape(len(p), len(at), n).sum(axis=1).T
    return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, piece: int = 65_536, salts: int = 64) -> list[tuple[bytes, str]]:
    """Text with its language: per_language rows at most of each, by the order of a hash of doc_id and text. First the hashes alone are ranked, in salted parts of a language and
    then among what these leave; then the rows of the hashes chosen are read."""
    text = F.col(text_col).cast("string")
    known = docs.filter(F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2) & text.rlike(r"\p{L}"))
    hashed = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text).alias("h"), text.alias("text"))
    ranked = hashed.select("lang", "h").withColumn("salt", F.pmod("h", F.lit(salts)))
    for group in (("lang", "salt"), ("lang",)):
        ranked = ranked.withColumn("k", F.row_number().over(W.partitionBy(*group).orderBy("h"))).filter(F.col("k") <= per_language)
    chosen = F.broadcast(ranked.select("lang", "h").distinct())  # per_language rows of each language at most
    begin = (F.pmod(F.xxhash64(F.lit(1), "h"), F.greatest(F.lit(1), F.length("text") - piece + 1)) + 1).cast("int")
    rows = hashed.join(chosen, ["lang", "h"]).select("lang", "h", F.substring("text", begin, F.lit(piece)).alias("piece")).distinct()
    return [(r["piece"].encode(), r["lang"]) for r in rows.orderBy("lang", "h", "piece").select("lang", "piece").collect()]


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    found = sample(docs, id_col, text_col, lang_col, per_language)
    labels = sorted({lang for _, lang in found})
    net = train([(t, labels.index(lang)) for t, lang in found], labels) if labels else None

    @frees
    def run(batches):
        for block in blocks(batches, "text", block_bytes):
            texts = [t or b"" for t in block.column("text").to_pylist()]
            lettered = block.column("lettered").to_pylist()
            mean = pooled(net, [t if ok else b"" for t, ok in zip(texts, lettered, strict=True)]) if net else np.zeros((len(texts), 1))
            best = mean.argmax(axis=1)
            known = [net is not None and bool(ok) for ok in lettered]
            yield emit({
                "doc_id": block.column("doc_id").combine_chunks(), "held_out": block.column("held_out").combine_chunks(),
                "lang_pred": [net.labels[k] if ok else "und" for k, ok in zip(best.tolist(), known, strict=True)],
                "score": [min(1.0, float(s)) if ok else 0.0 for s, ok in zip(mean.max(axis=1), known, strict=True)],
            }, PREDICTIONS)

    text = F.col(text_col).cast("string")
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
