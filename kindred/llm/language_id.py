"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in consecutive windows of ``WINDOW`` bytes, forwards and backwards; every
position gets a distribution over languages from both states, and a document's probabilities are the
mean over all of its positions. All bytes of all texts are read, whatever their length.

Training is backpropagation through time in numpy, on a bounded sample: about ``DOCS_PER_LANGUAGE``
documents per language, drawn by row (so that an id or a text that is repeated very often does not make the
sample larger) at a rate that follows from the language's count, and at most ``WINDOWS_PER_DOC`` windows of each. Only the text and the language of training documents
are used; source and id never are inputs.

Defined cases: null text and text without a letter are ``und`` with score 0; rows with a null language
are scored and not learned from; a null id counts as a training document; repeated rows count each;
without training documents everything is ``und``; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .common import unit_draw
from .mixing import numbered

WINDOW = 128
HIDDEN = 8
DOCS_PER_LANGUAGE = 300
WINDOWS_PER_DOC = 8
STEPS, BATCH, RATE = 260, 96, 0.02
GROUP = 2048  #: windows that one numpy step advances
CHUNK_BYTES = 1_500_000

_LETTER = regex.compile(r"\p{L}")


class Direction:
    """One gated recurrent layer; arrays are [unit, window]. The input weights are one column per byte, biases included."""

    NAMES = ("x", "u", "c")

    def __init__(self, rng: np.random.Generator) -> None:
        self.x = (rng.standard_normal((3 * HIDDEN, 256)) * 0.1).astype(np.float32)
        self.u = (rng.standard_normal((3 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.c = np.zeros((HIDDEN, 1), dtype=np.float32)

    def run(self, rows: list[np.ndarray], tape: list | None = None) -> Iterator[np.ndarray]:
        """The states after each row of bytes."""
        h = np.zeros((HIDDEN, len(rows[0])), dtype=np.float32)
        two = 2 * HIDDEN
        for row in rows:
            a = self.x.take(row, axis=1)
            b = self.u @ h
            gates = a[:two]
            gates += b[:two]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            own = b[two:]
            own += self.c
            n = a[two:]
            n += gates[:HIDDEN] * own
            np.tanh(n, out=n)
            z = gates[HIDDEN:]
            new = h - n
            new *= z
            new += n
            if tape is not None:
                tape.append((h, gates, own, n))
            h = new
            yield h

    def back(self, rows: list[np.ndarray], tape: list, grads: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the weights from those of the states, backwards through time."""
        du, dc, inputs = np.zeros_like(self.u), np.zeros_like(self.c), []
        carry = np.zeros_like(grads[0])
        for (h, gates, own, n), grad in zip(reversed(tape), reversed(grads), strict=True):
            dh = grad + carry
            r, z = gates[:HIDDEN], gates[HIDDEN:]
            dn = dh * (1 - z) * (1 - n * n)
            dr, dz = dn * own * r * (1 - r), dh * (h - n) * z * (1 - z)
            downs = np.concatenate([dr, dz, dn * r])
            du += downs @ h.T
            dc += (dn * r).sum(axis=1, keepdims=True)
            carry = dh * z + self.u.T @ downs
            inputs.append(np.concatenate([dr, dz, dn]))
        flat, where = np.concatenate(inputs, axis=1), np.concatenate(rows[::-1])
        dx = np.stack([np.bincount(where, weights=line, minlength=256) for line in flat]).astype(np.float32)
        return {"x": dx, "u": du, "c": dc}


class Network:
    def __init__(self, languages: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Direction(rng), Direction(rng)
        self.v = (rng.standard_normal((len(languages), 2 * HIDDEN)) * 0.3).astype(np.float32)
        self.b = np.zeros((len(languages), 1), dtype=np.float32)

    def _positions(self, rows: list[np.ndarray], tapes: tuple | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(position, forward state, backward state, probabilities) from the last position to the first."""
        first = list(self.ahead.run(rows, tapes[0] if tapes else None))
        for back, h in enumerate(self.behind.run(rows[::-1], tapes[1] if tapes else None)):
            t = len(rows) - 1 - back
            p = self.v[:, :HIDDEN] @ first[t]
            p += self.v[:, HIDDEN:] @ h
            p += self.b
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield t, first[t], h, p

    def pooled(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over positions of the probabilities, [window, language]; positions from ``lengths`` on are padding."""
        out = np.empty((len(windows), len(self.languages)), dtype=np.float64)
        for at in range(0, len(windows), GROUP):
            rows = list(np.ascontiguousarray(windows[at : at + GROUP].T))
            length = lengths[at : at + GROUP]
            short = length.min() < WINDOW
            total = np.zeros((len(self.languages), len(length)), dtype=np.float32)
            for t, _, _, p in self._positions(rows):
                total += p * (length > t) if short else p
            out[at : at + GROUP] = total.T
        return out

    def train(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, seed: int = 12) -> None:
        rng = np.random.default_rng(seed)
        weights = {(k, n): getattr(d, n) for k, d in (("a", self.ahead), ("b", self.behind)) for n in Direction.NAMES} | {("v", ""): self.v, ("v", "b"): self.b}
        moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in weights.items()}
        share = np.bincount(labels, minlength=len(self.languages)).astype(float)
        chance = (1 / share[labels]) / (1 / share[labels]).sum()
        for step in range(1, STEPS + 1):
            pick = rng.choice(len(windows), size=BATCH, p=chance)
            rows, truth, length = list(np.ascontiguousarray(windows[pick].T)), labels[pick], lengths[pick]
            tapes: tuple[list, list] = ([], [])
            scale = np.float32(1 / max(length.sum(), 1))
            dv, db = np.zeros_like(self.v), np.zeros_like(self.b)
            to_first, to_second = [None] * WINDOW, []
            for t, f, h, p in self._positions(rows, tapes):
                p[truth, np.arange(BATCH)] -= 1
                p *= (length > t) * scale
                dv += p @ np.concatenate([f, h]).T
                db += p.sum(axis=1, keepdims=True)
                to_first[t] = self.v[:, :HIDDEN].T @ p
                to_second.append(self.v[:, HIDDEN:].T @ p)
            grads = {("a", n): g for n, g in self.ahead.back(rows, tapes[0], to_first).items()}
            grads |= {("b", n): g for n, g in self.behind.back(rows[::-1], tapes[1], to_second).items()}
            grads |= {("v", ""): dv, ("v", "b"): db}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * (1 - 0.9 * step / STEPS)
            for k, w in weights.items():
                g = grads[k] * min(1.0, 1.0 / (norm + 1e-9))
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes in each, first window of each text); a text without bytes has one empty window."""
    count = [max(1, -(-len(t) // WINDOW)) for t in texts]
    joined = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, count, strict=True))
    starts = np.cumsum([0, *count])[:-1]
    lengths = np.full(sum(count), WINDOW)
    lengths[np.cumsum(count) - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, count, strict=True)]
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, WINDOW), lengths, starts


def train(docs: DataFrame) -> Network | None:
    """The network from the training documents of ``docs`` (``doc_id, text, lang, held_out``); None without any."""
    usable = docs.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = materialise(usable.groupBy("lang").agg((DOCS_PER_LANGUAGE / F.count("*")).alias("rate")))
    if rates.isEmpty():
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if not _LETTER.search(text):
                    continue
                for i in range(min(WINDOWS_PER_DOC, -(-len(data) // WINDOW))):
                    at = len(data) * i // WINDOWS_PER_DOC if len(data) > WINDOWS_PER_DOC * WINDOW else i * WINDOW
                    langs.append(lang)
                    found.append(data[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(found, type=pa.binary())], names=["lang", "bytes"])

    # a draw depends on a row's id and its number among equal rows, not on where it lies
    seeded = numbered(usable.select("doc_id", "text", "lang", F.col("lang").alias("source"))).join(rates, "lang")
    sample = seeded.filter(unit_draw(F.col("_mix_seed"), "language") < F.col("rate")).select("lang", "text").mapInArrow(cut, "lang string, bytes binary")
    rows = sorted((r.lang, bytes(r.bytes)) for r in sample.collect())  # bounded: languages x documents x windows
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    windows, lengths, _ = windows_of([data for _, data in rows])
    network = Network(languages)
    network.train(windows, lengths, np.array([languages.index(lang) for lang, _ in rows]))
    return network


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs`` (``doc_id, held_out, text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column(2)
            at = 0
            while at < len(texts):
                part, size, end = [], 0, at
                while end < len(texts) and size < CHUNK_BYTES:
                    text = texts[end].as_py()
                    known = net is not None and text is not None and _LETTER.search(text)
                    part.append(text.encode("utf-8", "surrogatepass") if known else b"")
                    size += len(part[-1])
                    end += 1
                names, scores = ["und"] * len(part), np.zeros(len(part))
                if size:
                    windows, lengths, starts = windows_of(part)
                    mean = np.add.reduceat(net.pooled(windows, lengths), starts, axis=0) / np.maximum([[len(t)] for t in part], 1)
                    best = mean.argmax(axis=1)
                    names = [net.languages[b] if t else "und" for b, t in zip(best, part, strict=True)]
                    scores = np.clip([m[b] if t else 0.0 for m, b, t in zip(mean, best, part, strict=True)], 0.0, 1.0)
                head = [c.slice(at, end - at) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*head, pa.array(names), pa.array(scores, type=pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
                at = end

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return predict(docs, train(docs))
