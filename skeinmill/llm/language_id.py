"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read each window of a text forwards and backwards;
from both hidden states every byte position gets a probability for each
language, and a text's probabilities are the mean over all its positions.
Texts are read whole, as windows of ``WINDOW`` bytes that run in parallel. A
window is read with ``CONTEXT`` bytes of the text before and behind it, whose
positions count in the neighbouring windows, so both states are warm where
positions count.

Training is backpropagation through time with Adam on the driver, over windows
of the same make of a bounded sample of labelled rows (``per_language`` texts of
each language, ``windows_per_text`` windows of each, picked by hash). Gates are hard sigmoids
and the candidate state a softsign, which numpy computes quickly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.llm.shingles import text_runs
from skeinmill.runtime import settle, table, text_batches

WINDOW, CONTEXT = 112, 16
LENGTH = WINDOW + 2 * CONTEXT
_BATCH = 2048
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
UNKNOWN = "und"


def windows_at(data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (LENGTH, windows) around windows that begin at ``start`` in texts from ``low`` to ``high``, spaces outside the text; and which positions count."""
    steps = np.arange(LENGTH)[:, None]
    place = start - CONTEXT + steps
    inside = (place >= low) & (place < high)
    x = np.where(inside, data[np.clip(place, 0, len(data) - 1)], np.uint8(32))
    return x, inside & (steps >= CONTEXT) & (steps < CONTEXT + WINDOW)


class ByteGru:
    """Weights of both directions, and forward, training and prediction passes."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = list(languages), hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"{d}xg"] = rng.normal(0, 0.3, (256, 2 * hidden)).astype(np.float32)
            self.w[f"{d}xn"] = rng.normal(0, 0.5, (256, hidden)).astype(np.float32)
            self.w[f"{d}ug"] = rng.normal(0, 0.3, (hidden, 2 * hidden)).astype(np.float32)
            self.w[f"{d}un"] = rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)
        self.w["out"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.w["bias"] = np.zeros(len(languages), np.float32)

    def _run(self, d: str, x: np.ndarray, keep: bool = False):
        """Hidden states (T, B, H) for bytes (T, B) in reading order; with ``keep`` also what training needs."""
        t, b = x.shape
        h, k = np.zeros((b, self.hidden), np.float32), self.hidden
        states = np.empty((t, b, k), np.float32)
        kept = []
        xg, ug = 0.25 * self.w[f"{d}xg"] + np.float32(0.5), 0.25 * self.w[f"{d}ug"]
        xn, un = self.w[f"{d}xn"], self.w[f"{d}un"]
        for i in range(t):
            g = np.take(xg, x[i], axis=0)
            g += h @ ug
            np.maximum(g, 0, out=g)
            np.minimum(g, 1, out=g)
            z, r = g[:, :k], g[:, k:]
            u = h @ un
            n = np.take(xn, x[i], axis=0)
            n += r * u
            a = np.abs(n)
            a += 1
            n /= a
            before = h
            h = states[i]
            np.subtract(before, n, out=h)
            h *= z
            h += n
            if keep:
                kept.append((before, g, u, n, a))
        return states, kept

    def _positions(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        k = self.hidden
        logits = forward @ self.w["out"][:k]
        logits += backward @ self.w["out"][k:]
        logits += self.w["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, languages) of every position of the byte windows (T, B)."""
        forward, _ = self._run("f", x)
        backward, _ = self._run("b", x[::-1])
        return self._positions(forward, backward[::-1])

    def _back(self, d: str, x: np.ndarray, kept: list, dstates: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        k = self.hidden
        dh = np.zeros(dstates.shape[1:], np.float32)
        ug, un = self.w[f"{d}ug"], self.w[f"{d}un"]
        dgs, dns = np.empty((*x.shape, 2 * k), np.float32), np.empty((*x.shape, k), np.float32)
        for i in range(len(x) - 1, -1, -1):
            before, g, u, n, a = kept[i]
            z, r = g[:, :k], g[:, k:]
            dh = dh + dstates[i]
            dn = dh * (1 - z) / (a * a)
            dg = np.concatenate([dh * (before - n), dn * u], axis=1)
            dg *= 0.25 * ((g > 0) & (g < 1))
            du = dn * r
            grad[f"{d}ug"] += before.T @ dg
            grad[f"{d}un"] += before.T @ du
            dgs[i], dns[i] = dg, dn
            dh = dh * z + dg @ ug.T + du @ un.T
        hot = np.zeros((256, x.size), np.float32)
        hot[x.ravel(), np.arange(x.size)] = 1
        grad[f"{d}xg"] += hot @ dgs.reshape(-1, 2 * k)
        grad[f"{d}xn"] += hot @ dns.reshape(-1, k)

    def gradients(self, x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the positions of windows x (T, B) with languages y (B) that count (all, if not said), and its gradients."""
        k, (t, b) = self.hidden, x.shape
        forward, kept_f = self._run("f", x, True)
        backward, kept_b = self._run("b", x[::-1], True)
        p = self._positions(forward, backward[::-1])
        share = np.full((t, b), 1 / (t * b), np.float32) if counts is None else (counts / max(1, counts.sum())).astype(np.float32)
        loss = float((-np.log(np.maximum(p[:, np.arange(b), y], 1e-9)) * share).sum())
        p[:, np.arange(b), y] -= 1
        p *= share[:, :, None]
        grad = {name: np.zeros_like(v) for name, v in self.w.items()}
        flat = p.reshape(t * b, -1)
        grad["out"][:k] = forward.reshape(t * b, k).T @ flat
        grad["out"][k:] = backward[::-1].reshape(t * b, k).T @ flat
        grad["bias"] = flat.sum(axis=0)
        self._back("f", x, kept_f, p @ self.w["out"][:k].T, grad)
        self._back("b", x[::-1], kept_b, (p @ self.w["out"][k:].T)[::-1], grad)
        return loss, grad

    def train(self, windows: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, steps: int = 200, batch: int = 128, rate: float = 0.02, seed: int = 11) -> list[float]:
        rng = np.random.default_rng(seed)
        m = {n: np.zeros_like(v) for n, v in self.w.items()}
        v = {n: np.zeros_like(w) for n, w in self.w.items()}
        by_language = [np.flatnonzero(y == i) for i in range(len(self.languages))]
        losses = []
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, max(1, batch // len(by_language))) for rows in by_language])
            loss, grad = self.gradients(np.ascontiguousarray(windows[pick].T), y[pick], None if counts is None else counts[pick].T)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * (1 - step / (steps + 1))
            for n, g in grad.items():
                g *= min(1.0, 1.0 / max(norm, 1e-9))
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.01 * (g * g - v[n])
                self.w[n] -= (lr * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean position probabilities (rows, languages) of the texts at ``offsets`` in ``data``; zero for empty ones."""
        rows = len(offsets) - 1
        sizes = np.diff(offsets)
        per_row = -(-sizes // WINDOW)
        row_of = np.repeat(np.arange(rows), per_row)
        first = np.repeat(np.cumsum(per_row) - per_row, per_row)
        start = offsets[:-1][row_of] + (np.arange(len(row_of)) - first) * WINDOW
        low, high = offsets[:-1][row_of], offsets[1:][row_of]
        sums = np.zeros((rows, len(self.languages)))
        for at in range(0, len(start), _BATCH):
            to = at + _BATCH
            x, counts = windows_at(data, start[at:to], low[at:to], high[at:to])
            p = self.positions(x)
            p *= counts[:, :, None]
            np.add.at(sums, row_of[at:to], p.sum(axis=0))
        return sums / np.maximum(sizes, 1)[:, None]


def _cutter(per_text: int, languages: dict[str, int]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, masks, ys = [], [], []
            langs = batch.column(1).to_pylist()
            for first, end, data, offsets in text_runs(batch.column(0)):
                for r in range(end - first):
                    low, high = int(offsets[r]), int(offsets[r + 1])
                    if low == high:
                        continue
                    rng = np.random.default_rng(high - low)
                    room = max(1, high - low - WINDOW + 1)
                    start = low + np.sort(rng.choice(room, min(per_text, room), replace=False))
                    x, counts = windows_at(data, start, np.full(len(start), low), np.full(len(start), high))
                    out += [w.tobytes() for w in x.T]
                    masks += [w.tobytes() for w in counts.T]
                    ys += [languages[langs[first + r]]] * len(start)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(masks, pa.binary()), pa.array(ys, pa.int32())], names=["w", "m", "y"])

    return cut


def fit_language_model(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, windows_per_text: int = 4, hidden: int = 8, steps: int = 200
) -> ByteGru | None:
    """Train on at most ``per_language`` texts of each language; None if no row has a text and a language.

    The sample is the rows with the smallest hashes of their ids, so it does not
    depend on the order or the place of rows; rows that share an id give one
    text. A threshold on the hash, which twice as many ids are expected to pass,
    goes first, so that no task ranks all ids of a language. The number of
    languages is taken to be bounded (a label set).
    """
    own = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    h = F.xxhash64("id")
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()  # a row a language
    if not sizes:
        return None
    highest = {r.lang: min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 2 * per_language / max(1, r.n)))) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in highest.items() for x in pair])[F.col("lang")]
    order = W.partitionBy("lang").orderBy(h, "id")
    passing = own.where(h <= limit).select("id", "lang").distinct()
    picked = passing.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("id", "lang")
    languages = sorted(highest)
    index = {name: i for i, name in enumerate(languages)}
    texts = own.join(F.broadcast(picked), ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = texts.select("text", "lang").mapInArrow(_cutter(windows_per_text, index), "w binary, m binary, y int")
    rows = sorted((r.y, bytes(r.w), bytes(r.m)) for r in sample.collect())
    if not rows:
        return None
    windows, counts = (np.frombuffer(b"".join(r[i] for r in rows), np.uint8).reshape(len(rows), LENGTH) for i in (1, 2))
    y = np.array([r[0] for r in rows])
    seen = sorted(set(y.tolist()))
    model = ByteGru([languages[i] for i in seen], hidden)
    model.train(windows, np.searchsorted(seen, y), counts, steps)
    return model


def _predictor(model: ByteGru | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for first, end, data, offsets in text_runs(batch.column(0)):
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
                pooled = model.pooled(data, offsets) if model else np.zeros((end - first, 1))
                best = pooled.argmax(axis=1)
                for r in range(end - first):
                    known = letters[r + 1] > letters[r] or any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
                    langs.append(model.languages[best[r]] if model and known else UNKNOWN)
                    scores.append(min(1.0, float(pooled[r, best[r]])) if model and known else 0.0)
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return predict


def predict_language(docs: DataFrame, model: ByteGru | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of all its columns) with lang_pred and score (0 to 1).

    Only the text is an input. Null texts and texts without a letter of any
    script are ``und`` with score 0, and so is everything without a model. Rows
    are judged by themselves, so repeats and null ids need no rule.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    slim = docs.select(F.col(text_col).alias("text"), row)
    schema = T.StructType([T.StructField("row", slim.schema["row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return slim.mapInArrow(_predictor(model), schema)


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves 1 by 3 (and null ids)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with text_batches(spark):
        docs = table(spark, sf_dir, "documents")
        model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
        slim = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
        return settle(slim.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double"), "language-predictions")


ORACLE = None
