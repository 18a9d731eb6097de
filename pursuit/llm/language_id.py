"""Language identification by a byte convolutional network.

The network is small: byte embeddings, filters of several widths, max pooling over a window of fixed length, softmax.
It is trained in numpy on a bounded sample of labelled windows and sent to the tasks as a few arrays; there the first
layer becomes tables by byte pairs, so a convolution is a few look-ups. Every window of a text takes part in its answer.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursuit.llm.registry import query, table
from pursuit.staging import lookup

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 6
SAMPLE_DOCS = 250       # labelled documents per language that training may read
SAMPLE_WINDOWS = 6      # windows of each of them, spread over the whole text
UNKNOWN = "und"


@dataclass
class Network:
    """Weights: ``filters[w]`` is (w, 256, FILTERS), the product of embedding and kernel; ``bias[w]``; ``out``."""

    labels: list[str]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pair_tables(self):
        tables = {}
        for w, f in self.filters.items():
            pairs = [(f[j][:, None] + f[j + 1][None]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            tables[w] = (pairs, f[w - 1] if w % 2 else None)
        return tables

    def features(self, windows: np.ndarray, tables) -> np.ndarray:
        """Max-pooled filter answers of windows (n, WINDOW) of bytes."""
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for w in WIDTHS:
            pairs, last = tables[w]
            n = windows.shape[1] - w + 1
            a = pairs[0][pair[:, :n]]
            for j, t in enumerate(pairs[1:], 1):
                a += t[pair[:, 2 * j:2 * j + n]]
            if last is not None:
                a += last[windows[:, w - 1:w - 1 + n]]
            pooled.append(np.maximum(a.max(axis=1) + self.bias[w], 0))
        return np.concatenate(pooled, axis=1)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64,
          rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on the cross entropy. The gradient of a max goes to the place that gave it."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
    for w in WIDTHS:
        p[f"k{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
        p[f"b{w}"] = np.zeros(FILTERS, np.float32)
    size = FILTERS * len(WIDTHS)
    p["out"] = rng.normal(0, size ** -0.5, (size, len(labels))).astype(np.float32)
    p["out_bias"] = np.zeros(len(labels), np.float32)
    first, second, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            x, y = windows[order[lo:lo + batch]], target[order[lo:lo + batch]]
            emb, n = p["embed"][x], len(x)
            pooled, places = [], {}
            for w in WIDTHS:
                strips = np.concatenate([emb[:, j:WINDOW - w + 1 + j] for j in range(w)], axis=2)
                a = strips @ p[f"k{w}"]
                at = a.argmax(axis=1)
                top = np.take_along_axis(a, at[:, None], 1)[:, 0] + p[f"b{w}"]
                places[w] = (at, top > 0)
                pooled.append(np.maximum(top, 0))
            h = np.concatenate(pooled, axis=1)
            z = h @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y] -= 1
            z /= n
            g = {"out": h.T @ z, "out_bias": z.sum(0), "embed": np.zeros_like(p["embed"])}
            back = z @ p["out"].T
            rows = np.arange(n)[:, None]
            for i, w in enumerate(WIDTHS):
                at, live = places[w]
                d = back[:, i * FILTERS:(i + 1) * FILTERS] * live
                taken = np.concatenate([emb[rows, at + j] for j in range(w)], axis=2)
                g[f"b{w}"] = d.sum(0)
                g[f"k{w}"] = np.einsum("nfe,nf->ef", taken, d)
                to = np.einsum("nf,ef->nfe", d, p[f"k{w}"])
                for j in range(w):
                    np.add.at(g["embed"], x[rows, at + j], to[:, :, j * EMBED:(j + 1) * EMBED])
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    filters = {w: np.stack([p["embed"] @ p[f"k{w}"][j * EMBED:(j + 1) * EMBED] for j in range(w)]).astype(np.float32)
               for w in WIDTHS}
    return Network(labels, filters, {w: p[f"b{w}"] for w in WIDTHS}, p["out"], p["out_bias"])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """All windows of texts ``data[start:end]`` as (n, WINDOW) bytes, zero filled, with the text each belongs to.
    Neighbouring windows overlap by the widest filter less one, so every filter sees every place of a text."""
    stride = WINDOW - max(WIDTHS) + 1
    length = ends - starts
    count = np.maximum(1, -(-(length - max(WIDTHS) + 1) // stride))
    owner = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[owner] + nth * stride
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < ends[owner][:, None]
    return np.where(inside, LOWER[data[np.minimum(at, len(data) - 1)]], 0).astype(np.uint8), owner


def fit(docs: DataFrame, held_out, seed: int = 7) -> Network | None:
    """A network trained on rows with a language that are not ``held_out``; None without any. Rows are chosen by the
    hash of their id, at most SAMPLE_DOCS of a language."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    labelled = docs.where("lang is not null and text is not null").where(~held_out)
    # ids first, so that no text travels but those of the sample
    chosen = labelled.select("doc_id", "lang").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE_DOCS)
    chosen = lookup(chosen.select("doc_id", "lang").distinct(), "sample")
    rows = labelled.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])
    room = F.greatest(F.lit(0), F.length("text") - WINDOW)
    places = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.floor(i * room / (SAMPLE_WINDOWS - 1))))
    cut = F.transform(places, lambda at: F.substring("text", (at + 1).cast("int"), F.lit(WINDOW)))
    got = sorted((r.lang, r.doc_id or 0, w) for r in rows.select("lang", "doc_id", cut.alias("cut")).collect() for w in r.cut)
    if not got:
        return None
    labels = sorted({lang for lang, _, _ in got})
    x = np.zeros((len(got), WINDOW), np.uint8)
    for i, (_, _, w) in enumerate(got):
        raw = np.frombuffer(w.encode()[:WINDOW], np.uint8)
        x[i, :len(raw)] = LOWER[raw]
    return train(x, np.array([labels.index(lang) for lang, _, _ in got]), labels, seed=seed)


def _predict(network: Network | None, block: int = 256):
    def predict(batches):
        tables = network.pair_tables() if network else None
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            lettered = np.array(batch.column("lettered").to_pylist(), dtype=bool)
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"\0", np.uint8)
            names, scores = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            some = np.flatnonzero(lettered)
            # texts in runs of about ``block`` windows; the windows of one long text come in blocks too
            load = np.cumsum((offsets[some + 1] - offsets[some]) // (WINDOW - max(WIDTHS) + 1) + 1) // block
            for run in np.split(some, np.flatnonzero(np.diff(load)) + 1) if network and len(some) else []:
                windows, owner = windows_of(data, offsets[run], offsets[run + 1])
                prob = np.concatenate([
                    network.probabilities(network.features(windows[lo:lo + block], tables))
                    for lo in range(0, len(windows), block)])
                size = np.bincount(owner, minlength=len(run)).astype(float)
                mean = np.stack([np.bincount(owner, prob[:, j], len(run)) / size for j in range(prob.shape[1])], 1)
                best = mean.argmax(axis=1)
                names[run] = np.array(network.labels, object)[best]
                scores[run] = np.clip(mean[np.arange(len(run)), best], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(list(names), pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"])
    return predict


def held_out_mod(divisor: int, remainder: int):
    """Rows kept out of training, by the checksum of their id; rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(True))


def identify(docs: DataFrame, held_out=None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row: the language of highest mean probability over all windows
    of the whole text. ``und`` with score 0 for a null text, one without letters, or where no row has a language to
    learn from. Rows with equal ids stay apart. The network is trained when called."""
    held_out = held_out_mod(4, 2) if held_out is None else held_out
    network = fit(docs, held_out)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(_predict(network), "doc_id long, held_out boolean, lang_pred string, score double")


@query()
def op6_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
