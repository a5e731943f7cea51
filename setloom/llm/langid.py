"""Language ID with a byte convolutional network, trained and applied in numpy.

Texts are cut into windows of fixed length over their UTF-8 bytes. Byte embeddings go
through filters of several widths, each filter keeps its largest response in the window,
and a softmax layer turns these into languages; a text's windows are averaged. Training
takes a bounded sample of different labelled texts (`fit_rows`, by a hash of the text, in equal
shares for the labels as far as they reach), prediction
every window of every whole text. Filters over embeddings of single bytes are sums of table
rows, so prediction looks up rows for byte pairs instead of multiplying.

Defined results: a null text, or one without a letter, is `und` with score 0; without any
labelled row every text is `und`; null labels are never learnt; few labelled rows among many others are all
learnt, as the bound counts different labelled texts only; of labels with equal probability the first by name is
predicted; other columns pass through, those named like an output go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, text_of

UNKNOWN = "und"


@dataclass(frozen=True)
class Config:
    window: int = 256  # bytes
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16  # of each width
    fit_rows: int = 2000  # bound on the training sample
    fit_chars: int = 1024  # of each sampled text, from a hashed position
    epochs: int = 5
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    window: int
    widths: tuple[int, ...]
    embed: np.ndarray  # 256 x embed
    kernels: tuple[np.ndarray, ...]  # width x embed x filters
    biases: tuple[np.ndarray, ...]
    out: np.ndarray  # all filters x languages
    bias: np.ndarray


def windows(raw: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other in `raw`: rows of `width` bytes padded with 0, their text, their number of bytes."""
    count = -(-sizes // width)
    text = np.repeat(np.arange(len(sizes)), count)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(sizes) - sizes)[text] + inner * width
    length = np.minimum(width, sizes[text] - inner * width)
    padded = np.r_[raw, np.zeros(width, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[begin].copy() if len(begin) else np.zeros((0, width), np.uint8)
    rows[np.arange(width) >= length[:, None]] = 0
    return rows, text, length


def fit(texts: list[str], labels: list[str], config: Config = Config()) -> Model:
    """Train on labelled texts: Adam on the cross-entropy of single windows."""
    names = tuple(sorted(set(labels)))
    rng = np.random.default_rng(config.seed)
    e = rng.normal(0, 0.3, (256, config.embed))
    kernels = [rng.normal(0, 1 / np.sqrt(w * config.embed), (w, config.embed, config.filters)) for w in config.widths]
    biases = [np.zeros(config.filters) for _ in config.widths]
    out, bias = rng.normal(0, 0.1, (config.filters * len(config.widths), max(1, len(names)))), np.zeros(max(1, len(names)))
    if names:
        coded = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        x, of, _ = windows(np.frombuffer(b"".join(coded), np.uint8), sizes, config.window)
        y = np.fromiter(map(names.index, labels), np.int64, len(labels))[of]
        params = [e, *kernels, *biases, out, bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(config.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), config.batch):
                pick = order[at : at + config.batch]
                grads = _gradients(params, len(config.widths), x[pick], y[pick])
                step += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= config.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(names, config.window, config.widths, e, tuple(kernels), tuple(biases), out, bias)


def _gradients(params: list[np.ndarray], n: int, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    e, kernels, biases, out, bias = params[0], params[1 : 1 + n], params[1 + n : 1 + 2 * n], params[-2], params[-1]
    rows, here = e[x], np.arange(len(x))
    pooled, where, seen = [], [], []
    for k, b in zip(kernels, biases):
        w = len(k)
        view = np.lib.stride_tricks.sliding_window_view(rows, w, axis=1)  # batch, place, embed, width
        patch = view.transpose(0, 1, 3, 2).reshape(len(x), view.shape[1], -1)
        z = patch @ k.reshape(-1, k.shape[2]) + b
        top = z.argmax(1)
        where.append(top)
        seen.append(patch)
        pooled.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0])
    p = np.concatenate(pooled, 1)
    h = np.maximum(p, 0)
    logits = h @ out + bias
    soft = np.exp(logits - logits.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    soft[here, y] -= 1
    d = soft / len(x)
    d_h = (d @ out.T) * (p > 0)
    d_e, d_k, d_b, f = np.zeros_like(e), [], [], 0
    for k, top, patch in zip(kernels, where, seen):
        g = d_h[:, f : f + k.shape[2]]
        f += k.shape[2]
        best = patch[here[:, None], top]  # batch, filter, width * embed
        d_k.append(np.einsum("bf,bfp->pf", g, best).reshape(k.shape))
        d_b.append(g.sum(0))
        for j in range(len(k)):
            np.add.at(d_e, x[here[:, None], top + j], g[:, :, None] * k[j].T[None])
    return [d_e, *d_k, *d_b, h.T @ d, d.sum(0)]


class Predictor:
    """The model as tables: for each width, one for its leading byte pairs and so on."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = []
        for k, b in zip(model.kernels, model.biases):
            parts, w = [], len(k)
            single = [(model.embed @ k[j]).astype(np.float32) for j in range(w)]
            for j in range(0, w - 1, 2):
                parts.append((j, (single[j][:, None] + single[j + 1][None]).reshape(65536, -1)))
            if w % 2:
                parts.append((w - 1, single[-1]))
            parts[0] = (0, parts[0][1] + b.astype(np.float32))
            self.tables.append((w, parts))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each language for rows of bytes."""
        pooled = []
        x = np.ascontiguousarray(x.T)  # places first: the maximum then runs over long rows
        pairs = x[:-1].astype(np.intp) * 256 + x[1:]
        singles = x.astype(np.intp)
        for w, parts in self.tables:
            places = len(x) - w + 1
            z = None
            for j, t in parts:
                got = np.take(t, (pairs if len(t) > 256 else singles)[j : j + places], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            pooled.append(z.max(0))
        logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.model.out + self.model.bias
        soft = np.exp(logits - logits.max(1, keepdims=True))
        return soft / soft.sum(1, keepdims=True)

    def texts(self, coded: list[bytes], most: int = 256) -> np.ndarray:
        """Mean probabilities of each text over its windows, weighted by their bytes."""
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        x, of, length = windows(np.frombuffer(b"".join(coded), np.uint8), sizes, self.model.window)
        total = np.zeros((len(coded), self.model.out.shape[1]))
        for at in range(0, len(x), most):
            part = slice(at, at + most)
            np.add.at(total, of[part], self.windows(x[part]) * length[part, None])
        return total / np.maximum(sizes, 1)[:, None]


def _shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rows of each label: equal shares of `total`, what a label lacks goes to the others. At most `total` labels, so each has one row at least."""
    if len(counts) > total:
        raise ValueError("more labels than rows")
    out, left = {}, total
    for n, label in enumerate(sorted(counts, key=lambda k: (counts[k], k))):
        out[label] = min(counts[label], left // (len(counts) - n))
        left -= out[label]
    return out


def training_sample(docs: DataFrame, train: Column | None, text_col: str, label_col: str, config: Config) -> tuple[list[str], list[str]]:
    """At most `fit_rows` different labelled texts, shared out to the labels and spread by a hash; of each a piece of at most `fit_chars` from a hashed place.

    Where there are more labels than that, the rarest are left out (of equally frequent ones those last by name): they aren't learnt.
    """
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    if train is not None:
        rows = rows.filter(train)
    key = F.xxhash64(F.lit(config.seed), F.col(text_col))
    label = F.col(label_col).cast("string")
    # Copies of a text count once, with their least label.
    tables = Tables()
    labels = tables.stored(rows.select(key.alias("key"), label.alias("label")).groupBy("key").agg(F.min("label").alias("label")), "labels")
    counts = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(config.fit_rows)
    counts = {r["label"]: r["count"] for r in counts.collect()}
    if not counts:
        return [], []
    quota = _shares(counts, config.fit_rows)
    room = F.greatest(F.length(text_col) - config.fit_chars, F.lit(0)) + 1
    piece = F.substring(F.col(text_col), F.pmod(F.xxhash64(key), room).cast("int") + 1, F.lit(config.fit_chars))
    # Few more texts than a label's share pass a filter on the hash, so that little is grouped and sorted.
    settings = [(k, int(min(1.0, (4 * n + 64) / counts[k]) * (1 << 30)), n) for k, n in quota.items()]
    settings = F.broadcast(docs.sparkSession.createDataFrame(settings, "label string, __upto long, __quota long"))  # a row for each of fit_rows labels at most
    chosen = labels.join(settings, "label").filter(F.pmod("key", F.lit(1 << 30)) <= F.col("__upto"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("key"))
    chosen = chosen.withColumn("__place", place).filter(F.col("__place") <= F.col("__quota")).select("key", "label")
    # At most fit_rows texts are chosen before any text is moved.
    pieces = rows.select(key.alias("key"), piece.alias("piece")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min(F.struct("label", "piece")).alias("r"))
    got = pieces.select("key", "r.*").orderBy("key").collect()
    tables.drop(labels)
    return [r["piece"] for r in got], [r["label"] for r in got]


def train(docs: DataFrame, where: Column | None = None, text_col: str = "text", label_col: str = "lang", config: Config = Config()) -> Model:
    return fit(*training_sample(docs, where, text_col, label_col, config), config)


def predict_language(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the predicted language and its probability."""
    rows = docs.drop(pred_col, score_col).withColumn("__li_letters", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    at, letters = rows.columns.index(text_col), len(rows.columns) - 1
    kept = [f for f in rows.schema.fields if f.name != "__li_letters"]
    schema = T.StructType([*kept, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for batch in batches:
            has = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            pred, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            todo, column = np.flatnonzero(has), batch.column(at)
            held, size = [], 0
            for n, i in enumerate(todo.tolist()):
                held.append((i, column[i].as_py().encode()))
                size += len(held[-1][1])
                if size > 1_000_000 or n == len(todo) - 1:  # about a MB of text at once
                    p = predictor.texts([raw for _, raw in held])
                    rows_ = [i for i, _ in held]
                    best = p.argmax(1)
                    pred[rows_] = np.array(model.languages, object)[best]
                    score[rows_] = np.clip(p[np.arange(len(best)), best], 0, 1)
                    held, size = [], 0
            columns = batch.columns[:letters]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred.tolist(), pa.string()), pa.array(score)], names=[*names, pred_col, score_col])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the identifier as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", config: Config = Config()) -> DataFrame:
    """Train on the rows that aren't held out and predict all: id, held_out, lang_pred, score."""
    model = train(docs, ~held_out(id_col), text_col, label_col, config)
    return predict_language(docs.select(id_col, text_of(text_col).alias(text_col), held_out(id_col).alias("held_out")), model, text_col).select(id_col, "held_out", "lang_pred", "score")
