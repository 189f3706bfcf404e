"""Quality classifier: gated attention multiple-instance learning.

A document is a bag of passages of PASSAGE bytes (the last may be shorter); only the bag has a label. Each passage is
encoded from byte statistics (classes of bytes, pairs of neighbouring classes, share of distinct 4-grams) by a learned
layer, h = tanh(We x). Gated attention weighs it, a = softmax(w . (tanh(V h) * sigmoid(U h))) over the document's passages,
and the score is sigmoid(c . sum(a h) + b). All parameters are learned from document labels by Adam.

Training takes at most `per_label` documents of each label, of at most MAX_TRAIN_BYTES each; scoring reads every whole
text, in chunks of passages. The model (a few hundred kB, fixed) is broadcast.

Defined results for odd input: null and empty texts are a bag of one blank passage and get a score like any other;
labels that are null or not 0 or 1 are not learned; a document labelled both ways is not learned; without both labels
to learn from the score is the share of label 1 (0.5 without any label); an id may name several rows, which are learned
from like others (equal ones once); texts over MAX_TRAIN_BYTES are scored but not drawn; repeated rows are scored each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.common import small_batches, written
from veritrail.llm.langid import sampled

PASSAGE = 400
PER_LABEL = 1500
MAX_TRAIN_BYTES = 1 << 17
HIDDEN, GATE = 24, 12
_CHUNK = 2048


def _classes() -> np.ndarray:
    """A class for each byte: white space, line end, letters by case, digits, UTF-8 parts, and marks by kind."""
    kind = np.zeros(256, np.uint8)
    groups = [b"\t \x0b\x0c\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", bytes(range(128, 192)), bytes(range(192, 256)),
              b".", b",;:", b"!?", b"'\"()[]{}", b"-_/\\+=~@^`", b"#%&*", b"|<>", b"$"]
    for k, group in enumerate(groups, 1):
        kind[list(group)] = k
    return kind


CLASSES = _classes()
KINDS = 16
FEATURES = KINDS + KINDS * KINDS + 2


def passages(text: bytes) -> np.ndarray:
    """passages x PASSAGE bytes, the last one filled with zeros."""
    data = np.frombuffer(text or b" ", np.uint8)
    count = -(-len(data) // PASSAGE)
    out = np.zeros((count, PASSAGE), np.uint8)
    out.ravel()[: len(data)] = data
    return out


def encoded(rows: np.ndarray) -> np.ndarray:
    """The features of each passage (float32)."""
    n = len(rows)
    size = PASSAGE - (rows[:, ::-1] != 0).argmax(axis=1)
    size = np.where((rows != 0).any(axis=1), size, 1)
    kind = CLASSES[rows].astype(np.int32)
    inside = np.arange(PASSAGE)[None, :] < size[:, None]
    base = np.arange(n, dtype=np.int32)[:, None]
    single = np.bincount((kind + base * KINDS)[inside], minlength=n * KINDS).reshape(n, KINDS)
    two = inside[:, 1:]
    pair = (kind[:, :-1] * KINDS + kind[:, 1:] + base * KINDS * KINDS)[two]
    pairs = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1)
    wide = rows.astype(np.uint32)
    grams = ((wide[:, :-3] * np.uint32(257) + wide[:, 1:-2]) * np.uint32(257) + wide[:, 2:-1]) * np.uint32(257) + wide[:, 3:]
    grams.sort(axis=1)
    distinct = 1 + (grams[:, 1:] != grams[:, :-1]).sum(axis=1)
    share = np.clip(distinct / np.maximum(1, size - 3), 0, 1)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :KINDS] = single / size[:, None]
    out[:, KINDS:-2] = pairs / size[:, None]
    out[:, -2] = share
    out[:, -1] = size / PASSAGE
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        make = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"E": make(FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": make(HIDDEN, GATE), "U": make(HIDDEN, GATE),
                  "w": make(GATE, 1)[:, 0], "c": make(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def instances(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, (t * s) @ p["w"]

    @staticmethod
    def attention(logit: np.ndarray, start: np.ndarray, bag: np.ndarray) -> np.ndarray:
        a = np.exp(logit - np.maximum.reduceat(logit, start)[bag])
        return a / np.add.reduceat(a, start)[bag]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """The score of each text. Passages pass through in chunks; of a long text only h and the logit stay."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.empty(0)
        hs, logits, sizes, held, rows = [], [], [], [], 0
        for text in texts:
            cut = passages(text or b"")
            sizes.append(len(cut))
            for at in range(0, len(cut), _CHUNK):
                held.append(cut[at : at + _CHUNK])
                rows += len(held[-1])
                if rows >= _CHUNK:
                    h, _, _, logit = self.instances(encoded(np.concatenate(held)))
                    hs.append(h), logits.append(logit)
                    held, rows = [], 0
        if held:
            h, _, _, logit = self.instances(encoded(np.concatenate(held)))
            hs.append(h), logits.append(logit)
        h, logit = np.concatenate(hs), np.concatenate(logits)
        bag = np.repeat(np.arange(len(sizes)), sizes)
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        a = self.attention(logit, start, bag)
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return _sigmoid(z @ self.p["c"] + self.p["b"][0]).astype(np.float64)

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, rate: float = 0.01, batch: int = 64, decay: float = 1e-4, seed: int = 5):
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + np.float32(0.02)
        del every
        draw = np.random.default_rng(seed)
        first, second, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = draw.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                grad = self.gradient([bags[k] for k in own], labels[own])
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) * move).astype(np.float32)
        return self

    def gradient(self, bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the bags."""
        p, sizes = self.p, np.array([len(x) for x in bags])
        x = np.concatenate(bags)
        bag, start = np.repeat(np.arange(len(bags)), sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        h, t, s, logit = self.instances(x)
        a = self.attention(logit, start, bag)
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        d = (_sigmoid(z @ p["c"] + p["b"][0]) - labels) / len(bags)
        dz = d[:, None] * p["c"][None, :]
        gain = (dz[bag] * h).sum(axis=1)
        dlogit = a * (gain - np.add.reduceat(a * gain, start)[bag])
        dt, ds = dlogit[:, None] * p["w"] * s * (1 - t * t), dlogit[:, None] * p["w"] * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        de = dh * (1 - h * h)
        return {"E": ((x - self.mean) / self.scale).T @ de, "e": de.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds,
                "w": (t * s).T @ dlogit, "c": z.T @ d, "b": np.array([d.sum()], np.float32)}


def drawn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> DataFrame:
    """(id, label, text binary) of at most per_label rows of each label, of at most MAX_TRAIN_BYTES each.

    First ids are drawn, then rows of those ids: an id may name any number of rows. Equal rows are drawn once."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marks = marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("octet_length(text) <= " + str(MAX_TRAIN_BYTES))
    ids = sampled(marks.join(usable.select("id"), "id", "left_semi"), "label", per_label, ["id"])
    ids = written(ids, "drawn")  # at most per_label ids of either label
    rows = usable.join(F.broadcast(ids), "id")
    return sampled(rows, "label", per_label, ["id", "text"]).select("id", "label", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Learns from the documents given and their labels (id_col, label_col). Executors encode; the driver gets the
    passages of at most 2 * per_label documents."""
    small_batches(docs.sparkSession)
    picked = drawn(docs, labels, id_col, text_col, label_col, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encoded(passages(x)).astype(np.float16).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["id", "label", "x"])

    id_type = picked.schema["id"].dataType.simpleString()
    rows = sorted(picked.mapInArrow(run, f"id {id_type}, label int, x binary").collect(), key=lambda r: (r["id"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    return Model().fit(bags, np.array([r["label"] for r in rows], np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs' rows with all their columns and score_col; a column of that name is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(score_col)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
