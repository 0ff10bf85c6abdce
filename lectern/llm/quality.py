"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, table
from lectern.llm.langid import held_out

#: Terms are hashed to so many places: trigrams of bytes, trigrams of character shapes, words that repeat the last one.
BYTES, SHAPES, REPEATS = 3072, 1008, 16
TERMS = BYTES + SHAPES + REPEATS
#: Labelled rows that are fitted on, of each label at most. It bounds the driver's matrix and what is broadcast.
SAMPLE = 2048
DIMENSIONS = 64
NEIGHBOURS = 25


def _shape_table() -> np.ndarray:
    """Byte -> shape: a letter's case, digit, white space, every other character itself; bytes of longer characters as small letters."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = t[128:] = ord("a")
    t[ord("A") : ord("Z") + 1] = ord("A")
    t[ord("0") : ord("9") + 1] = ord("0")
    return t


_SHAPE = _shape_table()


def _trigrams(b: np.ndarray, places: int) -> np.ndarray:
    x = b.astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(8)) % np.uint32(places)


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the text's terms; none for an empty text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(b" " + text + b" ", np.uint8)
    n = np.zeros(TERMS, np.int64)
    n[:BYTES] = np.bincount(_trigrams(b, BYTES), minlength=BYTES)
    n[BYTES : BYTES + SHAPES] = np.bincount(_trigrams(_SHAPE[b], SHAPES), minlength=SHAPES)
    words = text.split()
    same = sum(map(bytes.__eq__, words, words[1:]))
    if same:
        share = same / len(words)
        n[BYTES + SHAPES + int(share * (REPEATS - 1))] = len(words)  # one place for each share of repeats, as heavy as the words
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # labelled row x DIMENSIONS, of length 1 (0 for empty texts)
    label: np.ndarray
    weight: np.ndarray
    prior: float

    def embed(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(docs), self.axes.shape[1]), np.float32)
        for i, (at, n) in enumerate(docs):
            if len(at):
                w = weights(n, self.idf[at])
                out[i] = w @ self.axes[at]
        return unit(out)

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
        """The similarity-weighted share of label 1 among the k nearest labelled vectors, by exact cosines, block by block.

        Of neighbours as similar as the k-th those of the first places count. Without a similar one: the labels' prior.
        """
        out = np.full(len(docs), self.prior)
        k = min(k, len(self.label))
        if not k:
            return out
        for at in range(0, len(docs), block):
            cos = self.embed(docs[at : at + block]) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.broadcast_to(np.arange(k), (len(cos), k))
            if k < cos.shape[1]:
                last = np.take_along_axis(cos, near, 1).min(1, keepdims=True)
                tied = np.flatnonzero((cos >= last).sum(1) > k)
                near[tied] = np.argsort(-cos[tied], axis=1, kind="stable")[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 4 * self.weight[near]
            total = w.sum(1)
            ok = total > 0
            out[at : at + block][ok] = (w * self.label[near]).sum(1)[ok] / total[ok]
        return out.clip(0, 1)


def weights(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf
    return (w / max(float(np.sqrt((w * w).sum())), 1e-12)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def principal_axes(x: np.ndarray, dimensions: int, rounds: int = 3) -> np.ndarray:
    """The leading right singular vectors of x, by a randomised range finder with power iterations."""
    k = min(dimensions, *x.shape)
    y = x @ np.random.default_rng(3).standard_normal((x.shape[1], min(k + 10, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return np.ascontiguousarray(vt[:k].T.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """Document frequencies over every row of `docs`, and vectors of at most `sample` labelled rows for each label.

    The sample is those of smallest hashed id; votes are weighted so that the labels count by their frequency among
    all of `labels`. Null labels, ids with both labels and ids without a document aren't used; of an id's repeated documents
    that of the smallest terms is.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def count(cols):
        n, rows = np.zeros(TERMS, np.int64), 0
        for t in cols["text"]:
            n[terms(t or b"")[0]] += 1
            rows += 1
        at = np.flatnonzero(n)
        yield {"place": [*at.tolist(), -1], "n": [*n[at].tolist(), rows]}

    frequency = map_arrow(texts.select("text"), count, "place int, n bigint", text="text", chars=16_000_000).groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS)
    rows = 0
    for r in frequency:
        if r.place < 0:
            rows = r.n
        else:
            df[r.place] = r.n
    idf = np.log((1 + rows) / (1 + df)) + 0.1

    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    marked = marked.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").select("id", "label")
    of = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("id")
    chosen = marked.where("label = 0").orderBy(order, "id").limit(sample).union(marked.where("label = 1").orderBy(order, "id").limit(sample))

    def features(cols):
        found = [terms(t or b"") for t in cols["text"]]
        yield {"id": cols["id"], "label": cols["label"], "at": [a.tolist() for a, _ in found], "n": [n.tolist() for _, n in found]}

    kind = docs.schema[id_col].dataType.simpleString()
    got = map_arrow(texts.join(F.broadcast(chosen), "id"), features, f"id {kind}, label int, at array<int>, n array<bigint>", text="text").toArrow()
    first = {}
    for i, (key, a, n) in enumerate(zip(got.column("id").to_pylist(), got.column("at").to_numpy(), got.column("n").to_numpy(), strict=True)):
        if key not in first or (list(a), list(n)) < (list(first[key][1]), list(first[key][2])):
            first[key] = (i, a, n)
    label = got.column("label").to_numpy()
    keys = sorted(first)
    x = np.zeros((len(keys), TERMS), np.float32)
    y = np.array([label[first[k][0]] for k in keys], np.float64)
    for i, k in enumerate(keys):
        _, a, n = first[k]
        if len(a):
            a = np.asarray(a, np.int64)
            x[i, a] = weights(np.asarray(n, np.float64), idf[a])
    axes = principal_axes(x, dimensions) if len(keys) else np.zeros((TERMS, dimensions), np.float32)
    seen = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.array([of[int(v)] / seen[int(v)] for v in y])
    total = sum(of.values())
    return Model(idf, axes, unit(x @ axes), y, weight, of.get(1, 0) / total if total else 0.5)


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, score, predicted) for each row: score from 0 to 1 is higher where label 1 is likelier; predicted is 1 from 0.5 on.

    The model that is broadcast has at most 2 * SAMPLE vectors. Null and empty texts get the labels' prior; texts are
    read whole; repeated rows are answered again; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def batch(cols):
        score = sent.value.score([terms(t or b"") for t in cols["text"]], neighbours)
        yield {"id": cols["id"], "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    kind = df.schema[id_col].dataType.simpleString()
    out = map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), batch, f"id {kind}, score double, predicted int", text="text")
    return out.withColumnRenamed("id", id_col)


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = classify(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
