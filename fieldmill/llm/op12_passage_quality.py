"""Quality of documents by attention over their passages (multiple-instance learning).

A document is a bag of passages of 64 words, of which only the bag is labelled. Each
passage is encoded by its figures: shares of kinds of characters, length and
variety of words, repeats within it and of what the document said before, and its
words hashed into 16 bins. A layer of tanh units makes a vector h of them, and
gated attention weighs the passages by softmax(w . (tanh(V h) * sigmoid(U h))). The
weighted sum of the vectors is the document, and a logistic unit scores it. All
weights are learned together from the documents' labels, by Adam over the whole sample.

Learning takes a bounded sample: ``FIT_DOCUMENTS`` labelled documents, the first by a
hash of doc_id, as long as all their passages are at most ``FIT_PASSAGES``. A
document of the sample is read whole; one with more passages than are left is passed
over. The sample's figures come to the driver, which learns; scoring runs over blocks of
texts in all tasks, with the weights (some thousand numbers). Texts over ``PIECE_BYTES``
are encoded in pieces, cut at white space where there is any; passages and "said
before" don't reach across pieces, the attention does.

Defined results: a null text is empty, and a text without words is one passage of
zeros; labels other than 0 and 1, of a doc_id with contradicting labels, and of a
doc_id with several documents teach nothing; if nothing can be learned every score is
0.5, and if only one label occurs every score is the smoothed share of ones; repeated rows get
equal scores; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, blocks, checkpoint, released, table, text_offsets

#: The bound of the sample that is learned from.
FIT_DOCUMENTS, FIT_PASSAGES = 4_000, 40_000
PASSAGE_WORDS = 64
PIECE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
HIDDEN, GATES, STEPS, RATE, DECAY = 16, 8, 300, 0.02, 1e-3
SEED = 20250112
#: A document below this score is predicted to be of label 0.
THRESHOLD = 0.3
WORD_BINS = 16
#: Kinds of bytes: lower case, capitals, digits, marks, calls, other punctuation, line ends, other white space, beyond ASCII, control.
KINDS = 10
WIDTH = KINDS + 5 + WORD_BINS


def _kinds() -> np.ndarray:
    kind = np.full(256, 9, dtype=np.int64)
    kind[33:127] = 5
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[list(b"#$%&*|")], kind[list(b"!?")] = 3, 4
    kind[[9, 11, 12, 32]], kind[[10, 13]] = 7, 6
    kind[128:] = 8
    return kind


KIND = _kinds()
_BYTE_VALUE = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a sum over its bytes' random values times powers of a factor, mixed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _FACTOR, dtype=np.uint64))
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    h = np.add.reduceat(_BYTE_VALUE[data[inside]] * powers[place], first)
    h ^= h >> np.uint64(29)
    return h * _FACTOR


def repeats(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a value occurred before in its group; groups are ascending."""
    key = np.lexsort((value, group))
    same = np.zeros(len(value), dtype=bool)
    g, v = group[key], value[key]
    same[key[1:]] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    return same


def encode_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The figures of all passages of the pieces between ``offsets``, and the number of passages of each piece."""
    space = (KIND[data] == 6) | (KIND[data] == 7)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    inside = ~space
    before = np.append(True, space[:-1]) if len(data) else space
    after = np.append(space[1:], True) if len(data) else space
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    piece = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(piece, minlength=len(offsets) - 1)
    passages = np.maximum(1, (words + PASSAGE_WORDS // 2) // PASSAGE_WORDS)
    first_passage = np.cumsum(passages) - passages
    at = np.arange(len(starts)) - (np.cumsum(words) - words)[piece]
    passage = first_passage[piece] + np.minimum(at // PASSAGE_WORDS, passages[piece] - 1)
    n = int(passages.sum())
    first_byte = np.zeros(n, dtype=np.int64)
    head = np.append(True, passage[1:] != passage[:-1]) if len(passage) else np.zeros(0, dtype=bool)
    first_byte[passage[head]] = starts[head]
    first_byte[first_passage] = offsets[:-1]
    size = np.diff(np.append(first_byte, offsets[-1]))
    h = word_hashes(data, inside, starts, ends - starts)
    count = np.bincount(passage, minlength=n)
    shares = np.maximum(count, 1)
    figures = np.zeros((n, WIDTH), dtype=np.float32)
    figures[:, :KINDS] = np.bincount(np.repeat(np.arange(n) * KINDS, size) + KIND[data], minlength=n * KINDS).reshape(n, KINDS) / np.maximum(size, 1)[:, None]
    k = KINDS
    figures[:, k] = np.log1p(np.bincount(passage, weights=ends - starts, minlength=n) / shares)
    figures[:, k + 1] = 1 - np.bincount(passage, weights=repeats(passage, h), minlength=n) / shares
    next_to = np.append(False, (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])) if len(h) else np.zeros(0, dtype=bool)
    figures[:, k + 2] = np.bincount(passage, weights=next_to, minlength=n) / shares
    if len(h) > 2:  # three words in a row, by the first one's place
        three = np.flatnonzero(piece[2:] == piece[:-2])
        value = (h[three] * _FACTOR + h[three + 1]) * _FACTOR + h[three + 2]
        figures[:, k + 3] = np.bincount(passage[three], weights=repeats(piece[three], value), minlength=n) / shares
    figures[:, k + 4] = np.log1p(count)
    bins = (h >> np.uint64(60)).astype(np.int64)
    figures[:, k + 5 :] = np.sqrt(np.bincount(passage * WORD_BINS + bins, minlength=n * WORD_BINS).reshape(n, WORD_BINS) / shares[:, None])
    return figures, passages


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, first, end) of parts of at most ``PIECE_BYTES``; each document has one at least."""
    for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > PIECE_BYTES:
            gaps = np.flatnonzero(KIND[data[a + PIECE_BYTES // 2 : a + PIECE_BYTES]] // 2 == 3)  # line ends and other white space
            cut = a + PIECE_BYTES // 2 + int(gaps[-1]) + 1 if len(gaps) else a + PIECE_BYTES
            yield doc, a, cut
            a = cut
        yield doc, a, b


def encode_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The figures of all passages of a column of texts without nulls, and the number of passages of each text."""
    offsets = text_offsets(column).astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    found, passages = [np.zeros((0, WIDTH), dtype=np.float32)], np.zeros(len(column), dtype=np.int64)
    waiting: list[tuple[int, int, int]] = []

    def flush() -> None:
        a = waiting[0][1]
        figures, counts = encode_pieces(data[a : waiting[-1][2]], np.array([p[1] for p in waiting] + [waiting[-1][2]]) - a)
        found.append(figures)
        np.add.at(passages, [p[0] for p in waiting], counts)
        waiting.clear()

    for part in pieces(data, offsets):
        if waiting and part[2] - waiting[0][1] > PIECE_BYTES:
            flush()
        waiting.append(part)
    if waiting:
        flush()
    return np.concatenate(found), passages


class AttentionModel:
    """Weights, and what they make of the figures of passages."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.spread = mean, spread
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.weights = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "c0": np.zeros(1)}

    def standard(self, figures: np.ndarray) -> np.ndarray:
        return np.clip((figures - self.mean) / self.spread, -8, 8)

    def forward(self, x: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        m, first = self.weights, np.cumsum(passages) - passages
        doc = np.repeat(np.arange(len(passages)), passages)
        h = np.tanh(x @ m["W"] + m["b"])
        t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
        s = (t * g) @ m["w"]
        e = np.exp(s - np.maximum.reduceat(s, first)[doc])
        attention = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(attention[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "attention": attention, "z": z, "score": 1 / (1 + np.exp(-(z @ m["c"] + m["c0"][0]))), "first": first, "doc": doc}

    def gradients(self, f: dict[str, np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        m, doc = self.weights, f["doc"]
        error = (f["score"] - label) / len(label)
        d_z = (error[:, None] * m["c"])[doc]
        inner = (f["h"] * d_z).sum(axis=1)
        d_s = f["attention"] * (inner - np.add.reduceat(f["attention"] * inner, f["first"])[doc])
        d_t = d_s[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2)
        d_g = d_s[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
        d_h = (f["attention"][:, None] * d_z + d_t @ m["V"].T + d_g @ m["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ d_h, "b": d_h.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g, "w": (f["t"] * f["g"]).T @ d_s, "c": f["z"].T @ error, "c0": np.array([error.sum()])}

    def fit(self, figures: np.ndarray, passages: np.ndarray, label: np.ndarray) -> None:
        x = self.standard(figures.astype(np.float64))
        slow = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, STEPS + 1):
            for k, d in self.gradients(self.forward(x, passages), label).items():
                d = d + DECAY * self.weights[k] * (k not in ("b", "c0"))
                slow[k] = 0.9 * slow[k] + 0.1 * d
                square[k] = 0.999 * square[k] + 0.001 * d * d
                self.weights[k] = self.weights[k] - RATE * (slow[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, figures: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return self.forward(self.standard(figures.astype(np.float64)), passages)["score"]


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32(doc_id as text) is a multiple of 5. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures of passages, passages of each document and labels of the bounded sample, in the order of the hash."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(f"{OWN}id")).agg(F.min(label).alias("least"), F.max(label).alias("most"))
    known = known.where("least = most AND least IN (0, 1)").select(f"{OWN}id", F.col("least").cast("int").alias(f"{OWN}label"))
    single = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count = 1").select("doc_id")
    order = [F.xxhash64(f"{OWN}id"), F.col(f"{OWN}id")]
    chosen = single.join(known, F.col("doc_id") == F.col(f"{OWN}id")).orderBy(*order).limit(FIT_DOCUMENTS).select(f"{OWN}id", f"{OWN}label")
    # FIT_DOCUMENTS rows at most
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col(f"{OWN}id")).select(f"{OWN}id", f"{OWN}label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                figures, passages = encode_texts(block.column(2))
                parts = np.split(figures, np.cumsum(passages)[:-1])
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(passages), pa.array([p.tobytes() for p in parts], pa.binary())], ["id", "label", "passages", "figures"])

    id_type = dict(docs.dtypes)["doc_id"]
    encoded = checkpoint(sample.mapInArrow(released(run), f"id {id_type}, label int, passages long, figures binary"))
    left, taken = FIT_PASSAGES, []
    for doc, passages in encoded.orderBy(F.xxhash64("id"), "id").select("id", "passages").collect():
        if passages <= left:
            left -= passages
            taken.append(doc)
    rows = encoded.where(F.col("id").isin(taken)).orderBy(F.xxhash64("id"), "id").collect() if taken else []
    figures = np.concatenate([np.zeros((0, WIDTH), dtype=np.float32), *[np.frombuffer(r["figures"], dtype=np.float32).reshape(-1, WIDTH) for r in rows]])
    return figures, np.array([r["passages"] for r in rows], dtype=np.int64), np.array([r["label"] for r in rows], dtype=np.float64)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> AttentionModel | float:
    """A model, or the one score that all documents get where the labels tell no two kinds apart."""
    figures, passages, marks = fit_sample(docs, labels, label)
    if not len(marks):
        return 0.5
    if marks.min() == marks.max():
        return float((marks.sum() + 1) / (len(marks) + 2))
    spread = figures.std(axis=0, dtype=np.float64)
    model = AttentionModel(figures.mean(axis=0, dtype=np.float64), np.where(spread > 1e-6, spread, 1.0))
    model.fit(figures, passages, marks)
    return model


def score_documents(docs: DataFrame, model: AttentionModel | float) -> DataFrame:
    """doc_id, score, and the attention's largest share with the number of its passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                figures, passages = encode_texts(block.column(1))
                if isinstance(model, float):
                    score, top, share = np.full(len(passages), model), np.zeros(len(passages), dtype=np.int64), 1 / passages
                else:
                    f = model.forward(model.standard(figures.astype(np.float64)), passages)
                    score, share = f["score"], np.maximum.reduceat(f["attention"], f["first"])
                    best = np.flatnonzero(f["attention"] == share[f["doc"]])
                    top = best[np.searchsorted(f["doc"][best], np.arange(len(passages)))] - f["first"]
                # products of matrices differ in their last bits with the rows of a block
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.round(score, 6)), pa.array(passages), pa.array(top), pa.array(np.round(share, 6))], ["doc_id", "score", "n_passages", "top_passage", "top_attention"])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {id_type}, score double, n_passages long, top_passage long, top_attention double")


def op12_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_passage", "top_attention")
