"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Learned filters run over every chunk and
are max-pooled; a hidden layer reads the pooled filters of a chunk and how full it is; its units' mean and maximum over all chunks give one
probability.  Training runs on the driver over a bounded sample of labelled rows; scoring runs in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, STEP = 256, 224
WIDTH, STRIDE, DIMS, FILTERS, HIDDEN = 8, 2, 8, 24, 16
#: Bounds of the training sample: labelled rows (those with the smallest hash of doc_id), chunks of each, spread evenly over it.
SAMPLE_ROWS, SAMPLE_CHUNKS = 4000, 64
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.004, 1
#: Part of the training documents that are cropped in an epoch, and to how many bytes.
CROPPED, CROP_BYTES = 0.15, (12, 160)
THRESHOLD = 0.3
#: Chunks that are run through the filters at a time.
AT_A_TIME = 256


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a NULL doc_id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes that cover the text; zeros pad the last chunk, and an empty text is one chunk of zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = 1 + max(0, -(-(len(data) - CHUNK) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def filled(rows: np.ndarray) -> np.ndarray:
    """The part of each chunk that is not padding, as a column."""
    return ((rows > 0).sum(1, keepdims=True) / CHUNK).astype(np.float32)


@dataclass
class Network:
    embed: np.ndarray  # 256, DIMS
    filters: np.ndarray  # WIDTH, DIMS, FILTERS
    offset: np.ndarray  # FILTERS
    hidden: np.ndarray  # FILTERS + 1, HIDDEN
    hidden_offset: np.ndarray  # HIDDEN
    out: np.ndarray  # 2 * HIDDEN + 1

    @classmethod
    def initial(cls) -> Network:
        r = np.random.default_rng(SEED)
        draw = lambda *shape: r.normal(0, shape[-2] ** -0.5 if len(shape) > 1 else 0.1, shape).astype(np.float32)
        return cls(draw(256, DIMS) * 8, draw(WIDTH, DIMS, FILTERS) * 0.5, np.zeros(FILTERS, np.float32), draw(FILTERS + 1, HIDDEN), np.full(HIDDEN, 0.1, np.float32), draw(2 * HIDDEN + 1))

    def table(self) -> np.ndarray:
        """What a byte at each place of a filter adds: WIDTH, 256, FILTERS."""
        return np.einsum("bd,wdf->wbf", self.embed, self.filters, optimize=True).astype(np.float32)

    def pooled(self, rows: np.ndarray, table: np.ndarray, where: bool = False):
        """Largest response of each filter in each chunk (n, FILTERS), and its place if asked for."""
        best, place = [], []
        last = CHUNK - WIDTH + 1
        for at in range(0, len(rows), AT_A_TIME):
            some = rows[at : at + AT_A_TIME]
            total = np.take(table[0], some[:, 0:last:STRIDE], axis=0)
            for w in range(1, WIDTH):
                total += np.take(table[w], some[:, w : last + w : STRIDE], axis=0)
            best.append(total.max(1))
            if where:
                place.append(total.argmax(1))
        best = np.concatenate(best) + self.offset
        return (best, np.concatenate(place)) if where else best

    def probability(self, best: np.ndarray, full: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """From the pooled filters of all chunks; document i has the chunks from starts[i]."""
        # In double precision, so that a score does not depend on what else is in the batch.
        h = np.maximum(np.hstack([np.maximum(best, 0), full]).astype(np.float64) @ self.hidden + self.hidden_offset, 0)
        counts = np.diff(np.append(starts, len(best)))[:, None]
        doc = np.concatenate([np.add.reduceat(h, starts) / counts, np.maximum.reduceat(h, starts)], 1)
        return np.round(1 / (1 + np.exp(-np.clip(doc @ self.out[:-1] + self.out[-1], -30, 30))), 9)

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        rows = np.concatenate(docs)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        best, place = self.pooled(rows, self.table(), where=True)
        m = np.hstack([np.maximum(best, 0), filled(rows)])
        z = m @ self.hidden + self.hidden_offset
        h = np.maximum(z, 0)
        counts = np.bincount(owner)[:, None]
        top = np.maximum.reduceat(h, starts)
        doc = np.concatenate([np.add.reduceat(h, starts) / counts, top], 1)
        p = 1 / (1 + np.exp(-np.clip(doc @ self.out[:-1] + self.out[-1], -30, 30)))
        d_logit = ((p - labels) / len(docs)).astype(np.float32)
        d_doc = np.outer(d_logit, self.out[:-1])
        tops = (h == top[owner]) & (h > 0)
        share = tops / np.maximum(1, np.add.reduceat(tops.astype(np.float32), starts))[owner]
        d_h = (d_doc[:, :HIDDEN] / counts)[owner] + d_doc[:, HIDDEN:][owner] * share
        d_z = (d_h * (z > 0)).astype(np.float32)
        d_m = (d_z @ self.hidden[:-1].T) * (best > 0)
        d_table = np.zeros((WIDTH, 256, FILTERS), np.float32)
        n, f = np.nonzero(d_m)
        for w in range(WIDTH):
            np.add.at(d_table[w], (rows[n, place[n, f] * STRIDE + w], f), d_m[n, f])
        return {
            "embed": np.einsum("wbf,wdf->bd", d_table, self.filters, optimize=True), "filters": np.einsum("wbf,bd->wdf", d_table, self.embed, optimize=True),
            "offset": d_m.sum(0), "hidden": m.T @ d_z, "hidden_offset": d_z.sum(0), "out": np.append(d_logit @ doc, d_logit.sum()),
        }


def cropped(doc: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Now and then only the start of a document's first chunk, so that short texts are learned too."""
    if random.random() >= CROPPED:
        return doc
    short = doc[:1].copy()
    short[0, int(random.integers(*CROP_BYTES)) :] = 0
    return short


def train(docs: list[np.ndarray], labels: np.ndarray) -> Network:
    """Adam on the cross-entropy, with a step that falls to zero."""
    net, random = Network.initial(), np.random.default_rng(SEED)
    names = ("embed", "filters", "offset", "hidden", "hidden_offset", "out")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step, steps = 0, EPOCHS * -(-len(docs) // BATCH)
    for _ in range(EPOCHS):
        order = random.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for name, g in net.gradients([cropped(docs[i], random) for i in some], labels[some]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                change = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                setattr(net, name, (getattr(net, name) - change).astype(np.float32))
    return net


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, chunks of the training sample: labelled rows outside the held-out fold, SAMPLE_ROWS at most."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))

    def cut(batches):
        for batch in batches:
            cuts = []
            for text in batch["text"].to_pylist():
                c = chunks(text)
                cuts.append(c[np.unique(np.linspace(0, len(c) - 1, SAMPLE_CHUNKS).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(cuts, pa.binary())], ["doc_id", "quality", "chunks"])

    return rows.select("doc_id", "text", "quality").mapInArrow(cut, "doc_id bigint, quality int, chunks binary")


def fit(sample: DataFrame) -> Network:
    """Train on the sample; without any labelled row the network stays untrained and is right by chance only."""
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["quality"], bytes(r["chunks"])))[:SAMPLE_ROWS]
    if not rows:
        return Network.initial()
    return train([np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in rows], np.array([r["quality"] for r in rows], np.float32))


def scored(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1) and quality_predicted (1 from THRESHOLD on) in place of the text.

    NULL counts as an empty text, which gets a score as well.  Repeated rows score alike; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        net = model.value
        table = net.table()
        for batch in batches:
            found = np.zeros(batch.num_rows)
            texts, at = batch[text], 0
            while at < batch.num_rows:
                parts, first = [], at
                while at < batch.num_rows and sum(map(len, parts)) < 16 * AT_A_TIME:
                    parts.append(chunks(texts[at].as_py()))
                    at += 1
                rows = np.concatenate(parts)
                found[first:at] = net.probability(net.pooled(rows, table), filled(rows), np.cumsum([0, *map(len, parts[:-1])]))
            columns = [batch[c] for c in keep] + [pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "quality_score", "quality_predicted"])

    kept = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text)
    return kept.mapInArrow(run, f"{schema}{', ' if schema else ''}quality_score double, quality_predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(labelled(docs, labels)))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
