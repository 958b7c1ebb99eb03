"""Quality scores from learned vectors of hashed words and character n-grams.

A word is the mean of its own vector and those of its n-grams, with marks at its
ends; a pair of neighbours has a vector too, and all pairs of a word with itself
share one, so that stuttering is seen whatever the word. A text is the mean over
its words and pairs, and a softmax over two labels of it is the score. Vectors and
softmax are learned by stochastic gradient descent in numpy: shards of the sample
are passed through at once, each from the same model, and averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import Staging, prepare
from postweave.llm.ragged import gather, portions, split_words

# Hashed vectors and their width: 2 MB a model.
BUCKETS = 1 << 16
WIDTH = 8
NGRAMS = (3, 4, 5)
# At most so many labelled documents of each label are learned from, those with the
# smallest hash of their id; all documents are scored.
SAMPLE = 2048
# Parts of the sample that are passed through at once, and passes over them.
SHARDS = 4
PASSES = 8
RATE = 0.5
# One id in HOLD is held out.
HOLD = 5
THRESHOLD = 0.3
SEED = 11
# Bytes of text whose words and n-grams are held at once; a longer text is held alone.
PORTION = 1 << 20

_FACTOR = np.uint64(0x100000001B3)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int32)


def word_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and its n-grams, their number per word, the words' hashes.

    An n-gram is n bytes in a row of the word with a mark before and after it.
    """
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and len(words) else np.zeros(0, np.uint8)
    sizes = np.diff(ends) + 2
    stops = np.cumsum(sizes)
    starts = stops - sizes
    flat = np.full(int(sizes.sum()), 256, np.uint64)
    inner = np.ones(len(flat), bool)
    inner[starts] = inner[stops - 1] = False
    flat[inner] = data
    flat[stops - 1] = 257
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _FACTOR, np.uint64))
    place = np.arange(len(flat), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    whole = np.add.reduceat((flat + np.uint64(1)) * powers[place], starts) if len(flat) else np.zeros(0, np.uint64)
    owners, buckets = [np.arange(len(words), dtype=np.int32)], [_bucket(whole)]
    left = np.repeat(sizes.astype(np.int32), sizes) - place
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        found = np.full(len(at), n, np.uint64)
        for k in range(n):
            found = found * _FACTOR + flat[at + k]
        owners.append(owner[at])
        buckets.append(_bucket(found))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owners, minlength=len(words)), whole


@dataclass
class Portion:
    """Texts as tokens: distinct words with their buckets, and pairs of neighbours."""

    counts: np.ndarray  # words per text
    codes: np.ndarray  # place of each token's word among the distinct ones
    buckets: np.ndarray  # of all distinct words, one word after another
    sizes: np.ndarray  # buckets per distinct word
    pairs: np.ndarray  # bucket of each pair
    pair_counts: np.ndarray  # pairs per text


def read(texts: pa.Array) -> Portion:
    words, counts = split_words(texts, lower=False)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    buckets, sizes, whole = word_buckets(coded.dictionary)
    hashes = whole[codes]
    # Pairs lie inside a text: not from its last word on.
    last = np.zeros(len(codes), bool)
    ends = np.cumsum(counts)
    last[ends[counts > 0] - 1] = True
    first = np.flatnonzero(~last)
    a, b = hashes[first], hashes[first + 1] if len(first) else hashes[first]
    pairs = _bucket(np.where(a == b, np.uint64(1), a * np.uint64(0x9E3779B97F4A7C15) + b))
    return Portion(counts, codes, buckets, sizes, pairs, np.maximum(counts - 1, 0))


def _row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), values.shape[1]), np.float64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


@dataclass
class Model:
    """Vectors of the buckets, and the softmax over the two labels."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def first(cls) -> Model:
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        return cls(vectors, np.zeros((WIDTH, 2)), np.zeros(2))

    def pack(self) -> bytes:
        return self.vectors.tobytes() + self.weights.tobytes() + self.bias.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        cut = BUCKETS * WIDTH * 4
        rest = np.frombuffer(data, np.float64, offset=cut)
        vectors = np.frombuffer(data, np.float32, BUCKETS * WIDTH).reshape(BUCKETS, WIDTH)
        return cls(vectors.copy(), rest[:-2].reshape(WIDTH, 2).copy(), rest[-2:].copy())

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text; a text without words has the bias alone."""
        p = read(texts)
        words = _row_sums(self.vectors[p.buckets], p.sizes) / p.sizes[:, None]
        total = _row_sums(words.astype(np.float32)[p.codes], p.counts) + _row_sums(self.vectors[p.pairs], p.pair_counts)
        means = total / np.maximum(p.counts + p.pair_counts, 1)[:, None]
        out = means @ self.weights + self.bias
        return 1 / (1 + np.exp(np.clip(out[:, 0] - out[:, 1], -500, 500)))

    def learn(self, label: int, buckets: np.ndarray, shares: np.ndarray, rate: float) -> None:
        """One step on one text, the sum of ``shares`` of its buckets' vectors.

        The vectors' step is divided by the squared length of the shares, so long
        texts move their mean as far as short ones.
        """
        mean = shares @ self.vectors[buckets] if len(buckets) else np.zeros(WIDTH)
        out = mean @ self.weights + self.bias
        off = np.exp(out - out.max())
        off /= off.sum()
        off[label] -= 1
        back = self.weights @ off
        self.weights -= rate * np.outer(mean, off)
        self.bias -= rate * off
        if len(buckets):
            step = shares * (rate / (shares @ shares))
            self.vectors[buckets] -= (step[:, None] * back).astype(np.float32)


def shares_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text: distinct buckets, and what they add to its mean."""
    p = read(texts)
    out = []
    word_ends, ends, pair_ends = np.cumsum(p.sizes), np.cumsum(p.counts), np.cumsum(p.pair_counts)
    for end, n, pair_end, pairs in zip(ends, p.counts, pair_ends, p.pair_counts, strict=True):
        words, times = np.unique(p.codes[end - n : end], return_counts=True)
        found, sizes = gather(p.buckets, word_ends, words)
        share = np.repeat(times / np.maximum(sizes, 1), sizes)
        every = np.concatenate([found, p.pairs[pair_end - pairs : pair_end]])
        weight = np.bincount(every, np.concatenate([share, np.ones(pairs)]), BUCKETS) / max(n + pairs, 1)
        kept = np.flatnonzero(weight)
        out.append((kept, weight[kept]))
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(HOLD)) == 0


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for part in portions(batch.column(3), PORTION):
            found = shares_of(part)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(first, len(part)) for c in range(3)],
                    pa.array([b.astype(np.uint16).tobytes() for b, _ in found], pa.binary()),
                    pa.array([s.astype(np.float32).tobytes() for _, s in found], pa.binary()),
                ],
                names=["shard", "place", "label", "buckets", "shares"],
            )
            first += len(part)


EXAMPLES = "labels array<int>, buckets array<binary>, shares array<binary>"


def _shard(table: pa.Table) -> pa.Table:
    """All examples of a shard as one row, in the order of their places."""
    table = table.sort_by([("place", "ascending"), ("label", "ascending")])
    ends = pa.array([0, len(table)], pa.int32())
    columns = [table.column(c).combine_chunks() for c in ("label", "buckets", "shares")]
    return pa.Table.from_arrays([pa.ListArray.from_arrays(ends, c) for c in columns], ["labels", "buckets", "shares"])


def sample(staging: Staging, docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(labels, buckets, shares) of the documents that are learned from, one row a shard; stored.

    Of each label the ``most`` ids with the smallest hash, none of them held out;
    an id counts once for a label, with the text of smallest hash where several
    rows have it. A document has at most BUCKETS entries of 6 bytes, however long.
    """
    known = labels.filter("doc_id is not null").select(
        labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label")
    ).filter(~held_out(F.col("doc_id"))).distinct()
    place = F.xxhash64("doc_id", F.lit(SEED))
    firsts = [known.filter(F.col("label") == k).orderBy(place, "doc_id").limit(most) for k in (0, 1)]
    ids = staging(firsts[0].unionByName(firsts[1]), "quality-sample")
    # At most two times ``most`` rows.
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")
    )
    rows = rows.select(F.pmod(place, F.lit(SHARDS)).cast("int").alias("shard"), place.alias("place"), "label", "text")
    rows = rows.mapInArrow(_featured, "shard int, place long, label int, buckets binary, shares binary")
    dealt = rows.repartition(SHARDS, "shard").groupBy("shard")
    return staging(dealt.applyInArrow(_shard, EXAMPLES), "quality-features")


def _learner(shared, turn: int, passes: int):
    """One pass over each shard from the shared model, in an order of the pass."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = Model.unpack(shared.value)
                labels, buckets, shares = (batch.column(c)[row].values for c in range(3))
                order = np.random.default_rng([SEED, turn]).permutation(len(labels))
                for done, i in enumerate(order):
                    rate = RATE * (1 - (turn + done / len(order)) / passes)
                    found = np.frombuffer(buckets[i].as_py(), np.uint16).astype(np.int64)
                    own.learn(
                        labels[i].as_py(), found, np.frombuffer(shares[i].as_py(), np.float32).astype(np.float64), rate
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(labels)]), pa.array([own.pack()], pa.binary())], names=["n", "model"]
                )

    return learn


def fit(rows: DataFrame, passes: int = PASSES) -> Model:
    """The model after ``passes`` over the stored ``sample``.

    A pass sends the model to the shards and takes the mean of theirs, weighted by
    their documents: SHARDS models of 2 MB reach the driver. Without any document
    all texts score 0.5.
    """
    model = Model.first()
    for turn in range(passes):
        shared = rows.sparkSession.sparkContext.broadcast(model.pack())
        made = rows.mapInArrow(_learner(shared, turn, passes), "n long, model binary").collect()
        shared.destroy()
        if not made:
            break
        total = sum(r.n for r in made)
        parts = sorted(((r.n / total, bytes(r.model)) for r in made), key=lambda x: x[1])
        models = [(share, Model.unpack(data)) for share, data in parts]
        model = Model(
            sum(s * m.vectors for s, m in models).astype(np.float32),
            sum(s * m.weights for s, m in models),
            sum(s * m.bias for s, m in models),
        )
    return model


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    The whole text is scored, from its words alone. Null and empty texts have the
    score of a text without words; equal texts score the same. A row without an
    id is not held out and is not learned from. Labels other than 0 and 1 are
    ignored; further columns are not read. An empty table gives no rows.
    """
    prepare(spark)
    model = spark.sparkContext.broadcast(fit(sample(Staging(spark), docs, labels)).pack())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpack(model.value)
        for batch in batches:
            found = [own.scores(part) for part in portions(batch.column(2), PORTION)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
