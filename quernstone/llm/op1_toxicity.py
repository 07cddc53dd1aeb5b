"""Toxicity (operator 1): a word is the bag of its character n-grams, each n-gram has an embedding, and the embeddings' average over
words goes through a linear softmax; embeddings and softmax are trained jointly in numpy. A misspelling never seen shares most of its
n-grams with the word that is meant. As everything before the softmax is linear, a trained word needs one number.

A document's score is that of its WORST worst words, wherever in its whole text they stand (of its one word, if it has one); training learns from the same
words, so a few words in a long text count as much as in a short one, and one clean word that looks bad isn't enough where the next worst doesn't.
A text without words, and a null text, scores 0. Repeated rows are scored alike; an empty table gives an empty result; columns with other names,
whatever they are, play no part. Only the text is an input; labels are learned from rows whose crc32(doc_id) mod 4 is not 2, and from at most
TRAIN_ROWS of each class (those of least hash), which is what bounds the driver's work: of each such document it gets the distinct words of the whole text.
Of contradicting labels the larger counts; null labels none; of several texts with the id of a label the least is learned from. Without labels of both
classes every score is the share of label 1 (0 without any)."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import U64, by_bytes, mix, text_of, text_pieces, tidily, tidy
from quernstone.session import table

TRAIN_ROWS = 4000
BITS, DIM, GRAMS, WORST, STEPS, THRESHOLD = 17, 16, (3, 4, 5, 6), 3, 1200, 0.3
RATE, DECAY = 0.3, 1e-3
MEMO, AT_ONCE = 120_000, 10_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, one word after another, and where each word's begin. Every word has at least one.
    Words are taken AT_ONCE at a time, which bounds what is held besides the result."""
    if len(words) > AT_ONCE:
        parts = [grams(words[o : o + AT_ONCE]) for o in range(0, len(words), AT_ONCE)]
        before = np.cumsum([0, *(len(ids) for ids, _ in parts[:-1])])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([starts + n for (_, starts), n in zip(parts, before)])
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    chars = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) if words else np.empty(0, U64)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left = np.repeat(ends, lens) - np.arange(len(chars))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(words)), lens)
    found, whose = [], []
    h = chars.copy()
    for n in range(2, GRAMS[-1] + 1):
        h = h[:-1] * U64(0x9E3779B97F4A7C15) + chars[n - 1 :] if len(h) > 1 else h[:0]
        if n in GRAMS or n == 2:
            ok = left[: len(h)] >= n if n in GRAMS else (lens[owner[: len(h)]] == 2) & (left[: len(h)] == 2)
            found.append(mix(h[ok] + U64(n)) >> U64(64 - BITS))
            whose.append(owner[: len(h)][ok])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(found).astype(np.int32)[order], np.searchsorted(whose[order], np.arange(len(words)))


def words_of(text: str) -> list[str]:
    return text.lower().split()


_edge = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡«»¿"


def bare(words: list[str]) -> list[str]:
    return [w.strip(_edge) or w for w in words]


def examples(text: str) -> Counter[str]:
    """What training takes of a text: its words without edges, and how often each stands there."""
    return Counter(bare(words_of(text)))


class Model:
    """One number for each n-gram bucket, and the bias: what scoring needs of the trained embeddings and softmax."""

    def __init__(self, value: np.ndarray | None, bias: float):
        self.value, self.bias, self.memo = value, bias, {}

    def __reduce__(self):
        return Model, (self.value, self.bias)

    def word_values(self, words: list[str]) -> np.ndarray:
        out = [np.empty(0)]
        for o in range(0, len(words), AT_ONCE):
            ids, starts = grams(bare(words[o : o + AT_ONCE]))
            out.append(np.add.reduceat(self.value[ids], starts) / np.diff(np.append(starts, len(ids))))
        return np.concatenate(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.value is None:
            return np.full(len(texts), self.bias)
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, words, counts = self.memo, [], []
        for t in texts:
            own = words_of(t)
            counts.append(len(own))
            words += own
        new = list(set(words).difference(memo))
        memo.update(zip(new, self.word_values(new).tolist()))
        values = np.fromiter(map(memo.__getitem__, words), float, len(words))
        out, at = np.zeros(len(texts)), 0
        for i, n in enumerate(counts):
            if n:
                w = min(n, WORST)
                worst = np.partition(values[at : at + n], n - w)[n - w :].mean()
                out[i] = 1 / (1 + np.exp(-np.clip(worst + self.bias, -40, 40)))
            at += n
        return out


def gradients(emb: np.ndarray, soft: np.ndarray, bias: np.ndarray, flat: np.ndarray, share: np.ndarray, whose: np.ndarray, y: np.ndarray):
    """Of the mean softmax loss of a batch, by the scores of the softmax, its bias and the embeddings in `where`. flat: buckets of n-grams; share:
    the weight of each in its example's average; whose: its example."""
    mean = np.zeros((len(y), emb.shape[1]), emb.dtype)
    np.add.at(mean, whose, emb[flat] * share[:, None])
    logit = mean @ soft.T + bias
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -np.log(p[np.arange(len(y)), y]).mean()
    p[np.arange(len(y)), y] -= 1
    where, inverse = np.unique(flat, return_inverse=True)
    grad = np.zeros((len(where), emb.shape[1]), emb.dtype)
    np.add.at(grad, inverse, (p @ soft)[whose] * share[:, None])
    return loss, p.T @ mean / len(y), p.mean(0), where, grad / len(y)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    return train_words([examples(t) for t in texts], labels, seed)


def train_words(texts: Iterable[Mapping[str, int]], labels: list[int], seed: int = 7) -> Model:
    """Adagrad on minibatches, its rate falling to nothing. First random words of a document are its example, then its worst words under the model so far."""
    y = np.asarray(labels)
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [(np.fromiter((vocab.setdefault(w, len(vocab)) for w in counts), np.int32), np.fromiter(counts.values(), np.int32)) for counts in texts]
    del texts
    ids, starts = grams(list(vocab))
    n_words = len(vocab)
    del vocab
    tidy()
    n_grams = np.diff(np.append(starts, len(ids)))
    emb = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 1.0, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    ge, gs, gb = np.full(1 << BITS, 1e-2, np.float32), np.full((2, DIM), 1e-2, np.float32), np.full(2, 1e-2, np.float32)
    able = np.array([i for i, (own, _) in enumerate(docs) if len(own)], int)
    epochs = max(2, -(-STEPS * 64 // max(1, len(able))))
    for epoch in range(epochs):
        order = rng.permutation(able)
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            if epoch:
                value = emb @ (soft[1] - soft[0])
                used = np.unique(np.concatenate([docs[i][0] for i in batch]))
                flat = _ranges(starts[used], n_grams[used])
                z = np.zeros(n_words)
                z[used] = np.add.reduceat(value[ids[flat]], np.cumsum(n_grams[used]) - n_grams[used]) / n_grams[used]
            chosen, left = [], 1 - (epoch * len(order) + lo) / (epochs * len(order))
            for i in batch:
                own, n = docs[i]
                d = np.repeat(own, np.minimum(n, WORST))  # candidates for the worst
                chosen.append(d[np.argpartition(-z[d], min(len(d), WORST) - 1)[:WORST]] if epoch else rng.choice(own, min(int(n.sum()), 6 * WORST), p=n / n.sum()))
            words = np.concatenate(chosen)
            whose = np.repeat(np.arange(len(chosen)), [len(r) for r in chosen])
            size = np.bincount(whose)
            flat = ids[_ranges(starts[words], n_grams[words])]
            share = np.repeat(1.0 / (n_grams[words] * size[whose]), n_grams[words]).astype(np.float32)
            _, d_soft, d_bias, where, grad = gradients(emb, soft, bias, flat, share, np.repeat(whose, n_grams[words]), y[batch])
            grad *= len(batch)  # steps of embeddings are by the example: few share an n-gram
            ge[where] += (grad**2).mean(1)
            emb[where] -= left * RATE * (grad + DECAY * emb[where]) / np.sqrt(ge[where])[:, None]
            gs += d_soft**2
            gb += d_bias**2
            soft -= left * 0.1 * d_soft / np.sqrt(gs)
            bias -= left * 0.1 * d_bias / np.sqrt(gb)
    return Model((emb @ (soft[1] - soft[0])).astype(np.float64), float(bias[1] - bias[0]))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@tidily
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, y, text -> doc_id, y, words, counts."""
    for b in batches:
        for lo, hi, texts in text_pieces(b.column(2), 1 << 20):
            found = [examples(t) for t in texts]
            words, counts = (pa.array(map(list, x), pa.list_(t)) for x, t in ((found, pa.string()), ([f.values() for f in found], pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), words, counts], ["doc_id", "y", "words", "counts"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Trains on at most `rows` labelled documents of each class. Labelled ids are sampled first; one text of each is cut into words where it is, and only these
    come to the driver."""
    by_bytes(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    picked = [r for c in (0, 1) for r in known.where(F.col("y") == c).orderBy(order, "doc_id").limit(rows).collect()]
    if not picked:
        return Model(None, 0.0)
    ids = docs.sparkSession.createDataFrame([(int(r["doc_id"]), r["y"]) for r in picked], "__id long, y int")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    one = plain.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = [one.mapInArrow(_examples, "doc_id long, y int, words array<string>, counts array<int>").toArrow().sort_by("doc_id")]
    y = got[0].column("y").to_pylist()
    return train_words(_taken(got.pop()), y)  # no name holds the table once its words are numbers


def _taken(rows: pa.Table) -> Iterator[dict[str, int]]:
    words, counts = rows.column("words"), rows.column("counts")
    for i in range(len(words)):
        yield dict(zip(words[i].as_py(), counts[i].as_py()))


@tidily
def _score(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, texts in text_pieces(b.column(1), 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(model.scores(texts))], ["doc_id", "score"])
    model.memo = {}  # workers live on


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row: one pass over the texts, nothing shuffled. The model (1 MB, whatever the corpus) goes with the task."""
    by_bytes(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return plain.mapInArrow(functools.partial(_score, model), "doc_id long, score double")


@tidily
def _clean(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns, then the text: the rows that score below THRESHOLD, without that last column."""
    for b in batches:
        for lo, hi, texts in text_pieces(b.column(b.num_columns - 1), 1 << 20):
            ok = pa.array(model.scores(texts) < THRESHOLD)
            yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo).filter(ok) for c in b.columns[:-1]], names=b.schema.names[:-1])
    model.memo = {}


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below THRESHOLD, all their columns as they were."""
    by_bytes(docs.sparkSession)
    return docs.select(*docs.columns, text_of().alias("__text")).mapInArrow(functools.partial(_clean, model), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
