"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against unlabelled text.

After Kiryo et al., "Positive-unlabeled learning with non-negative risk estimator"
(2017). The classifier is linear over the distinct hashed words, and beginnings of
words, of a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare

#: Width of the hashed word space; letters of the beginnings of words, which stand for a word's compounds.
BITS, BEGINNINGS = 20, (3, 4, 5)
#: ASCII marks and digits part words.
_MARKS = bytes(32 if chr(b) in "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """The distinct lower-cased words of a text."""
    return set((text or "").lower().encode().translate(_MARKS).split())


def places_of(word: bytes) -> tuple[int, ...]:
    """Where a word and its beginnings stand in the hashed space."""
    letters = word.decode()
    return tuple({crc32(x) & ((1 << BITS) - 1) for x in (word, *(b"^" + letters[:n].encode() for n in BEGINNINGS if len(letters) >= n))})


class Places(dict):
    """places_of, kept for frequent words; `of` gives the distinct places of a text."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = places_of(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        found = set().union(*map(self.__getitem__, words_of(text)))
        return np.sort(np.fromiter(found, np.int64, len(found)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = Places()
    for batch in batches:
        found = [places.of(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "words"])


def nn_risk(score: np.ndarray, is_pos: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk of positive texts taken as toxic, that of clean ones, which may be below zero, and the step's gradient by score.

    The gradient is that of the sum; below zero, that of the second part, turned round.
    """
    n, m = int(is_pos.sum()), int((~is_pos).sum())
    up = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    down_risk = np.logaddexp(0, score)
    toxic, clean = prior * (down_risk - score)[is_pos].mean(), down_risk[~is_pos].mean() - prior * down_risk[is_pos].mean()
    push = np.where(is_pos, -prior / n * up, up / m)
    push = np.where(is_pos, prior / n * (up - 1), 0) + push if clean >= 0 else -push
    return float(toxic), float(clean), push


def train(ids: np.ndarray, sizes: np.ndarray, is_pos: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 2e-4, least_docs: int = 3, least_z: float = 4.0) -> tuple[np.ndarray, float]:
    """Of texts whose words stand one after the other in `ids`, `sizes` of them each: weights and offset that lower the non-negative risk: prior * R(p, +) + max(0, R(u, -) - prior * R(p, -)), logistic loss.

    When the second part, the risk of unlabelled texts taken as clean less that of
    positive ones, falls below zero, the step goes back up its gradient, as in the
    paper. Weights go to words in `least_docs` texts or more that positive texts
    hold more often than all do, by `least_z` standard deviations or more.
    """
    width, n, m = 1 << BITS, int(is_pos.sum()), int((~is_pos).sum())
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    held = np.bincount(ids, minlength=width)
    share = np.minimum(held / max(1, n + m), 1 - 1e-9)
    surplus = np.bincount(ids[is_pos[row]], minlength=width) - n * share
    common = (held >= least_docs) & (surplus >= least_z * np.sqrt(n * share * (1 - share)))
    row = row[common[ids]]
    used = np.flatnonzero(common)
    place = np.zeros(width, np.int64)
    place[used] = np.arange(len(used))
    col = place[ids[common[ids]]]
    w, b = np.zeros(len(used)), -1.0
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):
        _, _, push = nn_risk(np.bincount(row, w[col], minlength=n + m) + b, is_pos, prior)
        g = np.append(np.bincount(col, push[row], minlength=len(used)) + decay * w, push.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros(width, np.float32)
    out[used] = w
    return out, float(b)


def _score(weights: np.ndarray, offset: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            scores = [offset + float(weights[places.of(x)].sum()) for x in batch.column("text").to_pylist()]
            x = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.float64())], names=["doc_id", "score"])

    return run


def fold(doc_id: Column) -> Column:
    """True for documents that are held out: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = 5000, unlabelled: int = 10000, prior: float | None = None) -> DataFrame:
    """Score every whole text: (doc_id, held_out, score, predicted).

    The classifier is fitted on the driver from at most `positives` texts labelled
    toxic and about `unlabelled` texts taken without labels, both chosen by hash of
    their id; these two bounds hold at any corpus size. No row of the
    held-out fold is among them. `prior`, the share of toxic texts, is by default
    that among their labels. Scoring reads each text once and shuffles nothing.

    Null and empty texts have no words and get the score of the offset. Null ids
    are scored, never held out. An id with several labels is toxic if one says so;
    null labels say nothing. Without toxic labels every score is 0. Repeated rows
    are scored each. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    known = pick(labels, doc_id="doc_id", toxic="toxic").select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where("toxic is not null and doc_id is not null")
    known = known.where(~fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k")).first()
    total = rows.count()
    if not counts["k"] or not total:
        return rows.select("doc_id", fold(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    chosen = known.where("toxic = 1").orderBy(F.xxhash64(F.lit("toxic"), "doc_id")).limit(positives).select("doc_id", "toxic")
    taken = ~fold(F.col("doc_id")) & (F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(total)) < unlabelled * 5 // 4)
    sample = rows.join(F.broadcast(chosen), "doc_id", "left").where(F.col("toxic").isNotNull() | taken)
    sample = sample.select("text", F.explode(F.array_compact(F.array("toxic", F.when(taken, 0)))).alias("toxic"))
    found = sample.mapInArrow(_features, "toxic int, words array<int>").toArrow()
    words = found.column("words").combine_chunks()
    weights, offset = train(words.flatten().to_numpy(), words.value_lengths().to_numpy(), found.column("toxic").to_numpy() == 1, prior or counts["k"] / counts["n"])
    del found, words
    scored = rows.mapInArrow(_score(weights, offset), "doc_id bigint, score double")
    return scored.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that `toxicity` predicts to be toxic; all columns stay. Rows without an id are kept."""
    bad = toxicity(docs, labels, **options).where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("cw_bad")).distinct()
    at = docs.columns.index("doc_id")
    plain = docs.toDF(*(f"cw_{i}" for i in range(len(docs.columns))))
    left = plain.join(bad, F.col(f"cw_{at}").cast("bigint") == F.col("cw_bad"), "left_anti")
    return left.select(*(F.col(f"cw_{i}").alias(n) for i, n in enumerate(docs.columns)))
