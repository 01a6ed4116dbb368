"""Toxicity by non-negative positive-unlabelled learning.

Known: some confirmed toxic texts, and a mass of texts of which a share ``prior`` is toxic.
With g the classifier's logit and l the logistic loss, the risk

    prior * E_pos[l(g)] + max(0, E_all[l(-g)] - prior * E_pos[l(-g)])

needs no negative examples: the bracket is the risk on negatives, estimated as that on all
texts less the positives' part.  When the estimate of this part falls below zero the model
has begun to fit the positives among the unlabelled, and a step against its gradient is made.

Features are words and word beginnings (4 to 7 bytes), lower-cased and hashed; those that
tell positives from the mass are counted over all training texts, the linear classifiers on
their presence are trained with numpy on a bounded sample, and averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, lean, small_arrow, written
from graphloom.llm.textscan import WORD, Slice, slices

BITS = 22
BEGINNINGS = (4, 5, 6, 7)


def features(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for all words and word beginnings of a slice, with repeats."""
    starts, ends, text = piece.words(WORD)
    ranges = piece.hashes()
    found, texts = [ranges.of(starts, ends)], [text]
    for n in BEGINNINGS:
        long = ends - starts >= n
        found.append(ranges.of(starts[long], starts[long] + n) ^ np.uint64(n))
        texts.append(text[long])
    return np.concatenate(texts), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def pairs(piece: Slice, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, number of feature) of a slice; ``chosen`` maps features to numbers or -1."""
    texts, found = features(piece)
    number = chosen[found]
    hit = number >= 0
    width = int(chosen.max()) + 1
    both = np.unique(texts[hit] * width + number[hit])
    return both // width, both % width


@dataclass
class Model:
    chosen: np.ndarray  # feature -> number or -1
    weights: np.ndarray  # members x features
    biases: np.ndarray

    def scores(self, piece: Slice) -> np.ndarray:
        texts, numbers = pairs(piece, self.chosen)
        logits = np.stack([np.bincount(texts, w[numbers], minlength=piece.n) + b for w, b in zip(self.weights, self.biases)])
        return (1 / (1 + np.exp(-np.clip(logits, -40, 40)))).mean(axis=0)


def risk_slopes(g: np.ndarray, is_pos: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """The slope of the risk by each text's logit ``g``, and the bracket: the estimated risk on negatives.

    While the bracket is not below zero the slope is that of the whole risk; below, it is
    that of the bracket turned round, so that a step down raises the bracket again.
    """
    p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    n_pos, n_all = max(is_pos.sum(), 1), max((~is_pos).sum(), 1)
    bracket = np.logaddexp(0, g[~is_pos]).sum() / n_all - prior * np.logaddexp(0, g[is_pos]).sum() / n_pos
    d_neg = np.where(is_pos, -prior * p / n_pos, p / n_all)
    return (prior * (p - 1) * is_pos / n_pos + d_neg if bracket >= 0 else -d_neg), float(bracket)


def fit_member(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float, seed: int,
               steps: int = 300, rate: float = 0.1, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """One classifier by full-batch Adam on a bootstrap of both samples."""
    rng = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    pos, unl = (rng.choice(x, len(x)) if len(x) else x for x in (pos, unl))
    take = np.concatenate([pos, unl])
    sizes = np.array([len(rows[i]) for i in take])
    columns = np.concatenate([rows[i] for i in take]) if sizes.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(take)), sizes)
    is_pos = np.arange(len(take)) < len(pos)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        g = np.bincount(owner, w[columns], minlength=len(take)) + b
        d, _ = risk_slopes(g, is_pos, prior)
        grad = np.append(np.bincount(columns, d[owner], minlength=width) + ridge * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def blank(share: float) -> Model:
    """A model without features: every text's score is ``share``."""
    return Model(np.full(1 << BITS, -1, np.int32), np.zeros((1, 1)), np.array([np.log(share / (1 - share))]))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, prior: float | None = None, members: int = 3,
        max_positives: int = 20_000, max_unlabelled: int = 40_000, max_candidates: int = 16_384, max_features: int = 1_024) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) where ``may_learn`` holds.

    Only confirmed examples (toxic = 1) of those rows are used of the labels.  At most ``max_positives`` confirmed texts and
    about ``max_unlabelled`` others (both by hash of the id) are the sample that the
    classifiers are trained on; features are counted over all learning rows.  ``prior``
    is by default the ratio of the rates, among all texts and among the confirmed, of the
    features that tell them apart best.

    Null and repeated ids: a confirmed id stands for all rows that have it; rows of a null
    id are never confirmed.  Without confirmed texts, or features that tell them apart, the
    model gives every text the prior.

    The confirmed texts are picked by a join before any reaches Python; one pass over all
    learning texts then counts features and takes the sample.
    """
    spark = docs.sparkSession
    small_arrow(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(may_learn & (F.col("toxic") == 1) & F.col("doc_id").isNotNull())
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positives).toArrow().column(0)
    share = min(max(prior if prior is not None else 0.01, 1e-3), 0.5)
    if not len(ids):
        return blank(share)
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(may_learn)
    confirmed = F.broadcast(spark.createDataFrame(pa.table({"doc_id": ids})))  # at most max_positives numbers

    def every_feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(0)):
                texts, found = features(piece)
                both = np.unique(texts << BITS | found)
                cut = np.searchsorted(both >> BITS, np.arange(piece.n + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(both & (1 << BITS) - 1, pa.int32()))], ["found"])

    def numbered(chosen) -> Callable:
        """The numbers that the broadcast ``chosen`` gives the features found, without those that it leaves out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(0)
                numbers = chosen.value[found.flatten().to_numpy()]
                hits = np.concatenate([[0], np.cumsum(numbers >= 0)])[np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(hits, pa.int32()), pa.array(numbers[numbers >= 0], pa.int32()))], ["found"])
        return run

    def taken(found: DataFrame, chosen) -> list[np.ndarray]:
        """The rows of a bounded sample on the driver."""
        lists = found.mapInArrow(lean(numbered(chosen)), "found array<int>").toArrow().column(0).combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        return [values[a:b] for a, b in zip(offsets, offsets[1:])]

    positives = written(learn.join(confirmed, "doc_id", "left_semi").select("text").mapInArrow(lean(every_feature), "found array<int>"), "positives")
    seen_positives = max(1, positives.count())
    rows = positives.select(F.explode("found").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    rows = rows.filter(F.col("n") >= max(3, len(ids) // 100)).orderBy(F.desc("n"), "feature").limit(max_candidates).collect()
    candidates, in_positives = np.array([r.feature for r in rows], np.int64), np.array([r.n for r in rows], float)
    if not len(candidates):
        return blank(share)
    chosen = np.full(1 << BITS, -1, np.int32)
    chosen[candidates] = np.arange(len(candidates))
    chosen_sent = spark.sparkContext.broadcast(chosen)
    total = max(1, learn.count())
    part = min(1.0, max_unlabelled / total)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 20)) < int(part * (1 << 20))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts drawn with their candidates, and at the end the task's counts of each."""
        counts = np.zeros(len(candidates), np.int64)
        for batch in batches:
            take = batch.column(1).to_numpy(zero_copy_only=False)
            for piece in slices(batch.column(0)):
                texts, numbers = pairs(piece, chosen_sent.value)
                counts += np.bincount(numbers, minlength=len(counts))
                mine = take[piece.first : piece.first + piece.n]
                if mine.any():
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, np.arange(piece.n + 1)), pa.int32()), pa.array(numbers, pa.int32()))
                    lists = lists.filter(pa.array(mine))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(lists), pa.int32()), pa.nulls(len(lists), pa.int64()), lists], ["feature", "n", "found"])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.nulls(len(some), pa.list_(pa.int32()))], ["feature", "n", "found"])

    passed = written(learn.select("text", F.coalesce(drawn, F.lit(False)).alias("drawn")).mapInArrow(lean(counted), "feature int, n long, found array<int>"), "learning-pass")
    in_all = np.zeros(len(candidates))
    for r in passed.filter("feature is not null").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most max_candidates rows
        in_all[r.feature] = r.n
    a, u = (in_positives + 0.5) / (seen_positives + 1), (in_all + 0.5) / (total + 1)
    surprise = (a - u) / np.sqrt(u * (1 - u) / (seen_positives + 1))
    best = np.argsort(-surprise, kind="stable")[:max_features]
    best = best[(surprise[best] >= 5) & (a[best] >= 2 * u[best])]
    if len(best) and prior is None:  # what only toxic texts have is as much rarer among all texts as toxic texts are
        share = float(np.clip(np.median((u / a)[best[:16]]), 1e-3, 0.5))
    best = best[share * a[best] >= 0.5 * u[best]]  # texts with it are more likely toxic than not
    if not len(best):
        return blank(share)
    chosen = np.full(1 << BITS, -1, np.int32)
    chosen[candidates[best]] = np.arange(len(best))
    again = np.full(len(candidates), -1, np.int32)
    again[best] = np.arange(len(best))
    known = taken(positives, spark.sparkContext.broadcast(chosen))
    rest = taken(passed.filter("found is not null").select("found").limit(2 * max_unlabelled), spark.sparkContext.broadcast(again))
    discard(positives, passed)
    flags = np.arange(len(known) + len(rest)) < len(known)
    fitted = [fit_member(known + rest, flags, len(best), share, seed) for seed in range(members)]
    return Model(chosen, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, the mean of the members' probabilities) of every whole text of ``docs`` (doc_id, text).

    Null or empty text: the score of a text without any feature.  Rows are independent, so
    null and repeated doc_ids each give a row.  An empty table gives no rows.  Other
    columns are not read.  The model has a fixed size (feature table of 2**22 numbers).
    """
    small_arrow(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.scores(piece) for piece in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")
