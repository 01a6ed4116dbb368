"""Quality by a generalised additive model with pairwise interactions.

The score is the logistic of a sum of lookup tables: one per feature of a text, and one per
chosen pair of features.  The tables are learned by cyclic boosting: in turn each feature
gets a shallow tree fitted to the current residuals and added at a small rate, so that a
tree's leaves are just additions to the bins of its feature's table.  Then the pairs whose
quadrants would explain most of the residuals are boosted in the same way.  Scoring puts
features into bins and adds table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import lean, small_arrow, written
from graphloom.llm.textscan import LOWER, SPACE, Slice, slices

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "stops", "marks", "other_bytes", "spaces",
    "distinct_words", "repeated_words", "distinct_triples", "top_word", "bare_words", "marked_words",
    "capital_words", "log_line_words", "repeated_lines",
)
_EACH = np.arange(256)
UPPER = (_EACH >= 65) & (_EACH <= 90)
ALPHA = UPPER | ((_EACH >= 97) & (_EACH <= 122)) | (_EACH >= 128)
DIGIT = (_EACH >= 48) & (_EACH <= 57)
STOP = np.isin(_EACH, [ord(c) for c in ".,;:'\"-()"])
MARK = ~(ALPHA | DIGIT | STOP | SPACE) & (_EACH > 32)


def text_features(piece: Slice) -> np.ndarray:
    """A row of :data:`FEATURES` for each text of the slice."""
    n, data, offsets = piece.n, piece.data, piece.offsets
    size = np.diff(offsets)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[offsets])

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    kinds = [per_text(k[data]) for k in (UPPER, ALPHA, DIGIT, STOP, MARK, _EACH >= 128, SPACE)]
    upper, alpha, digit, stop, mark, other, space = kinds
    starts, ends, text = piece.words(~SPACE)
    words = np.bincount(text, minlength=n)
    hashes = piece.hashes(LOWER).of(starts, ends)
    count = lambda of, weights=None: np.bincount(of, weights, minlength=n)

    def distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of distinct keys, and of the most frequent, by text."""
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(key)))
        top = np.zeros(n, np.int64)
        np.maximum.at(top, owner[at], runs)
        return count(owner[at]), top

    different, top = distinct(text, hashes)
    same = (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1])
    repeated = count(text[1:][same])
    whole = text[2:] == text[:-2] if len(text) > 2 else np.zeros(0, bool)
    triple = (hashes[:-2] * np.uint64(3) ^ hashes[1:-1] * np.uint64(5) ^ hashes[2:] * np.uint64(7))[whole] if len(text) > 2 else np.zeros(0, np.uint64)
    triples = count(text[:-2][whole]) if len(text) > 2 else np.zeros(n)
    distinct_triples = distinct(text[:-2][whole], triple)[0] if len(text) > 2 else np.zeros(n)
    letters = np.concatenate([[0], np.cumsum(ALPHA[data])])
    marks = np.concatenate([[0], np.cumsum(MARK[data])])
    capitals = np.concatenate([[0], np.cumsum(UPPER[data])])
    bare = count(text[letters[ends] == letters[starts]])
    marked = count(text[(marks[ends] > marks[starts]) & (letters[ends] > letters[starts])])
    shouted = count(text[(capitals[ends] - capitals[starts] >= 2)])
    line_starts, line_ends, line_text = piece.words(_EACH != 10)
    lines = count(line_text)
    different_lines = distinct(line_text, piece.hashes().of(line_starts, line_ends))[0]
    return np.column_stack([
        np.log1p(size), np.log1p(words), share(size - space, words), share(upper, alpha), share(digit, size), share(stop, size),
        share(mark, size), share(other, size), share(space, size), share(different, words), share(repeated, words),
        share(distinct_triples, triples), share(top, words), share(bare, words), share(marked, words), share(shouted, words),
        np.log1p(share(words, lines)), 1 - share(different_lines, lines),
    ]).astype(np.float64)


@dataclass
class AdditiveModel:
    """Tables of additions to the logit; ``edges`` are the bins' borders, ``coarse`` maps bins to those of pairs."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, np.ascontiguousarray(x[:, j]), "right") for j, e in enumerate(self.edges)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float, ridge: float = 1.0) -> np.ndarray:
    """A tree over ordered bins: at most ``leaves`` ranges, each with its Newton step."""
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            cuts = np.arange(a + 1, b)
            cuts = cuts[(h[cuts] - h[a] >= least) & (h[b] - h[cuts] >= least)]
            if len(cuts):
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                best = max(best, (float(gain.max()), k, int(cuts[gain.argmax()])))
        if not best[2]:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    step = np.zeros(len(grad))
    for a, b in parts:
        step[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of both axes of a pair's grid: its gain, and the quadrants' Newton steps."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    total_g, total_h = g[-1, -1], h[-1, -1]
    a, b = slice(None, -1), slice(None, -1)
    corner_g, corner_h = g[a, b], h[a, b]
    up_g, up_h = g[a, -1:] - corner_g, h[a, -1:] - corner_h
    left_g, left_h = g[-1:, b] - corner_g, h[-1:, b] - corner_h
    rest_g, rest_h = total_g - corner_g - up_g - left_g, total_h - corner_h - up_h - left_h
    gain = sum(x**2 / (np.maximum(y, 0) + ridge) for x, y in ((corner_g, corner_h), (up_g, up_h), (left_g, left_h), (rest_g, rest_h)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(grad)
    for rows, columns, x, y in ((slice(0, i + 1), slice(0, j + 1), corner_g, corner_h), (slice(0, i + 1), slice(j + 1, None), up_g, up_h),
                                (slice(i + 1, None), slice(0, j + 1), left_g, left_h), (slice(i + 1, None), slice(j + 1, None), rest_g, rest_h)):
        step[rows, columns] = -x[i, j] / (max(y[i, j], 0) + ridge)
    return float(gain.max()), step


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 64, pair_bins: int = 12, rounds: int = 120, pair_rounds: int = 60,
               n_pairs: int = 8, leaves: int = 4, rate: float = 0.1, least: float = 4.0) -> AdditiveModel:
    """Boost the tables on rows ``x`` with classes ``y`` (0 or 1)."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(x.shape[1])]
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    logit = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return p - y, p * (1 - p) + 1e-6

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), leaves, least)
            table += step
            logit += step[b[:, j]]
    model.coarse = [np.arange(len(t)) * pair_bins // max(len(t), pair_bins) for t in model.tables]
    c = np.column_stack([m[b[:, j]] for j, m in enumerate(model.coarse)])

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = c[:, i] * pair_bins + c[:, j]
        return tuple(np.bincount(cell, v, pair_bins**2).reshape(pair_bins, pair_bins) for v in (g, h))

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quadrants(*grids(*p, g, h))[0])
    model.pairs = ranked[:n_pairs]
    model.pair_tables = [np.zeros((pair_bins, pair_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _quadrants(*grids(i, j, g, h))[1]
            table += step
            logit += step[c[:, i], c[:, j]]
    return model


def featurise(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and features (array of double) of every whole text of ``docs``, and the columns ``keep``; null text as empty."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(f"`{k}`") for k in keep if k != "text"])
    places = [picked.columns.index(k) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(piece) for piece in slices(batch.column(1))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            cut = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(x.ravel())), *(batch.column(i) for i in places)], ["doc_id", "features", *keep])

    fields = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType())), *(picked.schema[k] for k in keep)])
    return picked.mapInArrow(lean(run), fields)


def fit(features: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = 40_000) -> AdditiveModel:
    """Learn from labelled rows where ``may_learn`` holds: at most ``max_rows``, by hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(may_learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "quality").limit(max_rows)
    rows = features.select("doc_id", "features").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("features")).limit(max_rows).toArrow()
    x = rows.column("features").combine_chunks().values.to_numpy().reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit_tables(x, rows.column("quality").to_numpy().astype(float))


def score_features(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """``features`` with a score in place of the features; only these leave the JVM."""
    sent = features.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(x.flatten().to_numpy().reshape(-1, len(FEATURES))))

    return features.select("doc_id", score("features").alias("score"), *[c for c in features.columns if c not in ("doc_id", "features")])


def score_documents(docs: DataFrame, labels: DataFrame, may_learn: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text of ``docs`` (doc_id, text), with its columns ``keep`` (the text may be one).

    The texts are read once: their features are written, the model is fitted to those of
    labelled rows, then all are scored.  Null text counts as empty and is scored too; null
    and repeated doc_ids each give a row; without both classes among the learning rows all
    scores are the share of good ones.  An empty table gives no rows.  Other columns are
    not read.
    """
    small_arrow(docs.sparkSession)
    features = written(featurise(docs, keep), "quality")
    return score_features(features, fit(features, labels, may_learn))
