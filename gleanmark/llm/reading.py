"""Reading level of texts from a Rasch-style latent difficulty model.

Texts are the persons and words the items of the model; each step from one grade to the next is a scale of its own, with
the graded texts below the step at 0 and those above it at 1. A word of a text at level ``t`` is the word ``w`` with
probability ``exp(a_w + d_w t) / Z(t)``: ``d_w`` is the difficulty of the word, the log-odds by which it occurs more often one
step up. Levels and difficulties are estimated by distributed alternating optimisation of the joint likelihood: with the
difficulties given, the level of each text is where the mean difficulty of its words is the expected one (its likelihood is
concave); with the levels given, each word takes Newton steps on observed less expected occurrences. A round is one pass over
the partitions that adds up vectors of fixed length (words are hashed to ``BUCKETS`` places by language) and ends when the
likelihood no longer rises. Graded texts keep their level throughout, which fixes the scale.

The language of a text is that of the graded texts whose words it has; a text with hardly any of their words has no level.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.session import staged

#: Places of the words of a language.
BUCKETS = 1 << 17
#: Rounds at most, and the relative rise of the likelihood below which the fit has converged.
MOST_ROUNDS, CONVERGED = 12, 1e-4
#: Most graded texts that are used, those that come first by their hash; they are few by their nature.
MAX_SAMPLES = 20_000
#: Words that a text counts for, whatever its length, and as how many texts of the corpus a graded one counts.
TEXT_WEIGHT, SAMPLE_WEIGHT = 50.0, 10.0
#: Precision of the normal prior of a difficulty.
RIDGE = 2.0
#: Levels at which the model is tabulated.
GRID = np.linspace(-0.5, 1.5, 41)
#: Share of the words of a text that a language must know.
LEAST_KNOWN = 0.2

_WORD = re.compile(r"[^\W\d_]+")


def word_buckets(text: str | None, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of a whole text and their counts; none for null texts."""
    if not text:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    if len(cache) > 400_000:
        cache.clear()
    found = []
    for w in _WORD.findall(text.lower()):
        b = cache.get(w)
        if b is None:
            b = cache[w] = zlib.crc32(w.encode()) % BUCKETS
        found.append(b)
    ids, counts = np.unique(np.array(found, dtype=np.int32), return_counts=True)
    return ids, counts.astype(np.int32)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def _hashed(df: DataFrame, key: str) -> DataFrame:
    """``key, words, counts`` of each row's text (the second column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            pairs = [word_buckets(t.as_py(), cache) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([p[0] for p in pairs]), _lists([p[1] for p in pairs])], names=[key, "words", "counts"])

    return df.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, words array<int>, counts array<int>")


def _batch(batch: pa.RecordBatch) -> tuple[pa.ListArray, pa.ListArray]:
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return flat(batch.column("words")), flat(batch.column("counts"))


@dataclass
class Scale:
    """The fitted model: words by language, and for each step the parameters of the words and the tabulated expectation."""

    grades: np.ndarray  # ascending
    known: np.ndarray  # languages x buckets: log share of the word in graded texts of the language
    seen: np.ndarray  # languages x buckets: whether a graded text of the language has the word
    base: np.ndarray  # steps x languages x buckets, a_w; -inf for words that don't occur
    difficulty: np.ndarray  # steps x languages x buckets, d_w
    log_z: np.ndarray  # steps x languages x grid
    expected: np.ndarray  # steps x languages x grid, mean difficulty; rises with the level
    below: np.ndarray  # steps: mean level of graded texts below, estimated like any text
    above: np.ndarray

    def language(self, ids: np.ndarray, n: np.ndarray, rows: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Language of each text (-1: none) and its number of words."""
        size = np.bincount(rows, n, texts)
        if not len(self.known):
            return np.full(texts, -1), size
        score = np.stack([np.bincount(rows, n * k[ids], texts) for k in self.known])
        share = np.stack([np.bincount(rows, n * s[ids], texts) for s in self.seen]) / np.maximum(size, 1)
        best = score.argmax(axis=0)
        return np.where(share[best, np.arange(texts)] >= LEAST_KNOWN, best, -1), size

    def abilities(self, step: int, ids: np.ndarray, n: np.ndarray, rows: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The level of each text at a step that makes its words most likely; 0 for texts without a language."""
        own = np.maximum(lang, 0)
        mean = np.bincount(rows, n * self.difficulty[step][own[rows], ids], len(lang)) / np.maximum(size, 1)
        level = np.zeros(len(lang))
        for k in range(len(self.known)):
            mine = lang == k
            level[mine] = np.interp(mean[mine], self.expected[step, k], GRID)
        return level

    def levels(self, words: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level of each text on the scale of the grades, its number of words, and whether it has a language.

        A text above a step is above those before it.
        """
        ids, n, rows = _flat(words, counts)
        lang, size = self.language(ids, n, rows, len(words))
        level, passed = np.full(len(words), float(self.grades[0])), np.zeros(len(words))
        for k in range(len(self.grades) - 2, -1, -1):
            ability = self.abilities(k, ids, n, rows, lang, size)
            passed = np.maximum(passed, np.clip((ability - self.below[k]) / max(self.above[k] - self.below[k], 1e-6), 0, 1))
            level = level + passed * (self.grades[k + 1] - self.grades[k])
        return level, size, lang >= 0


def _flat(words: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = pa.compute.list_value_length(words).fill_null(0).to_numpy()
    return words.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64), np.repeat(np.arange(len(words)), lengths)


def newton(count: np.ndarray, level_sum: np.ndarray, mass: np.ndarray, base: np.ndarray, difficulty: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """New ``a_w`` and ``d_w`` of the words of one language: Newton steps on observed less expected occurrences.

    ``count`` and ``level_sum`` are the weights of each word, and the same times the level of its texts; ``mass`` is the weight of
    all words by level of the grid.
    """
    used = np.flatnonzero(count > 0)
    a, d, n, t = np.where(np.isfinite(base[used]), base[used], np.log(count[used])), difficulty[used].copy(), count[used], level_sum[used]
    at = np.flatnonzero(mass)
    grid, weight = GRID[at], mass[at]
    for _ in range(rounds):
        p = np.exp(a[:, None] + d[:, None] * grid[None, :])
        p *= (weight / p.sum(axis=0))[None, :]
        e0, e1, e2 = p.sum(axis=1), p @ grid, p @ grid**2
        g0, g1 = n - e0, t - e1 - RIDGE * d
        h00, h01, h11 = e0 + 1e-9, e1, e2 + RIDGE
        det = np.maximum(h00 * h11 - h01**2, 1e-9)
        a += np.clip((h11 * g0 - h01 * g1) / det, -1.5, 1.5)
        d += np.clip((h00 * g1 - h01 * g0) / det, -1.5, 1.5)
    new_a, new_d = np.full(len(base), -np.inf), np.zeros(len(base))
    # Only differences of difficulty count; the mean of the words is put at 0.
    centre = (n * d).sum() / n.sum() if len(n) else 0.0
    new_a[used], new_d[used] = a, d - centre
    return new_a, new_d


def tabulated(base: np.ndarray, difficulty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``log Z`` and the expected difficulty at each level of the grid."""
    used = np.flatnonzero(np.isfinite(base))
    if not len(used):
        return np.zeros(len(GRID)), np.arange(len(GRID)) * 1e-9
    x = base[used][:, None] + difficulty[used][:, None] * GRID[None, :]
    top = x.max(axis=0)
    p = np.exp(x - top)
    z = p.sum(axis=0)
    mean = (difficulty[used] @ p) / z
    return np.log(z) + top, np.maximum.accumulate(mean) + np.arange(len(GRID)) * 1e-9


def fit(hashed: DataFrame, samples: pd.DataFrame, rounds: int = MOST_ROUNDS) -> Scale:
    """The scale, fitted to the graded texts of ``samples`` (``grade, lang, words, counts``) and all texts of ``hashed`` by turns."""
    ids, n, rows = _flat(pa.array(samples["words"].tolist(), pa.list_(pa.int32())), pa.array(samples["counts"].tolist(), pa.list_(pa.int32())))
    names, lang = np.unique(samples["lang"].fillna("").to_numpy(), return_inverse=True)
    grades, languages = np.unique(samples["grade"].to_numpy()), len(names)
    steps, grade = len(grades) - 1, samples["grade"].to_numpy()
    size = np.bincount(rows, n, len(samples))
    counted = np.zeros((languages, BUCKETS))
    np.add.at(counted, (lang[rows], ids), n)
    known = np.log((counted + 0.1) / (counted.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
    weight = n * (SAMPLE_WEIGHT * TEXT_WEIGHT / np.maximum(size, 1))[rows]
    # What the graded texts contribute to each round is fixed with their levels.
    anchor, anchor_level, anchor_mass = np.zeros((languages, BUCKETS)), np.zeros((steps, languages, BUCKETS)), np.zeros((steps, languages, len(GRID)))
    np.add.at(anchor, (lang[rows], ids), weight)
    zero, one = (int(np.flatnonzero(np.isclose(GRID, v))[0]) for v in (0, 1))
    for s in range(steps):
        up = grade > grades[s]
        np.add.at(anchor_level[s], (lang[rows], ids), weight * up[rows])
        np.add.at(anchor_mass[s], (lang, np.where(up, one, zero)), SAMPLE_WEIGHT * TEXT_WEIGHT * (size > 0))
    blank = np.zeros((steps, languages, BUCKETS))
    scale = Scale(grades.astype(float), known.astype(np.float32), counted > 0, np.full_like(blank, -np.inf), blank, np.zeros((steps, languages, len(GRID))), np.zeros((steps, languages, len(GRID))), np.zeros(steps), np.ones(steps))

    def maximised(count: np.ndarray, level_sum: np.ndarray, mass: np.ndarray, inner: int = 4) -> None:
        base, difficulty = scale.base.copy(), scale.difficulty.copy()
        for s in range(steps):
            for k in range(languages):
                base[s, k], difficulty[s, k] = newton(count[k], level_sum[s, k], mass[s, k], base[s, k], difficulty[s, k], inner)
                scale.log_z[s, k], scale.expected[s, k] = tabulated(base[s, k], difficulty[s, k])
        scale.base, scale.difficulty = base.astype(np.float32), difficulty.astype(np.float32)

    maximised(anchor, anchor_level, anchor_mass, 12)
    likelihood, sc = None, hashed.sparkSession.sparkContext
    for _ in range(rounds if steps else 0):
        shared = sc.broadcast(scale)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            count, level_sum, mass, total = np.zeros(languages * BUCKETS), np.zeros((steps, languages * BUCKETS)), np.zeros((steps, languages * len(GRID))), np.zeros(steps)
            for batch in batches:
                ids, n, rows = _flat(*_batch(batch))
                lang, size = model.language(ids, n, rows, batch.num_rows)
                keep = lang[rows] >= 0
                ids, n, rows = ids[keep], n[keep], rows[keep]
                n = n * (TEXT_WEIGHT / np.maximum(size, 1))[rows]
                at = lang[rows] * BUCKETS + ids
                count += np.bincount(at, n, len(count))
                of = lang >= 0
                for s in range(steps):
                    level = model.abilities(s, ids, n, rows, lang, np.full(len(lang), TEXT_WEIGHT))
                    spot = np.clip(np.rint((level - GRID[0]) / (GRID[1] - GRID[0])), 0, len(GRID) - 1).astype(np.int64)
                    level_sum[s] += np.bincount(at, n * GRID[spot][rows], len(count))
                    mass[s] += np.bincount(lang[of] * len(GRID) + spot[of], np.full(of.sum(), TEXT_WEIGHT), languages * len(GRID))
                    a = model.base[s].ravel()[at]
                    told = np.isfinite(a)
                    total[s] += (n[told] * (a[told] + model.difficulty[s].ravel()[at[told]] * GRID[spot][rows[told]])).sum() - TEXT_WEIGHT * model.log_z[s][lang[of], spot[of]].sum()
            used = np.flatnonzero(count)
            # Rows of words, then those of levels (below 0) and of the likelihood.
            places = np.concatenate([used, -1 - np.arange(languages * len(GRID)), [-1 - languages * len(GRID)]])
            values = [np.concatenate([level_sum[s][used], mass[s], [total[s]]]) for s in range(steps)]
            first = np.concatenate([count[used], np.zeros(languages * len(GRID) + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(first), *[pa.array(v) for v in values]], names=["place", "count", *[f"step{s}" for s in range(steps)]])

        columns = ["count", *[f"step{s}" for s in range(steps)]]
        found = hashed.select("words", "counts").mapInArrow(sums, "place long, " + ", ".join(f"{c} double" for c in columns)).groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        shared.unpersist()
        words, levels = found[found["place"] >= 0], found[(found["place"] < 0) & (found["place"] >= -languages * len(GRID))]
        count, level_sum, mass = anchor.copy(), anchor_level.copy(), anchor_mass.copy()
        count.ravel()[words["place"]] += words["count"]
        for s in range(steps):
            level_sum[s].ravel()[words["place"]] += words[f"step{s}"]
            mass[s].ravel()[-1 - levels["place"]] += levels[f"step{s}"]
        last, likelihood = likelihood, float(found.loc[found["place"] == -1 - languages * len(GRID), columns[1:]].to_numpy().sum())
        if last is not None and likelihood - last <= CONVERGED * abs(last):
            break
        maximised(count, level_sum, mass)
    for s in range(steps):
        free = scale.abilities(s, ids, n, rows, lang, size)
        up = grade > grades[s]
        scale.below[s], scale.above[s] = free[~up].mean(), free[up].mean()
    return scale


def reading_levels(documents: DataFrame, samples: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``doc_id, level, n_words``: the reading level of each text on the scale of ``samples`` (``text``, ``grade``, ``lang``).

    ``level`` is null for null, empty and blank texts, texts without a word and texts in none of the languages of the
    samples. Each input row gives one row; repeated rows and extra columns do no harm. Samples without ``lang`` are taken for
    one language; those with a null text or grade are left out; without any all levels are null, and with one grade all
    texts have that.
    """
    kind = dict(documents.dtypes)["doc_id"]
    lang = F.col("lang").cast("string") if "lang" in samples.columns else F.lit(None).cast("string")
    graded = samples.where("text is not null and grade is not null").select(F.struct("grade", lang.alias("lang")).alias("key"), "text").orderBy(F.xxhash64("text"), "text", "key").limit(MAX_SAMPLES)
    anchors = _hashed(graded, "key").select("key.grade", "key.lang", "words", "counts").toPandas()
    anchors = anchors[anchors["words"].map(len) > 0].reset_index(drop=True)
    if anchors.empty:
        return documents.select("doc_id", F.lit(None).cast("double").alias("level"), F.lit(0).alias("n_words"))
    hashed = staged(_hashed(documents.select("doc_id", "text"), "doc_id"), "words")
    scale = fit(hashed, anchors, rounds)
    # What the fit alone needs stays behind.
    scale.base, scale.log_z = np.zeros(0), np.zeros(0)
    shared = documents.sparkSession.sparkContext.broadcast(scale)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, size, spoken = shared.value.levels(*_batch(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(level, mask=(size == 0) | ~spoken), pa.array(size.astype(np.int32))], names=["doc_id", "level", "n_words"])

    return hashed.mapInArrow(levels, f"doc_id {kind}, level double, n_words int")


def demanding(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose text as a whole reads like the samples of the highest grade."""
    grades = samples.where("grade is not null").select("grade").distinct().orderBy(F.desc("grade")).limit(2).collect()
    cut = sum(r.grade for r in grades) / max(1, len(grades))
    return reading_levels(documents, samples).where(F.col("level") > cut).select("doc_id").distinct()
