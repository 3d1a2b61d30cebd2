"""Quality classifier from compressed sizes.

Two Zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut
into blocks, so that the dictionaries count throughout a long text, and each block is compressed
with both. The difference of the summed sizes over their sum is its lean; an isotonic fit on
labelled rows that trained no dictionary makes it a chance of being good.

Learning takes bounded samples: of each label the `per_label` rows whose ids hash lowest, once for
the dictionaries (`blocks_per_text` blocks of each text, evenly spread) and once for the fit (whole
texts, of which only the leans leave the executors).

Defined results
    null or empty text         one empty block; its lean is that of the sizes of empty frames
    null quality, null id      not learned from
    labels of one kind, none   every score is the share of good labels, 0.5 without labels
    too few or too short
    texts for training         the blocks themselves serve as raw dictionary
    repeated labels            count once; conflicting ones count each
    empty table                no rows
    other columns              not read
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from windspan.llm.sampling import lowest

BLOCK = 512
LEVEL = 3
DICTIONARY_BYTES = 64 << 10


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


@dataclass
class QualityModel:
    """Dictionaries of bad and good text, and the corners of the isotonic fit."""

    bad: tuple[bytes, bool] | None  # content, and whether it is a trained dictionary
    good: tuple[bytes, bool] | None
    leans: np.ndarray
    chances: np.ndarray

    def packers(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content, trained in (self.bad, self.good):
            kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
            held = zstandard.ZstdCompressionDict(content, dict_type=kind)
            held.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False
                )
            )
        return made

    def score(self, leans: np.ndarray) -> np.ndarray:
        return np.interp(leans, self.leans, self.chances)


def lean(text: bytes | None, packers: list[zstandard.ZstdCompressor]) -> float:
    """How much smaller `text` gets with the good dictionary than with the bad one, -1 to 1."""
    bad, good = (sum(len(p.compress(b)) for b in blocks(text or b"")) for p in packers)
    return (bad - good) / (bad + good)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the rising fit of y (0 or 1), weighted by w, to x: pooled neighbours, each
    pool's share drawn towards the whole's by a row of mean weight."""
    pools: list[list[float]] = []  # weight, weighted y, weighted x
    for i in np.argsort(x, kind="stable"):
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    share, one = np.average(y, weights=w), w.mean()
    chances = np.array([(k + share * one) / (n + one) for n, k, _ in pools])
    return np.array([s / n for n, _, s in pools]), np.maximum.accumulate(chances)


def _dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b" ", False


def _leans(texts: Column, model: QualityModel) -> Column:
    @F.pandas_udf("double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packers = model.packers()
        for batch in batches:
            yield pd.Series([lean(t, packers) for t in batch], dtype="float64")

    return measured(texts.cast("binary"))


def _sampled(docs: DataFrame, labels: DataFrame, id: str, text: str, per_label: int) -> DataFrame:
    """(quality, text) of the `per_label` labelled ids of each label whose hashes are lowest."""
    hashed = labels.select("id", "quality", F.xxhash64("id").alias("h"))
    picked = lowest(hashed.select("quality", "h").distinct(), "quality", "h", per_label)
    picked = hashed.join(F.broadcast(picked), ["quality", "h"]).select("id", "quality").distinct()
    # at most 2 * per_label rows
    return docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text")).join(
        F.broadcast(picked), "id"
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    for_fit: Column,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_label: int = 2000,
    blocks_per_text: int = 8,
) -> QualityModel:
    """Learn from `labels` (id, label): rows with `for_fit` fit the score, others train."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(
        F.col(id).alias("id"), F.col(label).cast("int").alias("quality"), for_fit.alias("fit")
    )

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for quality, body in zip(batch["quality"], batch["text"]):
                cut = blocks(body or b"")
                step = max(1, -(-len(cut) // blocks_per_text))
                rows += [(quality, block) for block in cut[::step]]
            yield pd.DataFrame(rows, columns=["quality", "block"])

    train = _sampled(docs, known.filter(~F.col("fit")), id, text, per_label)
    cut: dict[int, list[bytes]] = {0: [], 1: []}
    for row in train.mapInPandas(spread, "quality int, block binary").collect():
        cut[row["quality"]].append(bytes(row["block"]))
    for samples in cut.values():
        samples.sort()  # in whatever order tasks end
    share = known.agg(F.avg("quality")).first()[0]
    flat = QualityModel(None, None, np.zeros(1), np.array([0.5 if share is None else share]))
    if not cut[0] or not cut[1]:
        return flat
    model = QualityModel(_dictionary(cut[0]), _dictionary(cut[1]), flat.leans, flat.chances)
    fit = _sampled(docs, known.filter("fit"), id, text, per_label)
    found = fit.select("quality", _leans(F.col("text"), model).alias("lean")).toPandas()
    if found["quality"].nunique() > 1:
        found = found.sort_values(["lean", "quality"])
        # The sample may hold a smaller part of one label than of the other.
        shares = found["quality"].map({1: share, 0: 1 - share}).to_numpy(float)
        weights = shares / found.groupby("quality")["lean"].transform("size").to_numpy(float)
        model.leans, model.chances = isotonic(
            found["lean"].to_numpy(), found["quality"].to_numpy(float), weights
        )
    return model


def fold(id: Column) -> Column:
    """0 to 4, by the CRC-32 of the id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """Score, 0 to 1, for the texts of `docs`."""
    if model.bad is None:
        return F.lit(float(model.chances[0]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        packers = known.packers()
        for batch in batches:
            yield pd.Series(known.score(np.array([lean(t, packers) for t in batch], float)))

    return scored(F.col(text).cast("binary"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    cut: float = 0.3,
    **options,
) -> DataFrame:
    """(id, held_out, score, predicted) for each row of `docs`, learned from labels of rows that
    are not held out: folds 2 to 4 train the dictionaries, fold 1 fits the score."""
    part = fold(F.col(id))
    model = learn(docs, labels.filter(part != 0), part == 1, id, text, label, **options)
    return docs.select(
        F.col(id), (part == 0).alias("held_out"), score(docs, model, text).alias("score")
    ).withColumn("predicted", (F.col("score") >= cut).cast("int"))
