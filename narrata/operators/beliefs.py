"""What a text leads one to expect, part by part: shifts, twists, and what prepares them.

Each part of a text is a distribution over the text's words, smoothed. The
divergence of each part from the one before is the shift of belief there; a
twist is a shift far above the text's own mean, and it is foreshadowed if the
entropy of the parts shortly before it falls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a table of counts that are worked on at once.
CELLS = 1 << 22


def _told(ids: np.ndarray, vocabulary: int, parts: int, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Divergence in bits of each part from the one before (nan for the first), and entropy in bits of each; blocks of words bound the memory."""
    each = len(ids) // parts
    part = np.minimum(np.arange(len(ids)) // each, parts - 1) if each else np.full(len(ids), parts - 1)
    totals = np.bincount(part, minlength=parts) + smoothing * vocabulary
    kl, entropy = np.zeros(parts), np.zeros(parts)
    width = max(1, CELLS // parts)
    order = np.argsort(ids, kind="stable")
    ids, part = ids[order], part[order]
    for low in range(0, vocabulary, width):
        size = min(width, vocabulary - low)
        a, b = np.searchsorted(ids, [low, low + size])
        p = (np.bincount(part[a:b] * size + ids[a:b] - low, minlength=parts * size).reshape(parts, size) + smoothing) / totals[:, None]
        logs = np.log2(p)
        entropy -= (p * logs).sum(1)
        kl[1:] += (p[1:] * (logs[1:] - logs[:-1])).sum(1)
    kl[0] = np.nan
    return kl, entropy


def beliefs(docs: DataFrame, tokens: Column, parts: int = 20, smoothing: float = 0.1, id: str = "doc_id") -> DataFrame:
    """(id, state, position, kl, entropy) of each part of each text with words, over all words of the text.

    Parts have size // parts words, the last one the rest; ``kl`` is null for the first.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in enumerate(batch.column("tokens")):
                if not words.is_valid or not len(words.values):
                    continue
                named = words.values.dictionary_encode()
                kl, entropy = _told(named.indices.to_numpy(), len(named.dictionary), parts, smoothing)
                states = np.arange(parts, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id).take(pa.array(np.full(parts, i))), pa.array(states), pa.array(states / max(parts - 1, 1)), pa.array(kl, from_pandas=True), pa.array(entropy)], names=[id, "state", "position", "kl", "entropy"]
                )

    return docs.select(id, tokens.alias("tokens")).mapInArrow(run, f"{id} {kind}, state int, position double, kl double, entropy double")


def twists(found: DataFrame, parts: int = 20, sigmas: float = 2.0, id: str = "doc_id", digits: int = 9) -> DataFrame:
    """(id, state, position, kl, z, foreshadowing) of parts whose divergence is ``sigmas`` deviations above the text's mean.

    Foreshadowing is ten times the fall of entropy from part to part, at most 1, over the parts of the last fifth of the
    text before the twist; 0 for fewer than two of them. Texts with fewer than three divergences have no twists.
    """
    of_doc = Window.partitionBy(id)
    # The parts at positions from 0.2 before the twist up to it, but for itself.
    before = of_doc.orderBy("state").rowsBetween(-((parts - 1) // 5), -1)
    kl = F.round("kl", digits)
    told = found.withColumns({
        "_mean": F.round(F.avg("kl").over(of_doc), digits), "_std": F.round(F.stddev_pop("kl").over(of_doc), digits), "_n": F.count("kl").over(of_doc),
        "_slope": F.when(F.count("entropy").over(before) > 1, F.regr_slope(F.col("entropy"), F.col("state").cast("double")).over(before)),
    })
    high = (F.col("_n") >= 3) & (kl > F.col("_mean") + sigmas * F.col("_std"))
    z = F.when(F.col("_std") > 0, (kl - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    score = F.when(F.col("_slope").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -10 * F.col("_slope"))))
    return told.where(high).select(id, "state", "position", "kl", z.alias("z"), score.alias("foreshadowing"))
