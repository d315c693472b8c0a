"""Documents to overlapping windows, one array per document; no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import series as S
from narrata.functions import text as X


@S.bound
def word_windows(words: Column, size: int = 1000, overlap: int = 500) -> Column:
    """Runs of ``size`` words every ``size - overlap``; runs under half of it are left out; without any, all words are one."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
    # By places, not by slice(), which walks up to its start each time.
    run = lambda i: F.transform(F.sequence(i, F.least(i + size, F.size(words)) - 1), lambda k: F.get(words, k))
    starts = F.filter(starts, lambda i: F.size(words) - i >= size // 2)
    runs = F.when(F.size(words) > 0, F.transform(starts, run)).otherwise(F.array().cast("array<array<string>>"))
    return S.let(runs, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(words)))


def char_windows(text: Column, size: int = 500, overlap: int = 250, strip: bool = True) -> Column:
    """The same on characters, white space removed first if ``strip``."""
    def runs(body: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(size - overlap))
        return F.filter(F.transform(starts, lambda i: F.substring(body, i + 1, size)), lambda w: F.length(w) >= size // 2)

    return S.lets(lambda body, found: F.when(F.size(found) > 0, found).otherwise(F.array(body)), lambda: F.regexp_replace(text, "\\s+", "") if strip else text, runs)


@S.bound
def segments(words: Column, n: int) -> Column:
    """n parts of size // n words; the last one takes the rest."""
    each = (F.size(words) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(words, i * each + 1, F.when(i == n - 1, F.size(words)).otherwise(each)))


def windowed(docs: DataFrame, size: int = 1000, overlap: int = 500, text: str = "text") -> DataFrame:
    """Add ``windows``: arrays of words."""
    return docs.withColumn("_words", X.words(F.col(text))).withColumn("windows", word_windows(F.col("_words"), size, overlap)).drop("_words")


def series(docs: DataFrame, functors: dict[str, Callable[[Column], Column]], windows: str = "windows") -> DataFrame:
    """One array column per functor: its score of each window in turn."""
    return docs.withColumns({name: F.transform(F.col(windows), f) for name, f in functors.items()})


def long_form(df: DataFrame, functors: list[str], id: str = "doc_id") -> DataFrame:
    """(id, functor, win_idx, t, value) from array columns."""
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("functor"), F.col(f).alias("values")) for f in functors)))
    each = df.select(id, both.alias("s")).select(id, "s.functor", F.size("s.values").alias("n"), F.posexplode("s.values").alias("win_idx", "value"))
    t = F.when(F.col("n") > 1, F.col("win_idx") / (F.col("n") - 1)).otherwise(0.0)
    return each.select(id, "functor", "win_idx", t.alias("t"), "value")
