"""Corpora: samples, statistics, term weights, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import text as X
from narrata.workspace import Workspace


def draw(key: Column, seed: int = 42) -> Column:
    """A number for each key that orders them at random, in every engine alike."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the first ones by draw."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if there are fewer), from each stratum in proportion, one at least; a null stratum is one too.

    Quotas are rounded down. If they are too few, the rows that come next by
    draw in all are added; if they are too many (more strata than n), rows
    beyond their stratum's first go first, the last ones by draw.
    """
    named = df.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    sizes = named.groupBy("_s").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    # The total is one row.
    quota = sizes.crossJoin(total).select("_s", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_n") / F.col("_all"))).alias("_quota"))
    drawn = named.withColumn("_draw", draw(F.col(key), seed))
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_draw", key))).where(F.col("_r") <= n)
    placed = ranked.join(quota, "_s").withColumn("_turn", F.when(F.col("_r") == 1, 0).when(F.col("_r") <= F.col("_quota"), 1).otherwise(2))
    return placed.orderBy("_turn", "_draw", key).limit(n).select(*(F.col(f"`{c}`") for c in df.columns))


def popular_sample(df: DataFrame, key: str, score: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of those whose score is the median or more."""
    cut = df.agg(F.percentile(score, F.lit(0.5)).alias("_cut"))
    return uniform_sample(df.crossJoin(cut).where(F.col(score) >= F.col("_cut")).drop("_cut"), key, n, seed)


def statistics(df: DataFrame, words: Column, by: list[str]) -> DataFrame:
    """Counts and word statistics in all, and by each of ``by``, in one pass over grouping sets."""
    rows = df.select(*by, words.alias("_w"))
    sets = [[F.col(c) for c in s] for s in ([], *([b] for b in by))]
    return rows.groupingSets(sets, *by).agg(F.count("*").alias("n"), F.sum("_w").alias("words"), F.round(F.avg("_w"), 4).alias("avg_words"), F.min("_w").alias("min_words"), F.max("_w").alias("max_words"), F.grouping_id(*by).alias("level"))


def content_id(text: Column) -> Column:
    """Twelve hex digits of the MD5 of the first thousand characters."""
    return F.left(F.md5(F.left(text, F.lit(1000))), F.lit(12))


def new_only(df: DataFrame, known: DataFrame, id: str) -> DataFrame:
    """Rows with an id that isn't known, one for each id (the smallest row)."""
    fresh = df.join(known.select(id).distinct(), id, "left_anti")
    others = [c for c in df.columns if c != id]
    return fresh.groupBy(id).agg(F.min(F.struct(*others)).alias("row")).select(id, "row.*").select(*df.columns)


def neighbours(ws: Workspace, df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, order, value, other, u): each row with the order and value of the next row of its group, where there is one.

    Rows are dealt by ranges of (group, order), so a group of any size is
    spread over many tasks; the last row that a group has in a range is
    followed by the group's first row in a later one.
    """
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ws.save(df.select(group, order, value), "values")
    dealt = ws.save(rows.repartitionByRange(n, group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", group).orderBy(order, value)
    after = dealt.withColumns({"_place": F.row_number().over(inside), "_next": F.lead(F.struct(order, value)).over(inside)})
    # At most one row for each range and one more for each group that starts in it.
    heads = after.where("_place = 1").select("_range", F.col(group).alias("_group"), F.struct(order, value).alias("_head"))
    later = heads.select(F.col("_range").alias("_r"), "_group", F.lead("_head").over(Window.partitionBy("_group").orderBy("_range")).alias("_later"))
    later = ws.save(later, "heads")
    met = after.join(later, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_next", F.coalesce("_next", "_later"))
    return met.where("_next is not null").select(group, order, value, F.col("_next").getField(order).alias("other"), F.col("_next").getField(value).alias("u"))


def term_weights(windows: DataFrame, id: str = "doc_id", vocabulary: int | None = None) -> DataFrame:
    """(id, win_idx, term, w): tf-idf of each document's windows, of length one.

    ``windows`` has (id, win_idx, n_windows, terms). idf is
    ln((n + 1) / (df + 1)) + 1. With ``vocabulary``, only a document's most
    frequent terms count, the first in order of equal ones. If the windows are
    dealt by ``id``, no step here or in what follows shuffles.
    """
    tf = windows.select(id, "win_idx", "n_windows", F.explode("terms").alias("term")).groupBy(id, "win_idx", "n_windows", "term").agg(F.count("*").alias("tf"))
    of_term = Window.partitionBy(id, "term")
    counted = tf.withColumn("df", F.count("*").over(of_term))
    if vocabulary:
        terms = tf.groupBy(id, "term").agg(F.sum("tf").alias("_all")).withColumn("_r", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("_all"), "term"))).where(F.col("_r") <= vocabulary)
        counted = counted.join(terms.select(id, "term"), [id, "term"], "left_semi")
    raw = counted.withColumn("w", F.col("tf") * (F.log((F.col("n_windows") + 1) / (F.col("df") + 1)) + 1))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id, "win_idx")))
    return raw.select(id, "win_idx", "term", (F.col("w") / size).alias("w"))


def drift(weights: DataFrame, windows: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, win_idx, value): one minus the cosine with the window before; half for the first.

    Each weight goes to its own window and to the next one, so no window is
    joined with another.
    """
    sides = F.explode(F.array(F.struct(F.col("win_idx").alias("at"), F.col("w").alias("p"), F.lit(0.0).alias("q")), F.struct((F.col("win_idx") + 1).alias("at"), F.lit(0.0).alias("p"), F.col("w").alias("q"))))
    met = weights.select(id, "term", sides.alias("_s")).groupBy(id, F.col("_s.at").alias("win_idx"), "term").agg((F.sum("_s.p") * F.sum("_s.q")).alias("_pq"))
    cos = met.groupBy(id, "win_idx").agg(F.sum("_pq").alias("cos"))
    return windows.select(id, "win_idx").join(cos, [id, "win_idx"], "left").select(id, "win_idx", F.when(F.col("win_idx") == 0, 0.5).otherwise(1 - F.coalesce("cos", F.lit(0.0))).alias("value"))


def coherence(weights: DataFrame, windows: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, win_idx, value): cosine of each window with the mean of its document's."""
    center = weights.groupBy(id, "term").agg(F.sum("w").alias("c"))
    size = center.groupBy(id).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
    cos = weights.join(center, [id, "term"]).groupBy(id, "win_idx").agg(F.sum(F.col("w") * F.col("c")).alias("dot")).join(size, id)
    return windows.select(id, "win_idx").join(cos, [id, "win_idx"], "left").select(id, "win_idx", F.coalesce(F.try_divide("dot", "size"), F.lit(0.0)).alias("value"))


def lexicon_hits(windows: DataFrame, lexicon: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, win_idx, category, hits): windows' tokens joined with a lexicon table of any size."""
    tokens = windows.select(id, "win_idx", F.explode(X.tokens(F.array_join("words", " "))).alias("term"))
    return tokens.join(lexicon.where("not is_phrase").select("term", "category"), "term").groupBy(id, "win_idx", "category").agg(F.count("*").alias("hits"))


#: How much an event of a kind counts; others count 1.
EVENT_WEIGHTS = {"death": 1.5, "marriage": 1.5, "conflict": 1.2}


def events(docs: DataFrame, kinds: dict[str, str], id: str = "doc_id") -> DataFrame:
    """(id, sent, kind, intensity): sentences with events; more matches count up to twice as much."""
    sentence = F.lower("sentence")
    each = docs.select(id, F.posexplode(F.split("text", "[.!?]+")).alias("sent", "sentence"))
    found = each.select(id, "sent", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), X.count(sentence, p).alias("n"), F.lit(EVENT_WEIGHTS.get(k, 1.0)).alias("w")) for k, p in kinds.items()))).alias("e"))
    return found.where("e.n > 0").select(id, "sent", "e.kind", (F.least(F.lit(2.0), 1 + 0.2 * F.col("e.n")) * F.col("e.w")).alias("intensity"))


def window_divergence(windows: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, win_idx, value): Jensen-Shannon divergence in nats of each window's terms from those of the one before; 0 for the first.

    Each term's share goes to its own window and to the next one, so both meet
    in one grouping and no window is joined with another.
    """
    sized = windows.where(F.size("terms") > 0).withColumn("_all", F.size("terms"))
    shares = sized.select(id, "win_idx", "_all", F.explode("terms").alias("term")).groupBy(id, "win_idx", "_all", "term").agg(F.count("*").alias("_n")).withColumn("_p", F.col("_n") / F.col("_all"))
    sides = F.explode(F.array(F.struct(F.col("win_idx").alias("at"), F.col("_p").alias("p"), F.lit(0.0).alias("q")), F.struct((F.col("win_idx") + 1).alias("at"), F.lit(0.0).alias("p"), F.col("_p").alias("q"))))
    met = shares.select(id, "term", sides.alias("_s")).groupBy(id, F.col("_s.at").alias("win_idx"), "term").agg(F.sum("_s.p").alias("p"), F.sum("_s.q").alias("q"))
    part = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log(2 * F.col(a) / (F.col("p") + F.col("q")))).otherwise(0.0)
    found = met.groupBy(id, "win_idx").agg((F.sum(part("p") + part("q")) / 2).alias("value"))
    return windows.select(id, "win_idx").join(found, [id, "win_idx"], "left").select(id, "win_idx", F.when(F.col("win_idx") == 0, 0.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("value"))
