"""Personal data by patterns, and by the contexts that they teach.

Base spans of four kinds are found by regular expressions. Then contexts are
bootstrapped: a base span is a seed instance of its kind; the words beside it
make lexical patterns ("l2 l1 _", "l1 _", "l1 _ r1"); patterns and instances
are the two sides of a graph whose edges are distinct, so that copies of a text
add nothing. Each round scores the patterns by the share of their instances
that are known to be of a kind, and the instances under a strong pattern by all
their strong patterns; good ones become known, for the next round. Instances
that may be found so are whole words with a digit or an ``@``. All occurrences
of a found instance outside base spans are spans of its kind.

Only DataFrame operations are used. Matches are told from the pieces between
them, in the row of their text; what leaves the row are the matches, with
lengths and a few words of context, never texts. Places are running sums within
a text. No table is collected or broadcast by hint.

Defined results: null and empty texts have no spans; rows are told apart by
themselves, so null and repeated ids and repeated rows each get their own
result; an empty table gives an empty one; columns that have the name of an
output are replaced. Kinds may overlap each other; spans of one kind do not.
``n_email`` to ``n_phone`` count base spans, ``n_added`` the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import series as S
from narrata.llm.rows import unnest
from narrata.workspace import Workspace

# Each pattern finds what the plain one beside it finds. It starts at the head of a run of its first class, or where the last
# match ended, and never gives characters back, so that time and stack do not grow with the length of a run.
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OUTPUTS = [*(f"n_{k}" for k in KINDS), "n_added", "base", "spans"]
#: Whole words with a digit or an @, without the punctuation around them.
WORD = r"(?<![^\s\"'(\[<{])(?![\"'(\[<{])[^\s0-9@]*+[0-9@][^\s]*+"
_TAIL = r"[^0-9A-Za-z]++$"
#: Code points beside a match that its context is taken from.
REACH = 64
#: Least share of known instances of a strong pattern, so many unknown ones added; least number of them; least score of an instance; most rounds.
CONFIDENCE, DOUBT, SUPPORT, SCORE, ROUNDS = 0.8, 2.0, 3, 0.8, 10


def _part(p: str) -> str:
    return rf"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]){p}"


def valid(kind: str, match: Column) -> Column:
    """Whether a match is of the kind: parts up to 255, 13 to 19 digits with their check digit, 9 to 15 digits."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": F.rlike(match, F.lit("^" + "".join(map(_part, [r"\.", r"\.", r"\.", "$"])))),
        "card": F.when(size.between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False)),
        "phone": size.between(9, 15),
    }[kind]


def _words(text: Column) -> Column:
    """Lower-cased words without punctuation around them; one that holds an identifier is ``#``."""
    bare = lambda w: F.regexp_replace(w, r"^\p{Punct}+(?=.)|(?<=.)\p{Punct}+$", "")
    told = lambda w: F.when(F.rlike(w, F.lit("[0-9@]")), F.lit("#")).otherwise(bare(F.lower(w)))
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), told)


def located(text: Column, kind: str, pattern: str) -> Column:
    """Each match in turn: its kind, the lengths of the piece before it and of itself, and, if it is valid, itself and the words beside it."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(pieces: Column, match: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        left, right = _words(F.right(before, F.lit(REACH))), _words(F.left(after, F.lit(REACH)))
        head = F.when(i == 0, F.lit("^")).otherwise(F.lit("#"))
        tail = F.when(i + 2 == F.size(pieces), F.lit("$")).otherwise(F.lit("#"))
        core = F.regexp_replace(match, _TAIL, "") if kind == "word" else match
        ok = F.rlike(core, F.lit("[0-9@]")) & (F.length(core) > 3) if kind == "word" else valid(kind, match)
        context = F.struct(
            F.lower(core).alias("instance"), F.length(core).cast("long").alias("size"),
            F.coalesce(F.try_element_at(left, F.lit(-2)), F.when(F.size(left) == 1, head).otherwise(F.lit("^"))).alias("l2"),
            F.coalesce(F.try_element_at(left, F.lit(-1)), head).alias("l1"), F.coalesce(F.try_element_at(right, F.lit(1)), tail).alias("r1"),
        )
        return F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("place"), F.length(before).cast("long").alias("gap"), F.length(match).cast("long").alias("length"), F.when(ok, context).alias("is"))

    return S.let(gaps, lambda pieces: F.transform(found, lambda match, i: one(pieces, match, i)))


_HINTS = {"email": "@", "ip": ".", "phone": "+"}


def _all(text: Column) -> Column:
    """Matches of every kind, and words that may be found by their context."""
    parts = []
    for kind, pattern in {**KINDS, "word": WORD}.items():
        may = F.rlike(text, F.lit("[0-9@]"))
        if kind in _HINTS:
            may = may & F.contains(text, F.lit(_HINTS[kind]))
        parts.append(F.when(may, located(text, kind, pattern)))
    return F.concat(*(F.coalesce(p, F.filter(located(F.lit(""), "word", WORD), lambda _: F.lit(False))) for p in parts))


def placed(found: DataFrame) -> DataFrame:
    """(row, kind, start, stop, instance, l2, l1, r1, clear) of valid matches; ``clear`` words lie outside all base spans."""
    of_kind = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = found.repartition("row").withColumn("start", F.sum(F.col("gap") + F.col("length")).over(of_kind) - F.col("length"))
    good = ends.where(F.col("is").isNotNull()).select("row", "kind", "start", (F.col("start") + F.col("is.size")).alias("stop"), "is.instance", "is.l2", "is.l1", "is.r1")
    base = F.col("kind") != "word"
    order = Window.partitionBy("row").orderBy("start")
    before = F.max(F.when(base, F.col("stop"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    met = (F.coalesce(before, F.lit(-1)) > F.col("start")) | (F.coalesce(after, F.col("stop")) < F.col("stop"))
    return good.withColumn("clear", ~base & ~met).where(base | F.col("clear"))


def edges(items: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, kind): kind is null for words that are not known."""
    patterns = F.array(F.concat_ws(" ", "l2", "l1", F.lit("_")), F.concat_ws(" ", "l1", F.lit("_")), F.concat_ws(" ", "l1", F.lit("_"), "r1"))
    return items.select(F.explode(patterns).alias("pattern"), "instance", F.when(F.col("kind") != "word", F.col("kind")).alias("kind")).distinct()


def bootstrap(ws: Workspace, graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of unknown instances that strong patterns find; ``graph`` is that of :func:`edges`."""
    sizes = graph.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    # Others can never be strong.
    live = ws.save(graph.join(sizes.where(F.col("n") >= SUPPORT), "pattern"), "edges")
    seeds = live.where("kind is not null").select("pattern", "n", "kind", F.lit(1.0).alias("score"))
    unknown = ws.save(live.where("kind is null").drop("kind"), "unknown")
    known = None
    for _ in range(rounds):
        learnt = seeds if known is None else seeds.union(unknown.join(known, "instance").select("pattern", "n", "kind", "score"))
        scored = learnt.groupBy("pattern", "kind").agg((F.sum("score") / (F.first("n") + DOUBT)).alias("confidence"), F.count("*").alias("support"))
        strong = ws.save(scored.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).drop("support"), "strong")
        # Each strong pattern is a witness of its own.
        reached = unknown.join(strong, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = reached.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score").where(F.col("score") >= SCORE)
        # What is known stays known, of its first kind.
        new = best if known is None else best.join(known.select("instance"), "instance", "left_anti")
        new = ws.save(new, "new")
        if not new.take(1):
            break
        known = ws.save(new if known is None else known.union(new), "known")
    return known if known is not None else ws.spark.createDataFrame([], "instance string, kind string, score double")


def find(df: DataFrame, text: str, columns: list[str] | None = None, ws: Workspace | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Add to each row the number of spans of each kind, ``n_added``, and ``base`` and ``spans``: arrays of (kind, start, stop) by kind and start.

    ``columns`` are those of ``df`` to keep (all if not given).
    """
    columns = df.columns if columns is None else columns
    ws = ws or Workspace(df.sparkSession, "personal")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = ws.save(df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), _all(body).alias("found")).withColumn("id", F.monotonically_increasing_id()), "rows")
    found = rows.where(F.size("found") > 0).select(F.col("id").alias("row"), F.explode("found").alias("f")).select("row", "f.*")
    items = ws.save(placed(found), "items")
    known = bootstrap(ws, edges(items), rounds)
    base = items.where("kind <> 'word'").select("row", "kind", "start", "stop", F.lit(False).alias("added"))
    added = items.where("kind = 'word'").drop("kind").join(known.drop("score"), "instance").select("row", "kind", "start", "stop", F.lit(True).alias("added"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(rank.alias("rank"), "start", "stop", "kind", "added")
    of_row = base.union(added).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all")).withColumnRenamed("row", "id")
    joined = rows.select("id", "row").join(of_row, "id", "left").withColumn("all", F.coalesce("all", F.expr("array()").cast(of_row.schema["all"].dataType)))
    shown = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))

    def count(kind: str | None) -> Column:
        """Base spans of a kind, or the others."""
        return F.size(F.filter("all", lambda x: ~x["added"] & (x["kind"] == kind) if kind else x["added"])).cast("long")

    out = {
        **{f"n_{k}": count(k) for k in KINDS},
        "n_added": count(None),
        "base": F.transform(F.filter("all", lambda x: ~x["added"]), shown),
        "spans": F.transform("all", shown),
    }
    return unnest(joined.withColumns(out), columns, *out)


def written(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
