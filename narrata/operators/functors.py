"""Scores of a window: counts and ratios over its words, as column expressions.

Each functor takes the window's words (array of strings) and gives a number.
A user's own functor is any function of that kind; ``REGISTRY`` holds the
named ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import lexicon as L
from narrata.functions import series as S
from narrata.functions import text as X

Functor = Callable[[Column], Column]


def body(words: Column) -> Column:
    return F.array_join(words, " ")


def read(words: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of a window's lower-case text and its tokens, each computed once."""
    return S.lets(f, lambda: F.lower(body(words)), X.tokens)


def _share(up: Column, down: Column, rest: float = 1.0) -> Column:
    return up / (up + down + rest)


def sentiment(words: Column, valence: dict[str, float] = L.SENTIMENT, negations: tuple[str, ...] = L.NEGATIONS, boosters: dict[str, float] = L.BOOSTERS) -> Column:
    """Sum of word values s as s / sqrt(s^2 + 15). A negation among the three words before turns a value to -0.74 of it; a booster right before moves it away from zero."""
    value = F.create_map(*(F.lit(x) for kv in valence.items() for x in kv))
    boost = F.create_map(*(F.lit(x) for kv in boosters.items() for x in kv))

    def scored(tokens: Column, t: Column, i: Column) -> Column:
        v = F.coalesce(F.element_at(value, t), F.lit(0.0))
        near = F.slice(tokens, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3)))
        push = F.coalesce(F.element_at(boost, S.at(tokens, i - 1)), F.lit(0.0))
        moved = v + F.signum(v) * push
        return F.when(v == 0, 0.0).when(F.exists(near, lambda w: w.isin(*negations)), -0.74 * moved).otherwise(moved)

    return S.lets(lambda tokens, s: s / F.sqrt(s * s + 15), lambda: X.tokens(body(words)), lambda tokens: S.total(F.transform(tokens, lambda t, i: scored(tokens, t, i))))


def arousal(words: Column, lexicon: L.Lexicon = L.AROUSAL) -> Column:
    """Balance of exciting and calm words in 0..1; exclamations and short uneven sentences count as exciting."""
    def score(text: Column, tokens: Column) -> Column:
        uneven = S.let(X.sentence_lengths(text).cast("array<double>"), lambda n: (S.mean(n) < 10) & (S.running_variance(n) > 20))
        high = lexicon.hits(tokens, "high") + 2 * lexicon.phrase_hits(text, "high") + 0.5 * X.count(text, "!+") + F.when(uneven, 1.0).otherwise(0.0)
        low = lexicon.hits(tokens, "low") + 2 * lexicon.phrase_hits(text, "low")
        return S.lets(lambda h, n: F.when(h + n > 0, S.clip(((h - n) / (h + n + 1) + 1) / 2)).otherwise(0.5), lambda: high, lambda h: low * F.lit(1.0))

    return read(words, score)


def presence_balance(words: Column, lexicon: L.Lexicon, up: str, down: str) -> Column:
    """The same by terms that the text contains at all (for texts without word gaps)."""
    text = body(words)
    high, low = lexicon.present(text, up), lexicon.present(text, down)
    return F.when(high + low > 0, S.clip(((high - low) / (high + low + 1) + 1) / 2)).otherwise(0.5)


def lexical_entropy(words: Column) -> Column:
    return S.normal_entropy(X.matches(F.lower(body(words)), X.LETTERS))


def bigram_entropy(words: Column) -> Column:
    """0.5 for fewer than two tokens."""
    return S.let(X.matches(F.lower(body(words)), X.LETTERS), lambda t: F.when(F.size(t) > 1, S.normal_entropy(X.ngrams(t, 2))).otherwise(0.5))


def structural_entropy(words: Column) -> Column:
    """Unevenness of sentence lengths, and entropy of six kinds of marks."""
    text = body(words)
    uneven = S.let(X.sentence_lengths(text).cast("array<double>"), lambda n: F.when((F.size(n) > 1) & (S.mean(n) > 0), F.least(F.lit(1.0), S.deviation(n) / S.mean(n) / 1.5)).otherwise(0.0))
    marks = S.entropy(X.matches(text, "[.,!?;:]")) / 2.584962500721156
    return 0.6 * uneven + 0.4 * marks


def entropy(words: Column) -> Column:
    return 0.4 * lexical_entropy(words) + 0.3 * bigram_entropy(words) + 0.3 * structural_entropy(words)


def entropy_ja(words: Column) -> Column:
    """Kinds of characters, triples of characters, and particles."""
    text = F.array_join(words, "")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    kind = F.transform(chars, lambda c: F.when(F.rlike(c, F.lit("\\p{IsHiragana}")), "h").when(F.rlike(c, F.lit("\\p{IsKatakana}")), "k").when(F.rlike(c, F.lit("\\p{IsHan}")), "c").otherwise("o"))
    return 0.3 * S.entropy(kind) / 2 + 0.4 * S.normal_entropy(X.ngrams(X.characters(text), 3)) + 0.3 * S.normal_entropy(X.matches(text, "[はがをにでとものへや]"))


def epistemic(words: Column, lexicon: L.Lexicon = L.EPISTEMIC) -> Column:
    """Certain over certain and uncertain words; half if there are none."""
    def score(text: Column, tokens: Column) -> Column:
        sure = lexicon.hits(tokens, "certain") + lexicon.phrase_hits(text, "certain") + 0.75 * lexicon.hits(tokens, "reveal")
        unsure = lexicon.hits(tokens, "uncertain") + lexicon.phrase_hits(text, "uncertain") + 0.5 * X.count(text, "\\?")
        return S.lets(lambda a, b: F.when(a + b > 0, _share(a, b)).otherwise(0.5), lambda: sure, lambda a: unsure)

    return read(words, score)


def dialogue_density(words: Column) -> Column:
    """Share of characters between double quotes."""
    text = body(words)
    said = F.aggregate(X.matches(text, "[\"“][^\"”]*[\"”]"), F.lit(0), lambda a, s: a + F.length(s))
    return F.when(F.length(text) > 0, said / F.length(text)).otherwise(0.0)


def sentence_rhythm(words: Column) -> Column:
    """1 for sentences of five words and fewer, 0 from thirty on."""
    return S.let(X.sentence_lengths(body(words)).cast("array<double>"), lambda n: F.when(F.size(n) > 0, S.clip((30 - S.mean(n)) / 25)).otherwise(0.5))


def pacing(words: Column, actions: tuple[str, ...] = L.ACTION) -> Column:
    text = body(words)
    tokens = X.tokens(text)
    paragraphs = F.least(F.lit(1.0), X.count(text, "\\n[ \\t]*\\n") / F.greatest(F.size(words), F.lit(1)) * 50)
    action = F.size(F.filter(tokens, lambda t: t.isin(*actions))) / F.greatest(F.size(tokens), F.lit(1))
    return S.clip(0.35 * F.least(F.lit(1.0), 2 * dialogue_density(words)) + 0.30 * sentence_rhythm(words) + 0.20 * paragraphs + 0.15 * F.least(F.lit(1.0), 33 * action))


def pacing_ja(words: Column) -> Column:
    text = F.array_join(words, "")
    said = F.aggregate(X.matches(text, "「[^」]*」"), F.lit(0), lambda a, s: a + F.length(s)) / F.greatest(F.length(text), F.lit(1))
    parts = F.filter(F.split(text, "[。！？]+"), lambda s: s != "")
    mean = S.mean(F.transform(parts, lambda s: F.length(s).cast("double")))
    return S.clip(0.4 * F.least(F.lit(1.0), 2 * said) + 0.4 * F.coalesce(S.clip((60 - mean) / 50), F.lit(0.5)) + 0.2 * F.least(F.lit(1.0), X.count(text, "[！？]") / F.greatest(F.size(parts), F.lit(1))))


def names(text: Column) -> Column:
    """Capitalised words that do not begin a sentence."""
    return F.transform(X.matches(text, "[\\p{Ll},;] +\\p{Lu}\\p{Ll}{2,}"), lambda m: F.regexp_extract(m, "\\p{Lu}\\p{Ll}{2,}$", 0))


def character_presence(words: Column) -> Column:
    """Names per hundred words over 15, and a little for more than three different ones."""
    def score(found: Column) -> Column:
        per = F.size(found) * 100.0 / F.greatest(F.size(words), F.lit(1))
        return S.clip(per / 15 + F.least(F.lit(0.1), 0.02 * F.greatest(F.size(F.array_distinct(found)) - 3, F.lit(0))))

    return S.let(names(body(words)), score)


def point_of_view(words: Column, lexicon: L.Lexicon = L.VOICE) -> Column:
    """first, second, third or mixed by shares of pronouns; indeterminate under five of them."""
    def rule(a: Column, b: Column, c: Column) -> Column:
        all_ = a + b + c
        share = {k: v / F.greatest(all_, F.lit(1)) for k, v in (("first", a), ("second", b), ("third", c))}
        return F.when(all_ < 5, "indeterminate").when(share["first"] > 0.6, "first").when(share["third"] > 0.6, "third").when(share["second"] > 0.4, "second").when((share["first"] > 0.3) & (share["third"] > 0.3), "mixed").otherwise("third")

    return S.let(X.tokens(body(words)), lambda t: S.lets(rule, lambda: lexicon.hits(t, "first"), lambda a: lexicon.hits(t, "second"), lambda a, b: lexicon.hits(t, "third")))


def narrative_voice(words: Column, lexicon: L.Lexicon = L.VOICE) -> Column:
    """Distance of the narrator: 0 close, 1 distant."""
    def distance(tokens: Column) -> Column:
        far, near = lexicon.hits(tokens, "distant"), lexicon.hits(tokens, "close")
        return F.when(far + near > 0, _share(far, near)).otherwise(0.5)

    def moved(base: Column, view: Column) -> Column:
        return F.when(view == "first", 0.8 * base).when(view == "third", 0.2 + 0.8 * base).otherwise(base)

    return S.lets(moved, lambda: S.let(X.tokens(body(words)), distance), lambda base: point_of_view(words, lexicon))


def tension(words: Column, lexicon: L.Lexicon = L.TENSION, events: dict[str, str] = L.EVENTS) -> Column:
    """Raw tension: conflict against resolution words, and events; half for an empty window."""
    def score(text: Column, tokens: Column) -> Column:
        balance = 10 * (lexicon.hits(tokens, "conflict") - lexicon.hits(tokens, "resolution")) / F.greatest(F.size(tokens), F.lit(1))
        terms = {"death": 0.15, "conflict": 0.15, "revelation": 0.10, "marriage": -0.10}
        strength = lambda n: F.least(F.lit(2.0), F.when(n > 0, 1 + 0.2 * n).otherwise(0.0))
        moved = sum((w * S.let(X.count(text, events[e]), strength) for e, w in terms.items() if e in events), F.lit(0.0))
        return F.when(F.size(tokens) > 0, S.clip(0.5 + balance + moved)).otherwise(0.5)

    return read(words, score)


def event_intensity(words: Column, events: dict[str, str] = L.EVENTS) -> Column:
    """Events of all kinds per hundred words over four."""
    text = F.lower(body(words))
    factor = {"death": 1.5, "marriage": 1.5, "conflict": 1.2}
    hits = {e: X.count(text, p) for e, p in events.items()}
    all_ = sum((F.when(n > 0, F.least(F.lit(2.0), 1 + 0.2 * n)).otherwise(0.0) * factor.get(e, 1.0) for e, n in hits.items()), F.lit(0.0))
    return F.least(F.lit(1.0), all_ / F.greatest(F.size(words), F.lit(1)) * 100 / 4)


@S.bound
def looked_back(tokens: Column, lexicon: L.Lexicon, matches: Callable[[Column, str], Column], back: int, rest: float, boost_back: int = 2) -> Column:
    """(P - N) / (P + N + rest): a negation among the ``back`` tokens before turns good to 0.7 bad and bad to 0.5 good; a booster adds half."""

    def part(t: Column, i: Column) -> Column:
        near = F.slice(tokens, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)))
        close = F.slice(tokens, F.greatest(i - boost_back, F.lit(0)) + 1, F.least(i, F.lit(boost_back)))
        w = F.when(F.exists(close, lambda x: x.isin(*lexicon.terms["booster"])), 1.5).otherwise(1.0)
        no = F.exists(near, lambda x: x.isin(*lexicon.terms["negation"]))
        good, bad = matches(t, "positive"), matches(t, "negative")
        p = F.when(good & ~no, w).when(bad & ~good & no, 0.5 * w).otherwise(0.0)
        n = F.when(bad & ~good & ~no, w).when(good & no, 0.7 * w).otherwise(0.0)
        return F.struct(p.alias("p"), n.alias("n"))

    parts = F.transform(tokens, part)
    size = F.greatest(F.size(tokens), F.lit(1)) / 100.0
    p, n = (S.total(F.transform(parts, lambda x, k=k: x.getField(k))) / size for k in ("p", "n"))
    return (p - n) / (p + n + rest)


def sentiment_zh(words: Column, lexicon: L.Lexicon = L.ZH) -> Column:
    return looked_back(X.characters(F.array_join(words, "")), lexicon, lambda t, c: t.isin(*lexicon.terms[c]), 3, 10)


def sentiment_ar(words: Column, lexicon: L.Lexicon = L.AR) -> Column:
    return looked_back(X.words(X.normal_ar(body(words))), lexicon, lambda t, c: t.isin(*lexicon.terms[c]), 2, 10)


def sentiment_ru(words: Column, lexicon: L.Lexicon = L.RU) -> Column:
    """Stems match the beginnings of words, good ones first."""
    return looked_back(X.words(X.normal_ru(body(words))), lexicon, lambda t, c: F.lit(False) if not lexicon.terms[c] else F.rlike(t, F.lit("^(" + "|".join(lexicon.terms[c]) + ")")), 2, 15)


def sentiment_ja(words: Column, lexicon: L.Lexicon = L.JA) -> Column:
    text = F.array_join(words, "")
    p, n, no = (sum((L.occurrences(text, t) for t in lexicon.terms[c]), F.lit(0)) for c in ("positive", "negative", "negation"))
    s = (p - n) / (p + n + 1)
    return S.clip(F.when((no > 0) & (F.abs(s) > 0.1), 0.5 * s).otherwise(s), -1.0, 1.0)


REGISTRY: dict[str, Functor] = {
    "sentiment": sentiment, "arousal": arousal, "entropy": entropy, "lexical_entropy": lexical_entropy, "bigram_entropy": bigram_entropy, "structural_entropy": structural_entropy, "epistemic": epistemic, "pacing": pacing, "character_presence": character_presence, "narrative_voice": narrative_voice, "tension": tension, "event_intensity": event_intensity,
    "sentiment_ja": sentiment_ja, "sentiment_zh": sentiment_zh, "sentiment_ar": sentiment_ar, "sentiment_ru": sentiment_ru, "entropy_ja": entropy_ja, "pacing_ja": pacing_ja,
    "arousal_ja": lambda w: presence_balance(w, L.JA, "high", "low"), "epistemic_ja": lambda w: presence_balance(w, L.JA, "certain", "uncertain"), "voice_ja": lambda w: presence_balance(w, L.JA, "third", "first"),
}


def register(name: str, functor: Functor) -> None:
    """Add a user's functor under a name of its own."""
    if name in REGISTRY:
        raise ValueError(f"{name} exists already")
    REGISTRY[name] = functor
