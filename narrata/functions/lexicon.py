"""Word lists as parameters, and what can be counted with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lexicon:
    """Terms by category. Words are compared with tokens, phrases with text."""

    terms: dict[str, tuple[str, ...]]
    phrases: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def hits(self, tokens: Column, category: str) -> Column:
        """How many tokens are words of the category."""
        words = self.terms.get(category, ())
        return F.size(F.filter(tokens, lambda t: t.isin(*words))) if words else F.lit(0)

    def phrase_hits(self, text: Column, category: str) -> Column:
        """Occurrences of the category's phrases in lower-case text."""
        return sum((occurrences(text, p) for p in self.phrases.get(category, ())), F.lit(0))

    def present(self, text: Column, category: str) -> Column:
        """How many terms of the category the text contains."""
        return sum((F.contains(text, F.lit(t)).cast("int") for t in self.terms.get(category, ())), F.lit(0))

    def table(self, spark: SparkSession, lang: str = "en") -> DataFrame:
        """The dimension table (lang, category, term, is_phrase)."""
        rows = [(lang, c, t, False) for c, ts in self.terms.items() for t in ts] + [(lang, c, t, True) for c, ts in self.phrases.items() for t in ts]
        return spark.createDataFrame(rows, "lang string, category string, term string, is_phrase boolean")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


# Default lexicons: short and general, meant to be replaced by a corpus's own.
AROUSAL = Lexicon(
    {"high": ("attack", "battle", "blood", "burst", "crash", "danger", "fight", "fire", "fury", "panic", "rage", "run", "scream", "storm", "terror"), "low": ("calm", "drift", "gentle", "hush", "peace", "quiet", "rest", "serene", "silence", "sleep", "slow", "soft", "still", "tranquil")},
    {"high": ("all at once", "in a flash", "at full speed")},
)
EPISTEMIC = Lexicon(
    {"certain": ("always", "certain", "clearly", "definitely", "fact", "indeed", "knew", "know", "must", "never", "proof", "sure", "truth"), "uncertain": ("apparently", "doubt", "guess", "if", "maybe", "might", "perhaps", "possibly", "seem", "suppose", "unsure", "wonder"), "reveal": ("discover", "discovered", "realize", "realized", "reveal", "revealed", "understood")},
    {"certain": ("no doubt", "of course"), "uncertain": ("not sure", "who knows")},
)
SENTIMENT = {"good": 1.9, "great": 3.1, "happy": 2.7, "joy": 2.8, "love": 3.2, "hope": 1.9, "kind": 2.4, "win": 2.8, "bad": -2.5, "cruel": -2.8, "dark": -1.2, "dead": -3.3, "fear": -2.2, "hate": -2.7, "loss": -1.3, "pain": -2.3, "sad": -2.1, "terrible": -2.1}
NEGATIONS = ("no", "not", "never", "none", "nor", "neither", "without", "cannot")
BOOSTERS = {"very": 0.293, "really": 0.293, "so": 0.293, "extremely": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293}
VOICE = Lexicon({"first": ("i", "me", "my", "mine", "we", "us", "our", "ours", "myself"), "second": ("you", "your", "yours", "yourself"), "third": ("he", "him", "his", "she", "her", "hers", "they", "them", "their", "it", "its"), "close": ("feel", "felt", "thought", "wondered", "knew", "wanted", "heart", "mind"), "distant": ("according", "historically", "generally", "reported", "observed", "century", "people", "society")})
ACTION = ("ran", "run", "jump", "jumped", "struck", "hit", "threw", "grabbed", "rushed", "fled", "chased", "fought", "leapt", "shot")
SPEECH = ("said", "asked", "replied", "cried", "answered", "whispered", "shouted", "told")
EVENTS = {
    "death": r"\b(died|death|killed|murder(?:ed)?|dead)\b",
    "marriage": r"\b(married|marriage|wedding|bride|groom)\b",
    "conflict": r"\b(fought|fight|battle|quarrel(?:led)?|war|struck)\b",
    "revelation": r"\b(discovered|revealed|realized|confessed|learned)\b",
    "journey": r"\b(travelled|journey|departed|arrived|voyage)\b",
}
TENSION = Lexicon({"conflict": ("against", "battle", "danger", "enemy", "fear", "fight", "kill", "struggle", "threat", "war"), "resolution": ("agreed", "calm", "forgave", "home", "peace", "reconciled", "rest", "safe", "settled", "together")})
JA = Lexicon({"positive": ("嬉しい", "楽しい", "幸せ", "喜び", "愛"), "negative": ("悲しい", "苦しい", "怒り", "恐れ", "死"), "negation": ("ない", "ません", "ぬ"), "high": ("走", "叫", "怒", "激", "驚"), "low": ("静", "眠", "穏", "休"), "certain": ("確か", "必ず", "もちろん"), "uncertain": ("たぶん", "かもしれない", "だろう"), "first": ("私", "僕", "俺", "わたし"), "second": ("あなた", "君"), "third": ("彼", "彼女")})
ZH = Lexicon({"positive": ("喜", "乐", "爱", "福", "笑"), "negative": ("悲", "哀", "怒", "恨", "死"), "negation": ("不", "无", "非", "未", "没"), "booster": ("很", "甚", "极", "大", "太")})
AR = Lexicon({"positive": ("سعيد", "حب", "فرح", "جميل", "خير"), "negative": ("حزن", "خوف", "موت", "شر", "غضب"), "negation": ("لا", "لم", "لن", "ليس", "ما"), "booster": ("جدا", "كثيرا")})
RU = Lexicon({"positive": ("радост", "любов", "счаст", "хорош", "добр"), "negative": ("горе", "страх", "смерт", "плох", "зл"), "negation": ("не", "ни", "нет", "без"), "booster": ("очень", "совсем", "крайне")})
