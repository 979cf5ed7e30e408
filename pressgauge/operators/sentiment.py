"""Lexicon sentiment, provider thresholds and provider fallback.

The lexicon method is the published rule-based one (Hutto & Gilbert, ICWSM
2014). The word list is a table argument; ``read_lexicon`` loads the usual
tab-separated file and ``default_lexicon`` is a short one.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgauge import settings
from pressgauge.session import materialize
from pressgauge.functions.text import WHITESPACE_RUN, is_upper, label_for, strip

# Rules, modifiers and constants are those of the published method (Hutto and Gilbert, 2014; MIT licence).
# --- fixed values of the method -------------------------------------------------

BOOST, CAPS, NEGATE = 0.293, 0.733, -0.74
ALPHA = 15.0
DISTANCE_DAMPING = {1: 1.0, 2: 0.95, 3: 0.9}

BOOSTERS = """absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous
enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin frackin
fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly hugely
incredible incredibly intensely major majorly more most particularly purely quite really remarkably so
substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very""".split()

DAMPENERS = """almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally
partly scarce scarcely slight slightly somewhat sorta sortof sort-of""".split()
DAMPENER_PHRASES = ["just enough", "kind of", "sort of"]

NEGATIONS = """aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't
dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't
never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh
wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite""".split()

IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0,
    "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}

# A short word list, valence -4..4; valences follow those published with the method, from memory and unchecked.
DEFAULT_WORDS = {
    "good": 1.9, "great": 3.1, "best": 3.2, "better": 1.9, "excellent": 2.7, "love": 3.2, "loved": 2.9, "happy": 2.7,
    "success": 2.7, "successful": 2.8, "win": 2.8, "winner": 2.8, "won": 2.7, "growth": 1.6, "gain": 2.4, "gains": 1.4,
    "hope": 1.9, "promise": 1.3, "progress": 1.8, "safe": 1.9, "secure": 1.4, "support": 1.7, "help": 1.7, "helpful": 1.8,
    "trust": 2.3, "benefit": 2.0, "benefits": 1.6, "free": 2.3, "fun": 2.3, "nice": 1.8, "perfect": 2.7, "positive": 2.6,
    "strong": 2.3, "improve": 1.9, "improved": 2.1, "agree": 1.5, "agreement": 2.2, "award": 2.5, "brilliant": 2.8,
    "calm": 1.3, "celebrate": 2.7, "cheer": 2.3, "clean": 1.7, "creative": 1.9, "daring": 0.5, "easy": 1.9, "enjoy": 2.2,
    "fair": 1.3, "friend": 2.2, "friendly": 2.2, "glad": 2.0, "healthy": 1.7, "honest": 2.3, "innovative": 1.9, "joy": 2.8,
    "kind": 2.4, "like": 1.5, "lucky": 1.8, "peace": 2.5, "pleased": 1.9, "please": 1.3, "popular": 1.8, "rescue": 2.3,
    "resilience": 1.6, "rich": 2.6, "rights": 0.9, "smart": 1.7, "solution": 1.3, "superb": 3.1, "thanks": 1.9, "top": 0.8,
    "welcome": 2.0, "well": 1.1, "wonderful": 2.7, "yes": 1.7, "breakthrough": 1.9, "ambitious": 2.1, "granted": 1.0,
    "bad": -2.5, "worse": -2.1, "worst": -3.1, "terrible": -2.1, "awful": -2.0, "hate": -2.7, "sad": -2.1, "angry": -2.3,
    "fail": -2.5, "failed": -2.3, "failure": -2.3, "lose": -1.7, "loss": -1.3, "losses": -1.7, "lost": -1.3, "war": -2.9,
    "attack": -2.1, "attacks": -1.9, "crisis": -3.1, "crash": -1.7, "cut": -1.1, "damage": -2.2, "damages": -1.9,
    "danger": -2.4, "dangerous": -2.1, "dead": -3.3, "death": -2.9, "die": -2.9, "died": -2.6, "disaster": -3.1, "error": -1.7,
    "evil": -3.4, "fear": -2.2, "fears": -1.8, "fight": -1.6, "fire": -1.4, "fraud": -2.8, "guilty": -1.8, "harm": -2.5,
    "hurt": -2.4, "illegal": -2.6, "kill": -3.7, "killed": -3.5, "lie": -1.6, "murder": -3.7, "negative": -2.7, "no": -1.2,
    "pain": -2.3, "panic": -2.3, "poor": -2.1, "problem": -1.7, "problems": -1.7, "protest": -1.0, "risk": -1.1, "risks": -1.1,
    "scam": -2.7, "scandal": -1.9, "serious": -0.3, "shortage": -1.0, "sick": -2.3, "spam": -1.5, "stop": -1.2, "strike": -0.5,
    "suffer": -2.5, "threat": -2.4, "threats": -1.8, "tragedy": -3.4, "trouble": -1.7, "ugly": -2.3, "uncertain": -1.2,
    "uncertainty": -1.4, "upset": -1.6, "victim": -1.1, "violence": -3.1, "warning": -1.4, "weak": -1.9, "wrong": -2.1,
}

# -------------------------------------------------------------------------------

# The word that closes every token list. It is in the lexicon with valence 0, so
# each text keeps one row through the inner join even when nothing else matches.
END = ""
NO_COALESCE = 1 << 30


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_WORDS.items()), "word string, valence double")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word list: word, mean valence, further columns ignored."""
    return (
        spark.read.schema("word string, valence double, deviation string, ratings string")
        .option("sep", "\t").option("quote", "").csv(path).select("word", "valence")
    )


def _without_punctuation(token: Column) -> Column:
    """Outer ASCII punctuation goes unless two characters or fewer would remain (emoticons)."""
    bare = F.btrim(token, F.lit(string.punctuation))
    return F.when(F.char_length(bare) <= 2, token).otherwise(bare)


def _count(text: Column, mark: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))


def _emphasis(text: Column) -> Column:
    asks = _count(text, "?")
    return F.least(_count(text, "!"), F.lit(4)) * 0.292 + (
        F.when(asks > 3, 0.96).when(asks > 1, asks * 0.18).otherwise(0.0)
    )


MAX_BROADCAST_BYTES = 64 << 20


def _lookup_side(words: DataFrame) -> DataFrame:
    """The word table, stored once, broadcast if it is known to be small in bytes and merged by sorting otherwise.

    Left alone, Spark may broadcast the other side: it does not see how many tokens a small file of texts holds.
    """
    words = materialize(words)
    size = words.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0
    return F.broadcast(words) if size <= MAX_BROADCAST_BYTES else words.hint("merge")


def _words(lexicon: DataFrame) -> DataFrame:
    """The lexicon keyed by lowercase word, plus the end marker."""
    end = lexicon.sparkSession.createDataFrame([(END, 0.0)], "word string, valence double")
    words = lexicon.select(F.lower("word").alias("word"), F.col("valence").cast("double").alias("valence"))
    words = words.filter(F.col("word") != END).unionByName(end)
    return _lookup_side(words.groupBy("word").agg(F.max("valence").alias("valence")))


def _dictionary(lexicon: DataFrame) -> DataFrame:
    """Everything known about a word: valence, strength as a modifier, whether it negates."""
    modifiers = (
        [(w, None, BOOST, False) for w in BOOSTERS] + [(w, None, -BOOST, False) for w in DAMPENERS]
        + [(w, None, None, True) for w in NEGATIONS] + [(END, 0.0, None, False)]
    )
    schema = "word string, valence double, strength double, negates boolean"
    words = lexicon.select(
        F.lower("word").alias("word"), F.col("valence").cast("double").alias("valence"),
        F.lit(None).cast("double").alias("strength"), F.lit(False).alias("negates"),
    ).filter(F.col("word") != END)
    entries = words.unionByName(lexicon.sparkSession.createDataFrame(modifiers, schema)).groupBy("word").agg(
        F.max("valence").alias("valence"), F.max("strength").alias("strength"), F.bool_or("negates").alias("negates")
    )
    return _lookup_side(entries)


def _tokens(text: Column) -> Column:
    """Whitespace-separated tokens without outer punctuation, then the end marker."""
    bare = strip(text)
    none = F.array().cast("array<string>")
    split = F.coalesce(F.when(bare != "", F.split(bare, WHITESPACE_RUN)).otherwise(none), none)
    return F.transform(F.array_append(split, F.lit(END)), _without_punctuation)


NEAR = {3: "_b3", 2: "_b2", 1: "_b1", 0: "_b0", -1: "_a1", -2: "_a2"}


def _hits(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """One row per lexicon hit with its neighbours; every text keeps its end marker row.

    Arrays are built once per text. Each token is looked up in the broadcast
    lexicon, and only the hits pick their neighbours out of the arrays, so no row
    ever copies them. Nothing is shuffled here.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(key, text).select(
        F.col(key), _tokens(F.col(text)).alias("_tokens"), _emphasis(body).alias("_emphasis")
    )
    docs = docs.withColumn("_low", F.transform("_tokens", F.lower))
    docs = docs.withColumns({
        "_but": F.array_position("_low", "but").cast("int") - 1,
        # Capitals count only in a text that also has words in another case.
        "_other_case": F.exists("_tokens", lambda t: (t != END) & ~is_upper(t)),
    })
    each = docs.select("*", F.posexplode_outer("_low").alias("_pos", "_key"))
    hits = each.join(words, F.col("_key") == F.col("word"))

    def pick(array: str, distance: int) -> Column:
        return F.coalesce(F.get(array, F.col("_pos") - distance), F.lit(END))

    return hits.select(
        key, "_pos", "word", "valence", "_but", "_emphasis", "_other_case",
        (F.size("_tokens") - 2 - F.col("_pos")).alias("_after"),
        *[pick("_low", d).alias(name) for d, name in NEAR.items()],
        *[pick("_tokens", d).alias(f"{NEAR[d]}_cased") for d in (3, 2, 1, 0)],
    )


def sentiment_words(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """One row per lexicon hit with its final valence, plus one zero row per text."""
    known = _dictionary(lexicon)
    # A modifier that is also in the lexicon has no valence of its own.
    scoring = known.filter("valence IS NOT NULL AND strength IS NULL").select("word", "valence")
    # coalesce() to no fewer partitions moves nothing. It ends the generated-code stage here:
    # lookup and rules in one method would be too long for the JVM to compile.
    hits = _hits(df, key, text, scoring).coalesce(NO_COALESCE)
    for back in (1, 2, 3):
        hits = hits.join(
            known.select(
                F.col("word").alias("_known"), F.col("valence").alias(f"_valence{back}"),
                F.col("strength").alias(f"_strength{back}"), F.col("negates").alias(f"_negates{back}"),
            ),
            F.col(NEAR[back]) == F.col("_known"), "left",
        ).drop("_known")
    after_it = known.select(F.col("word").alias("_known"), F.col("valence").alias("_valence_after"))
    hits = hits.join(after_it, F.col(NEAR[-1]) == F.col("_known"), "left").drop("_known")

    word, pos, after, v = F.col("word"), F.col("_pos"), F.col("_after"), F.col("_v")
    low = {d: F.col(name) for d, name in NEAR.items()}
    loud = {d: is_upper(F.col(f"{NEAR[d]}_cased")) & F.col("_other_case") for d in (3, 2, 1, 0)}

    # "no" right before a sentiment word hands its weight over; a "no" before the word flips it.
    hands_over = (word == "no") & (after > 0) & F.col("_valence_after").isNotNull()
    after_no = (low[1] == "no") | (low[2] == "no") | ((low[3] == "no") & low[1].isin("or", "nor"))
    start = F.when(after_no, F.col("valence") * NEGATE).when(hands_over, 0.0).otherwise(F.col("valence"))
    out = hits.withColumn("_v", start)
    out = out.withColumn("_v", F.when(loud[0], v + F.when(v > 0, CAPS).otherwise(-CAPS)).otherwise(v))
    for back in (1, 2, 3):
        # Only a word that is there and carries no valence itself can modify.
        plain = (pos >= back) & F.col(f"_valence{back}").isNull()
        added = _added(v, F.col(f"_strength{back}"), loud[back], DISTANCE_DAMPING[back])
        out = out.withColumn("_v", F.when(plain, (v + added) * _negation(back, low)).otherwise(v))
        if back == 3:
            out = out.withColumn("_v", F.when(plain, _idioms(v, low, after)).otherwise(v))

    least = (low[1] == "least") & F.col("_valence1").isNull() & ~low[2].isin("at", "very")
    silent = (word == END) | ((word == "kind") & (after > 0) & (low[-1] == "of"))
    but = F.col("_but")
    contrast = F.when((but >= 0) & (pos < but), 0.5).when((but >= 0) & (pos > but), 1.5).otherwise(1.0)
    return out.select(
        key, pos.alias("pos"), "word", "_emphasis",
        F.when(silent, 0.0).otherwise(v * F.when(least, NEGATE).otherwise(1.0) * contrast).alias("valence"),
    )


def _added(valence: Column, strength: Column, loud: Column, damping: float) -> Column:
    """What a booster or dampener adds, weaker with distance and stronger in capitals."""
    toward = F.when(valence < 0, -damping).otherwise(damping)
    shout = F.when(loud, F.when(valence > 0, CAPS * damping).otherwise(-CAPS * damping)).otherwise(0.0)
    return F.coalesce(strength * toward + shout, F.lit(0.0))


def _negation(back: int, low: dict[int, Column]) -> Column:
    """Factor for a negation ``back`` words earlier."""
    factor = F.when(F.col(f"_negates{back}") | low[back].contains("n't"), NEGATE).otherwise(1.0)
    if back == 1:
        return factor
    stressed = (low[back] == "never") & low[back - 1].isin("so", "this")
    sure = (low[back] == "without") & (low[back - 1] == "doubt")
    if back == 3:
        stressed = stressed | low[1].isin("so", "this")
        sure = sure | ((low[3] == "without") & (low[1] == "doubt"))
    return F.when(stressed, 1.25).when(sure, 1.0).otherwise(factor)


def _idioms(valence: Column, low: dict[int, Column], after: Column) -> Column:
    def phrase(first: int, final: int) -> Column:
        return F.concat_ws(" ", *[low[d] for d in range(first, final - 1, -1)])

    table = F.create_map(*[F.lit(x) for pair in IDIOMS.items() for x in pair])

    def value_of(text: Column) -> Column:
        return F.try_element_at(table, text)

    fixed = F.coalesce(
        F.when(after > 1, value_of(phrase(0, -2))),
        F.when(after > 0, value_of(phrase(0, -1))),
        *[value_of(phrase(a, b)) for a, b in ((1, 0), (2, 0), (2, 1), (3, 1), (3, 2))],
        valence,
    )
    dampened = [F.when(phrase(a, b).isin(DAMPENER_PHRASES), BOOST).otherwise(0.0) for a, b in ((3, 1), (3, 2), (2, 1))]
    return reduce(lambda value, cut: value - cut, dampened, fixed)


def _compound(total: Column) -> Column:
    return F.round(total / F.sqrt(total * total + ALPHA), 4)


def _labelled(scores: DataFrame) -> DataFrame:
    _, positive, negative, _ = settings.PROVIDERS[0]
    return scores.withColumn("label", label_for(F.col("score"), F.lit(positive), F.lit(negative)))


def lexicon_scores(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, hits, score (-1..1), label. One narrow row per text is shuffled."""
    sums = sentiment_words(df, key, text, lexicon).groupBy(key).agg(
        F.sum("valence").alias("total"), F.max("_emphasis").alias("emphasis"), (F.count("*") - 1).alias("hits")
    )
    total, emphasis = F.col("total"), F.col("emphasis")
    loud = F.when(total > 0, total + emphasis).when(total < 0, total - emphasis).otherwise(0.0)
    return _labelled(sums.select(key, "hits", _compound(loud).alias("score")))


def lexicon_scores_plain(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """The valence sum alone, without the modifier rules."""
    tokens = df.select(key, F.explode_outer(F.transform(_tokens(F.col(text)), F.lower)).alias("_key"))
    sums = tokens.join(_words(lexicon), F.col("_key") == F.col("word")).groupBy(key).agg(
        F.sum("valence").alias("total"), (F.count("*") - 1).alias("hits")
    )
    return _labelled(sums.select(key, "hits", _compound(F.col("total")).alias("score")))


def providers(spark: SparkSession) -> DataFrame:
    """Thresholds and switches per provider."""
    return spark.createDataFrame(
        settings.PROVIDERS, "provider string, positive_threshold double, negative_threshold double, model_name string"
    ).withColumns({
        "fallback_enabled": F.lit(settings.FALLBACK_ENABLED),
        "supported_languages": F.lit(",".join(settings.SUPPORTED_LANGUAGES)),
    })


def label_by_provider(scores: DataFrame, provider_table: DataFrame) -> DataFrame:
    """Label each (provider, score) by its provider's own bounds; an unknown provider counts as the lexicon."""
    known = [p[0] for p in settings.PROVIDERS]
    name = F.upper("provider")
    rows = scores.withColumn("_name", F.when(name.isin(known), name).otherwise(settings.LEXICON_PROVIDER))
    bounds = F.broadcast(provider_table.select(
        F.col("provider").alias("_name"), "positive_threshold", "negative_threshold"
    ))
    label = label_for(F.col("score"), F.col("positive_threshold"), F.col("negative_threshold"))
    return rows.join(bounds, "_name").withColumn("label", label).drop("_name")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def model_text(text: Column, max_bytes: int = settings.MODEL_MAX_TEXT_BYTES) -> Column:
    """What an external model is sent: at most max_bytes/4 characters of an oversized text."""
    return F.when(F.octet_length(text) > max_bytes, F.substring(text, 1, max_bytes // 4)).otherwise(text)


def sentiment_with_fallback(
    lexicon_scored: DataFrame,
    model_scores: DataFrame,
    key: str,
    provider: str = settings.MODEL_PROVIDER,
    fallback: bool = settings.FALLBACK_ENABLED,
) -> DataFrame:
    """Provider choice over score tables.

    ``lexicon_scored`` has key, blank, score, label for every text (blank: nothing but white
    space, told where the text is scanned, so that no text is joined); ``model_scores``
    has key, score, magnitude for the texts the model answered. A text the model
    did not answer gets the lexicon's result (or neutral 0 without fallback).
    Blank texts are neutral 0 without magnitude.
    """
    wants_model = provider.upper() == settings.MODEL_PROVIDER
    _, positive, negative, _ = settings.PROVIDERS[1]
    blank = F.coalesce(F.col("blank"), F.lit(True))
    if not wants_model:
        return lexicon_scored.select(
            key, F.when(blank, 0.0).otherwise(F.col("score")).alias("score"),
            F.lit(None).cast("double").alias("magnitude"),
            F.when(blank, "neutral").otherwise(F.col("label")).alias("label"),
            F.lit(settings.LEXICON_PROVIDER).alias("provider_used"),
        )
    answers = model_scores.select(
        key, F.col("score").alias("_model"), F.col("magnitude").alias("_magnitude"), F.lit(True).alias("_answered")
    )
    rows = lexicon_scored.join(answers, key, "left")
    answered = F.col("_answered").isNotNull()
    spare_score, spare_label = (F.col("score"), F.col("label")) if fallback else (F.lit(0.0), F.lit("neutral"))
    return rows.select(
        key,
        F.when(blank, 0.0).when(answered, F.col("_model")).otherwise(spare_score).alias("score"),
        F.when(~blank & answered, F.col("_magnitude")).alias("magnitude"),
        F.when(blank, "neutral")
        .when(answered, label_for(F.col("_model"), F.lit(positive), F.lit(negative)))
        .otherwise(spare_label).alias("label"),
        F.when(answered | blank, settings.MODEL_PROVIDER)
        .otherwise(settings.LEXICON_PROVIDER if fallback else "NONE").alias("provider_used"),
    )
