"""Validation: each row gets the list of rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions.text import strip, url_domain, url_scheme

LABELS = ["positive", "negative", "neutral"]


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds; NULL conditions count as not broken."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def validate_articles(articles: DataFrame) -> DataFrame:
    """Adds ``violations``; optional columns are checked only where present."""
    c = F.col
    rules = {
        "title_blank": F.coalesce(strip(c("title")) == "", F.lit(True)),
        "title_too_long": F.char_length("title") > 255,
        "description_too_long": F.char_length("description") > 1000,
        "url_invalid": ~F.coalesce(url_scheme(c("url")).isin("http", "https") & (url_domain(c("url")) != ""), F.lit(False)),
        "image_url_invalid": (c("image_url") != "") & ~c("image_url").rlike("^https?://"),
        "published_at_missing": c("published_at").isNull(),
        "language_length": F.char_length("language") != 2,
        "country_length": F.char_length("country") != 2,
        "category_too_long": F.char_length("category") > 50,
    }
    if "sentiment_label" in articles.columns:
        rules["label_unknown"] = ~c("sentiment_label").isin(LABELS)
        rules["score_out_of_range"] = ~c("sentiment_score").between(-1.0, 1.0)
    return articles.withColumn("violations", _broken(rules))


def valid(checked: DataFrame) -> DataFrame:
    """The accepted rows, titles trimmed."""
    return checked.filter(F.size("violations") == 0).drop("violations").withColumn("title", strip(F.col("title")))


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)


def validate_sources(names: DataFrame) -> DataFrame:
    """Adds the stored form ``normalized`` and the broken rules of each requested name."""
    lowered = F.lower(strip(F.col("name")))
    return names.withColumn("normalized", lowered).withColumn(
        "violations",
        _broken({
            "name_missing": F.col("name").isNull() | (F.col("name") == ""),
            "name_blank": (F.col("name") != "") & (lowered == ""),
            "name_too_long": F.char_length("name") > 255,
            "name_has_space": lowered.contains(" "),
        }),
    )
