"""Asset fundamentals: entity resolution, nested records, sentiment and engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normalize import without_digits
from tidemark.plans.series import cut
from tidemark.plans.store import small, stored

#: A small open lexicon of values in [-1, 1], words that strengthen or weaken what follows, and words that turn it round. An approximation of larger lexica.
LEXICON = {"good": 0.7, "great": 0.8, "best": 1.0, "nice": 0.6, "love": 0.5, "gain": 0.4, "bad": -0.7, "worst": -1.0, "hate": -0.8, "loss": -0.4, "idiot": -0.8, "worthless": -0.8, "pathetic": -1.0, "clown": -0.4}
MODIFIERS = {"very": 1.3, "really": 1.2, "extremely": 1.5, "so": 1.2, "too": 1.1, "quite": 0.9, "rather": 0.8, "slightly": 0.5, "barely": 0.3, "not": -0.5, "no": -0.5, "never": -0.5}

#: Bytes of messages that are numbered in one range, about.
SEGMENT_BYTES = 64 << 20


def token_score(coin_id: Column, coin_name: Column, ticker: Column) -> tuple[Column, Column, Column]:
    """How well a coin's id and name go with a ticker, and how plain its id is; more is better, and they compare in this order.

    Fixed values: 100 if the ticker is one of the words of the id (cut at hyphens) or name (at white space) and 50 otherwise, less one for each word; and 100 less one for each
    character of the id and for each that is no letter or digit.
    """
    t, words = F.lower(ticker), lambda x, at: F.array_remove(F.split(F.lower(x), at), "")
    by = lambda w: F.when(F.array_contains(w, t), 100).otherwise(50) - F.size(w)
    odd = F.length(F.regexp_replace(coin_id, r"[\p{L}\p{N}]", ""))
    return by(F.split(F.lower(coin_id), "-")), by(words(coin_name, r"\s+")), 100 - odd - F.length(coin_id)


def coin_index(coins: DataFrame) -> DataFrame:
    """The best coin for each ticker: ``token`` (its symbol in lower case), ``id``. Of equal scores the first by ``position`` wins.

    A coin is only weighed for the ticker that it has, so this is one aggregation over the coins, whatever the number of tickers.
    """
    scores = token_score(F.col("id"), F.col("name"), F.col("symbol"))
    weighed = coins.select(F.lower("symbol").alias("token"), F.struct(*[x.alias(f"s{k}") for k, x in enumerate(scores)], (-F.col("position")).alias("first"), "id").alias("c"))
    return weighed.where("token IS NOT NULL").groupBy("token").agg(F.max("c")["id"].alias("id"))


def resolve(tickers: DataFrame, coins: DataFrame) -> DataFrame:
    """The coin of each distinct ``ticker``: ``ticker``, ``id`` (null if there is none) and ``step``, 1 for its own spelling, 2 without leading digits.

    Only tickers that the first look-up doesn't find, and that begin with a digit, go to the second one. ``coins`` have ``id``, ``symbol``, ``name`` and ``position``.
    """
    index, asked = stored(coin_index(coins), "coins"), tickers.select("ticker").where("ticker IS NOT NULL").distinct()
    first = asked.join(index, F.lower("ticker") == F.col("token"), "left").select("ticker", "id")
    again = first.where(F.col("id").isNull() & F.col("ticker").rlike("^[0-9]")).select("ticker", F.lower(without_digits(F.col("ticker"))).alias("token"))
    second = again.join(index, "token").select("ticker", F.col("id").alias("other"))
    both = first.join(second, "ticker", "left")
    return both.select("ticker", F.coalesce("id", "other").alias("id"), F.when(F.col("id").isNotNull(), 1).when(F.col("other").isNotNull(), 2).alias("step"))


def one_instrument(instruments: DataFrame, base: str, quote: str, position: str) -> DataFrame:
    """One instrument per base asset: one not quoted in USDT goes first, then the later one."""
    place = F.row_number().over(Window.partitionBy(base).orderBy(F.desc(F.col(quote) != "USDT"), F.desc(position)))
    return instruments.withColumn("_place", place).where("_place = 1").drop("_place")


def polarity(text: Column) -> Column:
    """Mean value of the lexicon's words in a text, 0 without any; an expression of built-in functions.

    A fold over the words carries what the modifiers since the last other word make of the next one: ``not very good`` is -0.5 * 1.3 * 0.7. A word's value stays within
    [-1, 1], and any word that is no modifier ends what was carried.
    """
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    values, factors = table(LEXICON), table(MODIFIERS)
    begin = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(1.0).alias("carry"))

    def step(state: Column, word: Column) -> Column:
        value, factor = F.try_element_at(values, word), F.try_element_at(factors, word)
        own = F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value * state["carry"]))).otherwise(0.0)
        return F.struct(
            (state["total"] + own).alias("total"), (state["n"] + value.isNotNull().cast("int")).alias("n"),
            F.when(factor.isNotNull(), state["carry"] * factor).otherwise(F.lit(1.0)).alias("carry"),
        )

    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    return F.aggregate(words, begin, step, lambda s: F.when(s["n"] > 0, s["total"] / s["n"]).otherwise(0.0))


def mean_polarity(texts: DataFrame, by: str, text: str) -> DataFrame:
    """The mean polarity of each group's texts; null for a group that has none."""
    return texts.groupBy(by).agg(F.avg(F.when(F.length(text) > 0, polarity(F.col(text)))).alias("score"))


def present_mean(*scores: Column) -> Column:
    """Mean over the scores that are there; 0 if none is."""
    there = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)).otherwise(0.0)


def both_halves(tokens: DataFrame, profile: DataFrame, activity: DataFrame, key: str) -> DataFrame:
    """Tokens with a platform's profile and activity, or with neither if either half is missing."""
    return tokens.join(profile.join(activity, key), key, "left")


def engagement(tweets: DataFrame, by: str, likes: str, shares: str, replies: str) -> DataFrame:
    total = F.sum(F.col(likes) + F.col(shares) + F.col(replies))
    return tweets.groupBy(by).agg(F.coalesce(F.try_divide(total, F.count("*")), F.lit(0.0)).alias("engagement"))


def post_activity(posts: DataFrame, by: str, comments: str, text: str) -> DataFrame:
    """Posts, comments and the posts' texts (sorted) of each group."""
    return posts.groupBy(by).agg(F.count("*").alias("posts"), F.sum(comments).alias("comments"), F.sort_array(F.collect_list(text)).alias("texts"))


def message_activity(messages: DataFrame, by: str, text: str) -> DataFrame:
    """The messages that have a text, each with how many its group has (``n``); they stay rows, as a group may have any number. A null group is a group."""
    there = messages.where(F.length(text) > 0)
    sums = stored(there.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n")), "messages")
    return there.join(small(sums), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def message_list(messages: DataFrame, by: str, text: str, tie: list[str], segments: int | None = None) -> DataFrame:
    """The texts of each group as a sorted list, one row a text with its ``place`` from 1; with how many they are (``n``) and their characters in all (``n_chars``).

    Places are counted in ranges of (group, text, ``tie``) (``plans/series``), so neither a group nor one frequent text is read in one task. A null group is a group.
    """
    rows = messages.where(F.length(text) > 0).select(
        F.col(by).isNull().alias("_none"), F.coalesce(F.col(by), F.lit("")).alias("_by"), F.struct(F.col(text).alias("text"), *[F.col(c).alias(f"tie{k}") for k, c in enumerate(tie)]).alias("_at")
    )
    if segments is None:
        segments = (rows.agg(F.sum(F.octet_length("_at.text") + 64)).first()[0] or 0) // SEGMENT_BYTES + 1
    s = cut(rows, ["_none", "_by"], "_at", segments)
    starts = s.handed(s.spans, lambda chain: [(sum(r["n"] for r in chain[:i]),) for i in range(len(chain))], "before long")
    place = F.row_number().over(s.within()) + F.coalesce("before", F.lit(0))
    placed = s.with_carried(s.rows, starts, "before long").select("_none", "_by", place.alias("place"), F.col("_at.text").alias("_text"))
    sums = rows.groupBy("_none", "_by").agg(F.count("*").alias("n"), F.sum(F.length("_at.text")).alias("n_chars"))
    return placed.join(small(sums), ["_none", "_by"]).select(F.when(~F.col("_none"), F.col("_by")).alias(by), "n", "n_chars", "place", F.col("_text").alias(text))


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """One row per parent with its children as a sorted array; none gives an empty one."""
    listed = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))


def map_rows(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Map entries as rows, without those of an empty key or value."""
    return rows.select(*keep, F.explode(column).alias("key", "value")).where((F.length("key") > 0) & (F.length("value") > 0))


def recent(items: DataFrame, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """Items no older than so many hours; those without a time are left out."""
    return items.where(F.col(ts) >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
