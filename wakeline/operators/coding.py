"""From destination texts to port codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.destination import clean_destination, code_candidates, country_prefix, is_numeric_text, is_valid_destination, last_word, noise_full, noise_part
from wakeline.operators.carry import known_ship
from wakeline.sources.staging import staged

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def split_valid(df: DataFrame, column: str = "destination") -> tuple[DataFrame, DataFrame]:
    """(valid rows, all other rows)."""
    valid = is_valid_destination(F.col(column))
    return df.filter(valid), df.filter(~valid)


def coding_counts(df: DataFrame, column: str = "destination") -> DataFrame:
    valid = is_valid_destination(F.col(column))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"))


def registered_lookup(df: DataFrame, registered: DataFrame) -> DataFrame:
    """Add `registered_code`; of several rows for a text the greatest code counts, as no row may multiply."""
    one = registered.groupBy("clean_dest").agg(F.max("portcode").alias("registered_code"))
    return df.join(one, "clean_dest", "left")


def match_code(texts: DataFrame, ports: DataFrame, column: str = "clean_dest", out: str = "matched_code") -> DataFrame:
    """Rows (column, out) of distinct texts: the first candidate of five characters that is a known code, else null."""
    distinct = texts.select(column).filter(F.col(column).isNotNull()).distinct()
    tries = distinct.select(column, F.posexplode(code_candidates(F.col(column))).alias("try", "candidate")).filter(F.length("candidate") == 5)
    codes = ports.select(F.col("portcode"), F.col("pos"))
    hits = tries.join(codes, F.upper("candidate") == codes["portcode"]).groupBy(column).agg(F.min_by("portcode", F.struct("try", "pos")).alias(out))
    return distinct.join(hits, column, "left")


def match_name(texts: DataFrame, ports: DataFrame, column: str = "clean_dest") -> DataFrame:
    """Rows (column, pos, portcode) of distinct texts: the wider search over codes, countries, cities and names.

    Words of five letters are codes, of two countries, of three cities, of four
    and more than five part of a name. The first word that hits decides, and of
    its hits the first row of the dictionary; a hit of any later kind replaces a
    code, which in turn stops later words.
    """
    distinct = texts.select(column).filter(F.col(column).isNotNull()).distinct()
    tries = distinct.select(column, F.posexplode(code_candidates(F.col(column))).alias("try", "word")).filter(F.length("word") > 1)
    n, up = F.length("word"), F.upper("word")
    words = tries.select(up.alias("word")).distinct()
    p = ports.select("pos", "portcode", F.upper("country_code").alias("country_code"), F.upper("city_code").alias("city_code"), F.upper("country_name").alias("country_name"), F.upper("city_name").alias("city_name"))
    least = F.min(F.struct("pos", "portcode")).alias("hit")
    by_code = words.filter(n == 5).join(p, F.col("word") == F.upper("portcode")).groupBy("word").agg(least)
    by_country = words.filter(n == 2).join(p, F.col("word") == p["country_code"]).groupBy("word").agg(least)
    by_city = words.filter(n == 3).join(p, F.col("word") == p["city_code"]).groupBy("word").agg(least)
    by_name = names_holding(words.filter((n >= 4) & (n != 5)), p).groupBy("word").agg(least)
    hits = by_code.union(by_country).union(by_city).union(by_name)
    found = tries.withColumn("word", up).join(hits, "word").groupBy(column).agg(F.min_by("hit", "try").alias("hit"))
    return distinct.join(found, column, "left").select(column, "hit.pos", "hit.portcode")


def names_holding(words: DataFrame, ports: DataFrame) -> DataFrame:
    """Rows (word, pos, portcode): the ports whose country or city name holds the word, of three letters or more.

    A name that holds a word holds all of its trigrams. The one that fewest
    different names hold leads to the names to look into; words with a trigram
    that no name holds go at once.
    """
    names = ports.select(F.explode(F.array("country_name", "city_name")).alias("name"), "pos", "portcode").filter(F.col("name").isNotNull())
    distinct = names.select("name").distinct()
    grams = staged(distinct.select("name", F.explode(trigrams(F.col("name"))).alias("gram")), "name_grams")
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    asked = words.select("word", F.explode(trigrams(F.col("word"))).alias("gram")).join(held, "gram", "left")
    rarest = asked.groupBy("word").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("r")).filter("r.held > 0")
    found = rarest.select("word", "r.gram").join(grams, "gram").filter(F.contains(F.col("name"), F.col("word"))).select("word", "name")
    # a country's name stands for many ports: the first of each name is all that is asked for
    first = names.groupBy("name").agg(F.min(F.struct("pos", "portcode")).alias("first"))
    return found.join(first, "name").select("word", "first.pos", "first.portcode")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; none of a shorter text."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def by_rarity(sets: DataFrame, ports: DataFrame, key: str) -> DataFrame:
    """Rows (key, n, gram, at) of rows (key, grams): the grams of each set from the one that fewest ports hold to the one that most do."""
    frequency = ports.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rows = sets.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(frequency, "gram", "left")
    order = Window.partitionBy(key).orderBy(F.coalesce("held", F.lit(0)), "gram")
    return rows.select(key, "n", "gram", F.row_number().over(order).alias("at"), F.col("held").isNotNull().alias("met"))


def prefix_pairs(texts: DataFrame, ports: DataFrame) -> DataFrame:
    """Rows (clean_dest, pos), each once, of rows (clean_dest, n, gram, at, least) and (pos, n, gram, at): the pairs that can be as alike as `least`.

    Sets with a Jaccard similarity of t share one of the first n - ceil(t n) + 1
    grams of either, in any one order; with the rare ones first few pairs meet.
    Their sizes also differ by a factor of 1 / t at most.
    """
    p = ports.select("pos", "gram", F.col("n").alias("m"), F.col("at").alias("port_at"))
    # a little less than `least`, so that rounding loses no pair
    t = F.col("least") - 1e-9
    prefix = lambda n: F.col(n) - F.ceil(t * F.col(n)) + 1
    met = texts.join(p, "gram").filter((F.col("at") <= prefix("n")) & (F.col("port_at") <= prefix("m")) & (t * F.col("n") <= F.col("m")) & (t * F.col("m") <= F.col("n")))
    return met.select("clean_dest", "pos").distinct()


def ngram_scorer(texts: DataFrame, ports: DataFrame, steps: tuple[float, ...] = (0.6, 0.3, 0.0)) -> DataFrame:
    """Rows (clean_dest, code, confidence): the port whose city's name has the greatest trigram Jaccard similarity, ties by `pos`.

    Confidence is that similarity times 100; texts that share no trigram have
    code null and confidence 0. The similarity asked for falls step by step; a
    text is done as soon as its best port is as alike as that, and what it has
    found by then bounds its next step.
    """
    left = staged(texts.select("clean_dest", trigrams(F.col("clean_dest")).alias("grams")), "texts")
    # of ports with one name, which are as alike to every text, the first counts
    named = ports.groupBy(F.lower("city_name").alias("name")).agg(F.min(F.struct("pos", "portcode")).alias("first"))
    right = staged(named.select("first.pos", "first.portcode", trigrams(F.col("name")).alias("grams")), "ports")
    index = staged(by_rarity(right, right, "pos").drop("met"), "port_grams")
    asked = staged(by_rarity(left, right, "clean_dest").filter("met").drop("met"), "text_grams")
    bound = left.select("clean_dest", F.lit(0.0).alias("least"))
    done, best = None, None
    for step in steps:
        open_ = asked.join(bound.withColumn("least", F.greatest("least", F.lit(step))), "clean_dest")
        pairs = prefix_pairs(open_, index).join(left, "clean_dest").join(right.select("pos", "portcode", F.col("grams").alias("port_grams")), "pos")
        both = F.size(F.array_intersect("grams", "port_grams"))
        scored = pairs.select("clean_dest", "pos", "portcode", (both / (F.size("grams") + F.size("port_grams") - both)).alias("score"))
        best = staged(scored.groupBy("clean_dest").agg(F.min_by(F.struct("portcode", "score"), F.struct((-F.col("score")).alias("s"), "pos")).alias("best")), "best")
        found = best.filter(F.col("best.score") >= step)
        done = found if done is None else done.unionByName(found)
        bound = bound.join(found, "clean_dest", "left_anti").select("clean_dest").join(best, "clean_dest", "left").select("clean_dest", F.coalesce("best.score", F.lit(0.0)).alias("least"))
        bound = staged(bound, "bound")
        if bound.isEmpty():
            break
    joined = texts.join(done, "clean_dest", "left")
    return joined.select("clean_dest", F.col("best.portcode").alias("code"), F.coalesce(F.round(F.col("best.score") * 100, 2), F.lit(0.0)).alias("confidence"))


def plugin_scorer(function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Scorer:
    """A scorer from a pandas iterator function: clean_dest in, (clean_dest, code, confidence) out; it may load a model once for each task."""

    def scorer(texts: DataFrame, ports: DataFrame) -> DataFrame:
        return texts.mapInPandas(function, "clean_dest string, code string, confidence double")

    return scorer


def score_destinations(df: DataFrame, ports: DataFrame, scorer: Scorer = ngram_scorer) -> DataFrame:
    """Add `pred` and `confidence` (0 to 100, two digits). Each distinct text is scored once; blank, short and numeric texts have pred ''."""
    distinct = df.select("clean_dest").filter(F.col("clean_dest").isNotNull()).distinct()
    scores = scorer(distinct, ports).withColumn("confidence", F.round("confidence", 2))
    blank = (F.length(F.trim("clean_dest")) <= 2) | is_numeric_text(F.col("clean_dest"))
    scores = scores.select("clean_dest", F.when(blank, "").otherwise(F.coalesce("code", F.lit(""))).alias("pred"), "confidence")
    return df.join(scores, "clean_dest", "left")


def hybrid_code(df: DataFrame, ports: DataFrame) -> DataFrame:
    """Add `code` and `resolution` to rows with clean_dest, pred and confidence: the ladder of rules, first that fires."""
    d = F.trim("clean_dest")
    df = df.withColumn("__last", last_word(F.col("clean_dest"))).withColumn("__whole", d)
    probes = df.filter(F.length("__whole") == 5).select(F.col("__whole").alias("__probe")).union(df.filter(F.length("__last") == 5).select("__last"))
    codes = match_code(probes, ports, "__probe", "__code").filter(F.col("__code").isNotNull())
    probe = F.when(F.length("__whole") == 5, F.col("__whole")).when(F.length("__last") == 5, F.col("__last"))
    df = df.withColumn("__probe", probe).join(codes, "__probe", "left")
    p, pred = F.col("confidence"), F.col("pred")
    noise = noise_full(F.col("__whole"))
    empty = noise | ((p < 90) & (((p < 50) & noise_part(F.col("__whole"))) | (p <= 10)))
    by_code = (p < 90) & F.col("__code").isNotNull()
    resolution = F.when(noise, "noise").when(p >= 90, "model").when((p < 50) & noise_part(F.col("__whole")), "noise").when(p <= 10, "low").when(by_code, "dictionary").otherwise("model")
    code = F.when(empty, "").when(by_code, F.col("__code")).otherwise(pred)
    return df.withColumn("code", code).withColumn("resolution", resolution).drop("__last", "__whole", "__probe", "__code")


def code_batch(df: DataFrame, ports: DataFrame, scorer: Scorer = ngram_scorer, column: str = "destination") -> DataFrame:
    """Add clean_dest, pred, confidence, code and resolution to every row, valid or not; null text counts as empty.

    Each distinct raw text is cleaned and coded once and joined back to the rows.
    """
    raw = df.select(F.col(column).alias("__raw")).distinct()
    cleaned = staged(raw.withColumn("clean_dest", F.coalesce(clean_destination(F.col("__raw")), F.lit(""))), "cleaned")
    texts = hybrid_code(score_destinations(cleaned.select("clean_dest").distinct(), ports, scorer), ports)
    coded = staged(cleaned.join(texts, "clean_dest"), "coded")
    rows = df.drop(*(c for c in coded.columns if c != column))
    return rows.join(coded, F.col(column).eqNullSafe(F.col("__raw"))).drop("__raw")


def code_texts(texts: DataFrame, ports: DataFrame, registered: DataFrame, scorer: Scorer = ngram_scorer) -> DataFrame:
    """Rows (clean_dest, code, resolution, confidence) of the distinct valid texts: registered ones first, the others by the ladder."""
    found = staged(registered_lookup(texts.select("clean_dest").filter(F.length("clean_dest") >= 3).distinct(), registered), "valid")
    known = found.filter(F.col("registered_code").isNotNull()).select("clean_dest", F.col("registered_code").alias("code"), F.lit("registered").alias("resolution"), F.lit(None).cast("double").alias("confidence"))
    rest = found.filter(F.col("registered_code").isNull()).select("clean_dest")
    return known.unionByName(hybrid_code(score_destinations(rest, ports, scorer), ports).select("clean_dest", "code", "resolution", "confidence"))


def code_raw(df: DataFrame, ports: DataFrame, registered: DataFrame, scorer: Scorer = ngram_scorer, column: str = "destination") -> DataFrame:
    """Rows (__raw, clean_dest, code, resolution, confidence), one for each raw text: the rows are read once, all coding works on these."""
    raw = df.select(F.col(column).alias("__raw")).filter(F.col(column).isNotNull()).distinct()
    cleaned = staged(raw.withColumn("clean_dest", clean_destination(F.col("__raw"))), "cleaned")
    return staged(cleaned.join(code_texts(cleaned, ports, registered, scorer), "clean_dest", "left"), "coded")


def code_destinations(df: DataFrame, ports: DataFrame, registered: DataFrame, scorer: Scorer = ngram_scorer, order: str = "event_id") -> DataFrame:
    """Rows with `dest_code`, `resolution` and `confidence`: registered texts first, the others by the ladder.

    Rows whose destination is not valid keep the code they have. Of several rows
    of a ship the last one counts for all of its valid rows: registered ones
    first, then the others, each in `order`. Ships without a number (null, 0)
    keep the codes of their own rows.
    """
    given = df if "dest_code" in df.columns else df.withColumn("dest_code", F.lit(None).cast("string"))
    coded = code_raw(given, ports, registered, scorer).withColumnRenamed("code", "__code")
    joined = given.drop("clean_dest", "resolution", "confidence").join(coded, F.col("destination") == F.col("__raw"), "left").drop("__raw")
    rank = F.struct((F.col("resolution") != "registered").alias("model"), F.col(order).alias("o"))
    ships = joined.filter(F.col("resolution").isNotNull() & known_ship("mmsi"))
    last = ships.groupBy(F.col("mmsi").alias("__mmsi")).agg(F.max_by(F.struct("__code"), rank).alias("__last"))
    done = joined.join(last, F.col("mmsi") == F.col("__mmsi"), "left")
    final = F.when(F.col("__last").isNull(), F.col("__code")).otherwise(F.col("__last.__code"))
    return done.withColumn("dest_code", F.when(F.col("resolution").isNotNull(), final).otherwise(F.col("dest_code"))).drop("__code", "__mmsi", "__last")


def coding_report(coded: DataFrame) -> DataFrame:
    """A row for each coded row: ship, raw input, cleaned text, code, confidence and how it was found."""
    return coded.filter(F.col("resolution").isNotNull()).select("mmsi", F.col("destination").alias("input"), F.col("clean_dest").alias("destination"), F.col("dest_code").alias("port_code"), F.col("confidence").alias("percent"), "resolution")


def with_country(df: DataFrame, countries: DataFrame, columns: tuple[str, ...] = ("dept_code", "dest_code")) -> DataFrame:
    """Add a struct (country, portCode) for each code column, named without `_code`; what is missing is ''."""
    for column in columns:
        names = countries.select(F.col("country_code").alias("__cc"), F.col("country").alias("__country"))
        place = F.struct(F.coalesce("__country", F.lit("")).alias("country"), F.coalesce(F.col(column), F.lit("")).alias("portCode"))
        df = df.join(names, country_prefix(F.col(column)) == F.col("__cc"), "left").withColumn(column.removesuffix("_code"), place).drop("__cc", "__country")
    return df
