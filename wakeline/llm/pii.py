"""Information-theoretic sanitisation of personal data, in built-in functions only.

Patterns find the protected entities: e-mail and IP addresses, card and phone
numbers. What the corpus tells then decides about the words of their texts: a
term that co-occurs with an entity in other texts far more often than chance would
have it gives the entity away. The share of the entity's information content that
the term discloses is PMI(entity; term) / IC(entity); terms beyond a threshold
become spans of kind `term`. Sanitising generalises entities to their kind and terms to
a mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.store import materialise
from wakeline.llm.text import let, text_of

#: Kinds in the order in which spans with one start are listed.
KINDS = ["email", "ip", "card", "phone", "term"]
#: The patterns of the base kinds, in a form whose work grows with the text only. All places of a run of local
#: characters or of digits match or fail alike, so a match is tried at the start of a run or where the match before
#: ended, and nowhere else; repetitions that what follows cannot begin with are possessive. The matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that do not match hold none of the kind; a cheap look ahead of the pattern.
GUARDS = {"email": "@[A-Za-z0-9-]+\\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Terms are runs of letters, digits and inner marks.
TERM = r"[\p{L}\p{N}]+(?:['’_-][\p{L}\p{N}]+)*+"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
NONE = "array<struct<start:int,end:int,value:string>>"
#: Matches are appended to arrays of so many, and these to one: appending to one long array would copy it each time.
BLOCK = 256


def found(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points, the end exclusive; only of values that fit `keep`."""

    def placed(values: Column, gaps: Column) -> Column:
        n = F.size(values)

        def step(a: Column, i: Column) -> Column:
            begin = a["at"] + F.length(F.get(gaps, i))
            end = begin + F.length(F.get(values, i))
            one = F.struct(begin.alias("start"), end.alias("end"), F.get(values, i).alias("value"))
            more = F.concat(a["out"], F.array(one))
            return F.struct(end.alias("at"), (more if keep is None else F.when(keep(F.get(values, i)), more).otherwise(a["out"])).alias("out"))

        def block(a: Column, j: Column) -> Column:
            start = F.struct(a["at"].alias("at"), F.array().cast(NONE).alias("out"))
            done = F.aggregate(F.sequence(j * BLOCK, F.least(n, (j + 1) * BLOCK) - 1), start, step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(a["out"], F.array(d["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NONE}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), start, block, lambda a: F.flatten(a["out"]))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast(NONE)).otherwise(let(F.split(text, pattern, -1), lambda g: placed(v, g))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def total(d: Column) -> Column:
        twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        values = F.transform(d, lambda c, i: let(c.cast("int"), lambda x: F.when(i % 2 == 1, twice(x)).otherwise(x)))
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    return let(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), total) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(12, 19) & passes_luhn(F.when(F.length(d) <= 19, d).otherwise("1")))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value) of the base kinds, by start and kind (the number in KINDS)."""

    def of_kind(i: int, kind: str) -> Column:
        kept = F.filter(found(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
        spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(text.rlike(GUARDS[kind]), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))

    return F.sort_array(F.concat(*(of_kind(i, kind) for i, kind in enumerate(KINDS[:-1]))))


def term_key(value: Column) -> Column:
    return F.xxhash64(F.lower(value))


def terms_of(text: Column) -> Column:
    """Array of the keys of the terms of a text, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), term_key))


def bit_set(keys: DataFrame, bits: int) -> DataFrame:
    """One row with one array of longs: bit `key mod bits` is set for each of the keys. Its size is `bits`, however many keys there are."""
    at = F.pmod("term", F.lit(bits))
    own = keys.select(F.shiftright(at, 6).alias("word"), at.alias("at")).select("word", F.expr("shiftleft(1L, cast(at & 63 as int))").alias("set"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set")).union(own)
    words = every.groupBy("word").agg(F.bit_or("set").alias("set"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "set"))), lambda w: w["set"]).alias("sets"))


def document_frequency(rows: DataFrame, wanted: DataFrame, bits: int = 2**25) -> DataFrame:
    """Rows (term, n_term): in how many different texts of the whole corpus each of the terms in `wanted` occurs.

    Keys are shuffled, not texts, and of the copies of a text one each. Most terms
    that are not wanted go before the shuffle, by a set of bits of a fixed size
    (4 MB); what it lets through by chance goes in the join, so the result is exact
    whatever the number of wanted terms.
    """
    # hashed before the terms become rows: in one select with the explode the text would be hashed again for each term
    terms = rows.select(F.xxhash64("text").alias("of"), terms_of(F.col("text")).alias("terms")).select("of", F.explode("terms").alias("term"))
    at = F.pmod("term", F.lit(bits))
    sets = bit_set(wanted, bits).scalar()
    may_be = terms.filter(F.getbit(F.get(sets, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return may_be.join(wanted, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing_terms(held: DataFrame, rows: DataFrame, threshold: float, chance: float) -> DataFrame:
    """Rows (text_key, term): the keys of the terms that disclose `threshold` or more of an entity of the text, each once.

    What a text reveals is judged by the other texts alone: of all counts of
    different texts (n, n_entity, n_term, n_both) the text itself is taken off.
    A word met nowhere else, or an entity met nowhere else, thus proves nothing.
    P(entity) = (n_entity - 1 + 1) / (n - 1), P(term) likewise and P(both) =
    (n_both - 1) / (n - 1): the added one makes what was seen seldom prove less.
    Then the number of other texts with both must not be chance: the logarithm of
    its Poisson tail (Chernoff's bound) has to stay below `chance` divided by the
    number of pairs of an entity and a term in the text, so that fewer than
    `chance` terms of a text are expected to be spans by accident, however many
    words it has.

    As n_both is n_entity at most, a term can only count while n_term <=
    (n_entity - 1) * ((n - 1) / n_entity) ** (1 - threshold); others, and what occurs
    in one text only, are left out before terms meet entities, which loses none.
    """
    others = float(rows.select(F.xxhash64("text").alias("of")).distinct().count() - 1)
    content = F.log2(F.lit(others) / F.col("n_entity"))
    of_text = held.select("text_key", F.explode("entities").alias("entity"))
    entities = of_text.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter((F.col("n_entity") > 1) & (content > 0))
    of_text = materialise(of_text.join(entities, "entity"), "entities")
    bound = (F.col("n_entity") - 1) * F.pow(F.lit(others) / F.col("n_entity"), F.lit(1 - threshold))
    per_text = of_text.groupBy("text_key").agg(F.max(bound).alias("most"), F.count(F.lit(1)).alias("n_entities"))
    terms = held.join(per_text, "text_key").select("text_key", "most", (F.col("n_entities") * F.col("n_terms")).alias("tests"), F.explode("terms").alias("term"))
    candidates = materialise(terms.select("term").distinct(), "candidate-terms")
    frequency = materialise(document_frequency(rows, candidates).filter("n_term > 1"), "term-frequency")
    # terms of one text in 200 and more are few; without them no key of the next join is large
    frequent = materialise(frequency.filter(F.col("n_term") > others / 200).select("term", F.col("n_term").alias("n_frequent")), "frequent-terms")
    rare = terms.join(frequent, "term", "left").filter(F.col("n_frequent").isNull() | (F.col("n_frequent") <= F.col("most") + 1e-6)).drop("n_frequent")
    rare = rare.join(frequency, "term").filter(F.col("n_term") <= F.col("most") + 1e-6).select("text_key", "tests", "term", "n_term")
    pairs = materialise(rare.join(of_text, "text_key"), "pairs")
    k, expected = F.col("n_both") - 1, (F.col("n_entity") - 1) * (F.col("n_term") - 1) / F.lit(others)
    pmi = F.log2(k * F.lit(others) / (F.col("n_entity") * F.col("n_term")))
    scored = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both")).filter((k > 0) & (k > expected))
    flagged = scored.filter(pmi / content >= threshold).select("entity", "term", (k * F.log(k / expected) - k + expected).alias("evidence"))
    proved = pairs.join(flagged, ["entity", "term"]).filter(F.col("evidence") >= F.log(F.col("tests") / F.lit(chance)))
    return proved.select("text_key", "term").distinct()


def clear_of(terms: DataFrame, base: DataFrame) -> DataFrame:
    """The rows (text_key, start, end) of `terms` that overlap no row of `base` in their text.

    A term overlaps a base span just when, of those that begin before its end, the
    furthest end lies beyond its start: a running maximum in one sorted pass.
    """
    events = terms.select("text_key", "start", "end", F.col("end").alias("at"), F.lit(0).alias("is_base"))
    events = events.union(base.select("text_key", "start", "end", F.col("start").alias("at"), F.lit(1).alias("is_base")))
    order = Window.partitionBy("text_key").orderBy("at", "is_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("is_base") == 1, F.col("end"))).over(order)
    return events.withColumn("reach", F.coalesce(reach, F.lit(0))).filter("is_base = 0 and reach <= start").select("text_key", "start", "end")


def text_key(text: Column) -> Column:
    """128-bit key of a text; null counts as empty."""
    return F.md5(text_of(text))


def find_spans(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", chance: float = 0.05) -> DataFrame:
    """Rows (doc_id, text_key, base, terms), one for each input row: base spans and the method's own.

    A term becomes a span wherever it stands, outside base spans, in a text that
    holds an entity of which it discloses `threshold` or more, provided that the
    other texts' evidence is no accident (`chance`, see `disclosing_terms`).
    Copies of one text count once and have the same spans, whatever their ids; a
    null id stays null. Null text counts as empty and has no spans; an empty
    table gives an empty one; other columns, also ones named like those of the
    result, are not looked at. Terms with equal scores are all spans: there is
    no ranking. The work grows with the length of a text, and with its
    terms times those of its entities that other texts hold too.
    """
    t = text_of(F.col(text))
    rows = docs.select(F.col(key).alias("doc_id"), text_key(F.col(text)).alias("text_key"), t.alias("text"))
    based = rows.withColumn("base", F.explode(F.array(base_spans(F.col("text")))))  # a generator: computed once, whatever is asked of it
    based = materialise(based.select("doc_id", "text_key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "base-spans")
    own = based.filter(F.size("base") > 0).dropDuplicates(["text_key"])
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    own = own.select("text_key", "text", "base", entities.alias("entities"), terms_of(F.col("text")).alias("terms"))
    held = materialise(own.withColumn("n_terms", F.size("terms")), "entity-texts")  # counted here: beside an explode of the terms each row would carry all of them
    wanted = materialise(disclosing_terms(held, rows, threshold, chance), "disclosing-terms")
    texts = held.join(wanted.select("text_key").distinct(), "text_key", "left_semi")
    met = texts.select("text_key", F.explode(found(F.col("text"), TERM)).alias("t")).select("text_key", "t.start", "t.end", term_key(F.col("t.value")).alias("term"))
    marked = clear_of(met.join(wanted, ["text_key", "term"], "left_semi"), texts.select("text_key", F.explode("base").alias("b")).select("text_key", "b.start", "b.end"))
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")
    placed = marked.groupBy("text_key").agg(F.sort_array(F.collect_list(span)).alias("terms"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return based.select("doc_id", "text_key", "base").join(placed, "text_key", "left").select("doc_id", "text_key", "base", F.coalesce("terms", none).alias("terms"))


def is_kind(i: int):
    """Predicate of spans of the i-th kind."""
    return lambda span: span["kind"] == i


def listed(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(base: Column, terms: Column) -> Column:
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.sort_array(F.concat(plain, terms))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span generalised to the mark of its kind; of overlapping spans the first one's mark stands for all."""
    kind = "array<struct<at:int,start:int,kind:int>>"

    def step(a: Column, s: Column) -> Column:
        one = F.struct(a["at"].alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    def block(a: Column, j: Column) -> Column:
        start = F.struct(a["at"].alias("at"), F.array().cast(kind).alias("out"))
        done = F.aggregate(F.slice(spans, j * BLOCK + 1, F.lit(BLOCK)), start, step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    def joined(a: Column) -> Column:
        mark = lambda i: F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), i + 1)), F.lit(">"))
        parts = F.transform(F.flatten(a["out"]), lambda s: F.concat(F.substring(text, s["at"] + 1, s["start"] - s["at"]), mark(s["kind"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, a["at"] + 1, F.lit(2**31 - 1)))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    done = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), start, block, joined)
    return F.when(F.size(spans) == 0, text).otherwise(done)


def sanitise(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", chance: float = 0.05) -> DataFrame:
    """The rows with entities and disclosing terms in `text` generalised; all other columns as they are.

    Null text stays null, an empty table gives an empty one. What is generalised
    depends on the texts alone, so rows with a null or repeated id are cleaned like
    any other, and other columns keep their values whatever their names.
    """
    found = find_spans(docs, threshold, key, text, chance).select("text_key", all_spans(F.col("base"), F.col("terms")).alias("spans")).filter(F.size("spans") > 0)
    per_text = materialise(found.groupBy("text_key").agg(F.first("spans").alias("spans")), "spans-by-text")
    joined = docs.select(F.struct("*").alias("row"), text_key(docs[text]).alias("text_key")).join(per_text, "text_key", "left")
    clean = F.when(F.col("spans").isNull(), F.col("row").getField(text)).otherwise(sanitised(F.col("row").getField(text), F.col("spans")))
    return joined.select(*(clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
