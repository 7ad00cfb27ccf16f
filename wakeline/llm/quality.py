"""Line-first quality cleaning, in built-in functions only.

Every line of a document is judged by rules on its punctuation, on navigation
and on boilerplate. Lines that fail are removed, and a document that loses too
much of its text that way is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import WORD_CHAR, char_class, let, n_of, n_solid, text_of, words


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the document verdict."""

    #: A line whose share of these characters is larger fails.
    marks: str = "#*$%&|<>{}[]=~^_\\@!"
    max_mark_share: float = 0.1
    #: A line of this many words or more needs a sentence mark somewhere.
    sentence_words: int = 60
    sentence_marks: str = ".!?…:;。！？"
    #: A line with so many separators of menu items or more is navigation.
    navigation: str = "|»›•·"
    min_separators: int = 3
    #: Lines up to so many characters that hold one of these phrases are boilerplate.
    boilerplate: str = (
        "(?i)\\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript"
        "|lorem ipsum|click here|sign up|log in|subscribe now|licensed under|released under|copyright (?:\\(c\\)|©))"
    )
    max_boilerplate_chars: int = 200
    #: A line of so many characters or more without a lower case letter is shouting.
    shout_chars: int = 20
    #: Share of the non-space characters that a kept document may lose.
    max_loss: float = 0.5


def repeated_window_words(ws: Column, k: int = 8) -> Column:
    """Words inside a `k`-word window that occurs twice or more in the array.

    Windows are told apart by 64-bit hashes. The sort that finds where repeats
    lie runs only for rows that hold any.
    """

    def starts(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda j, other: F.coalesce(F.get(s, j)["h"] == F.get(s, other)["h"], F.lit(False))
            where = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.sort_array(F.transform(where, lambda j: F.get(s, j)["i"]))

        return let(by_hash, repeated)

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("total"))
        step = lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(k), x - a["last"])).alias("total"))
        return F.aggregate(at, zero, step, lambda a: a["total"])

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(starts(h))))
        return F.when(F.size(w) <= k, F.lit(0)).otherwise(found)

    return let(ws, count).cast("long")


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with a word breaks one of the rules."""
    length = F.length(line)
    punctuation = n_of(line, rules.marks) > rules.max_mark_share * length
    navigation = n_of(line, rules.navigation) >= rules.min_separators
    unpunctuated = ~line.rlike(char_class(rules.sentence_marks)) & (F.size(words(line)) >= rules.sentence_words)
    shouting = (length >= rules.shout_chars) & (F.upper(line) == line) & (F.lower(line) != line)
    boilerplate = (length <= rules.max_boilerplate_chars) & line.rlike(rules.boilerplate)
    return punctuation | navigation | unpunctuated | shouting | boilerplate


def line_clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), out: str = "quality") -> DataFrame:
    """Add struct column `out` with the base figures, the verdict and the clean text.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_failed_lines, lost_chars, clean_text, base_failed, kept. A null text is an
    empty one: no words, base_failed, not kept, clean_text ''. Lines without a
    word pass the rules and stay. Repeated rows are judged alike, each on its
    own; other columns pass through (one named as `out` is replaced).
    """
    t = text_of(F.col(text))
    lines = F.split(t, "\n", -1)
    worded = lambda x: x.rlike(WORD_CHAR)

    def verdict(ws: Column, ls: Column, fails: Column) -> Column:
        n = F.size(ws)
        kept_lines = F.filter(ls, lambda _, i: ~F.get(fails, i))
        failed_lines = F.filter(ls, lambda _, i: F.get(fails, i))
        base = F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            n_of(t, "#*$%&|<>").cast("long").alias("n_symbols"),
            let(F.filter(ls, worded), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_window_words(ws).alias("n_repeat_words"),
            F.size(ls).alias("n_lines"),
            F.size(failed_lines).alias("n_failed_lines"),
            n_solid(F.array_join(failed_lines, "")).cast("long").alias("lost_chars"),
            F.array_join(kept_lines, "\n").alias("clean_text"),
        )

        def judged(b: Column) -> Column:
            failed = (b["n_words"] < 20) | (b["n_repeat_words"] * 100 > b["n_words"] * 30)
            kept = ~failed & (b["lost_chars"] <= rules.max_loss * b["word_chars"])
            return b.withField("base_failed", failed).withField("kept", kept)

        return let(base, judged)

    fails = lambda ls: F.transform(ls, lambda x: worded(x) & line_fails(x, rules))
    judged = F.transform(F.array(words(t)), lambda ws: let(lines, lambda ls: let(fails(ls), lambda fs: verdict(ws, ls, fs))))
    # a generator of the one verdict: no filter on it makes Spark compute it a second time
    return docs.withColumn(out, F.explode(judged))
