import re

import pytest

from wakeline.llm import boilerplate, quality
from wakeline.llm.queries import SQL

DOCS = "doc_id long, text string, source string"


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one two three",
    "a b c d e f g h i " * 5,
    "a b c d e f g h x a b c d e f g h",
    "line\n\nline\nline \n<b>$5</b> 100% | é ü 😀",
    "same " * 9,
    " ".join(f"w{i}" for i in range(5000)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9",
]


def test_base_figures(spark):
    rows = [(i, t, None) for i, t in enumerate([*TEXTS, TEXTS[4]])]
    got = {r["doc_id"]: r["quality"] for r in quality.line_clean(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, _ in rows:
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == base(t), t
        assert q["kept"] is not None


def test_lines_and_verdict(spark):
    good = "This line has a number of words that differ, and it ends as it should."
    text = [good, "Home | About | News | Contact | Help", "BUY NOW BUY CHEAP BUY MORE TODAY", "### *** $$$ %%%", "Licensed under the Apache License, Version 2.0.", "", good[::-1]]
    bad = "\n".join(text[1:4] * 3 + [good])
    rows = [(0, "\n".join(text), "s"), (1, bad, "s")]
    got = {r["doc_id"]: r["quality"] for r in quality.line_clean(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0]["clean_text"] == "\n".join([good, "", good[::-1]]) and got[0]["n_failed_lines"] == 4
    assert not got[1]["kept"]


def test_quality_follows_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    q = quality.line_clean(docs).select("doc_id", "quality.kept", "quality.base_failed").join(labels, "doc_id").collect()
    clean = [r for r in q if r["quality"] == 1 and not r["base_failed"]]
    poor = [r for r in q if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean) and sum(r["kept"] for r in poor) <= 0.1 * len(poor)


def test_quality_empty_and_clash(spark):
    df = spark.createDataFrame([(1, "x", "s", 5)], DOCS + ", quality int")
    assert quality.line_clean(df).columns.count("quality") == 1
    assert quality.line_clean(df.limit(0)).count() == 0


def drop(spark, rows, **options):
    return {r["doc_id"]: (r["b"]["n_lines"], r["b"]["n_dropped"], r["b"]["text"]) for r in boilerplate.drop_boilerplate(spark.createDataFrame(rows, DOCS), out="b", **options).collect()}


def test_drop_boilerplate(spark):
    rows = [(i, f"menu\nown {i}\n menu ", "a") for i in range(4)] + [(9, None, "a"), (10, "menu\nown", "b"), (11, "", None), (12, "x\nx", None), (13, "x", None), (14, "x\n\ny", None)]
    got = drop(spark, rows, max_ratio=0.5, min_pages=3)
    assert got[0] == (3, 2, "own 0") and got[9] == (1, 0, None)
    assert got[10] == (2, 0, "menu\nown")  # one page of this host
    assert got[11] == (1, 0, "") and got[12] == (2, 2, "") and got[14] == (3, 1, "\ny")


def test_ratio_is_exclusive_and_tables_may_be_empty(spark):
    rows = [(i, "m" if i < 5 else f"{i}", "a") for i in range(10)]
    assert all(n == 0 for _, n, _ in drop(spark, rows, max_ratio=0.5).values())
    assert sum(n for _, n, _ in drop(spark, rows, max_ratio=0.49).values()) == 5
    empty = spark.createDataFrame([], DOCS + ", host string, line_key int, n_pages int")
    assert boilerplate.drop_boilerplate(empty).count() == 0


def test_line_dedup_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    from wakeline.llm.queries import QUERIES

    columns = ["doc_id", "source", "n_lines", "n_dropped", "text"]
    want = con.execute(f"select {', '.join(columns)} from ({SQL['op4_line_dedup']})").fetchall()
    got = [tuple(r) for r in QUERIES["op4_line_dedup"](spark, sf_dir).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("text,n", [("a" * 70_000, 1), ("a " * 30_000, 30_000)])
def test_very_long(spark, text, n):
    q = quality.line_clean(spark.createDataFrame([(1, text, "s")], DOCS)).select("quality.n_words").first()
    assert q[0] == n


def plain_verdict(text):
    """(n_failed_lines, lost_chars, clean text) by the default line rules."""
    r, kept, failed = quality.LineRules(), [], []
    solid = lambda x: len(re.sub(r"[\x20\x09-\x0D]+", "", x))
    for line in (text or "").split("\n"):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        bad = sum(c in r.marks for c in line) > r.max_mark_share * len(line)
        bad |= sum(c in r.navigation for c in line) >= r.min_separators
        bad |= n >= r.sentence_words and not any(c in r.sentence_marks for c in line)
        bad |= len(line) >= r.shout_chars and line.upper() == line and line.lower() != line
        bad |= len(line) <= r.max_boilerplate_chars and bool(re.search(r.boilerplate, line, re.ASCII))
        (failed if n and bad else kept).append(line)
    return len(failed), sum(map(solid, failed)), "\n".join(kept)


def test_verdict_equals_plain_rules(spark):
    extra = [None, "", " \n\t\n", "A" * 30, "a | b | c | d\nplain text here.", "word " * 80, "word " * 80 + ".", "Click here\nfine line", "#####\nok", "x\n" * 2000]
    given = extra + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for row in quality.line_clean(df).collect():
        q = row["quality"]
        n, lost, clean = plain_verdict(given[row["doc_id"]])
        assert (q["n_failed_lines"], q["lost_chars"], q["clean_text"]) == (n, lost, clean), given[row["doc_id"]]
        assert q["base_failed"] == (q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"])
        assert q["kept"] == (not q["base_failed"] and lost <= 0.5 * q["word_chars"])
