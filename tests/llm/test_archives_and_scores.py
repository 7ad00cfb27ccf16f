import hashlib
import math
import random
import re
import struct
import zlib
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import pii, toxicity, warc
from wakeline.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    big = "<p>é" + "x" * 1500
    rows = [(1, "http://a", big), (5, "http://b\r\nX: y", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (5, "again", big), (8, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", payload_digest string")
    listed = warc.archive_pages(df, archive_mb=0.001)
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.read_archives(listed).collect()]
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 1000 and html == big and i != 5
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r["n_records"] for r in listed.collect()) == len(rows)
    assert warc.read_archives(warc.archive_pages(df.limit(0))).count() == 0


def test_archive_layout(spark):
    import zstandard

    rows = [(i, f"http://h/{i}", f"<html><body>page {i} " + "common text of the site " * 30) for i in range(200)]
    path = warc.archive_pages(spark.createDataFrame(rows, PAGES).coalesce(1)).first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert dictionary.dict_id()
    record = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + size :])
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and record.endswith(b"\r\n\r\n")
    assert len(glob(path)) == 1


def test_record_ids_are_unique_and_revisits_name_a_record(spark, tmp_path):
    """Repeated and null page ids, repeated rows, a record of 10 MB, and a store that only its own opener knows."""
    big, huge = "<p>" + "y" * 2000, "".join(f"<p>{i}" for i in range(1_200_000))
    rows = [(7, "a", big)] * 3 + [(7, "b", "other"), (None, "c", big), (None, "c", big), (None, "d", "n"), (3, "e", big), (9, "f", huge), (2, "g", huge)]

    def opener(uri):
        return warc.fs.FileSystem.from_uri(uri.replace("store://box", f"file://{tmp_path}"))

    listed = warc.write_archives(warc.plan_records(spark.createDataFrame(rows, PAGES)), "store://box/archives", opener=opener)
    ids, refers = [], []
    for r in listed.collect():
        system, path = opener(r["path"])
        with system.open_input_stream(path, compression=None) as file:
            for record in warc.read_archive(file):
                fields = warc.headers(record.partition(b"\r\n\r\n")[0])
                ids.append(fields["WARC-Record-ID"])
                refers += [fields["WARC-Refers-To"]] if fields["WARC-Type"] == "revisit" else []
    assert len(ids) == len(set(ids)) == len(rows) and len(refers) == 4
    assert set(refers) <= set(ids) and sorted(map(warc.page_of, set(refers))) == [7, 9]
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["refers_to"] or 0) for r in warc.read_archives(listed, opener).collect())
    keeper = {big: 7, huge: 9}
    assert got == sorted((i or 0, len(h), 0 if keeper.get(h, i) == i else keeper[h]) for i, _, h in rows)


def base(text):
    text, out = text or "", []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            luhn = sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
            if (k == 0) or (k == 1 and max(map(int, m[0].split("."))) <= 255) or (k == 2 and 12 <= len(d) <= 19 and luhn) or (k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None,
    "",
    "é😀@b.c a@b.com_c@d.org x@y a@b.c.",
    "1.2.3.4.5 256.1.1.1 001.002.003.0255 999999999999999999999.1.1.1 1.2.3",
    "4737 0976 8429 9439-1 4737097684299439 x4111-1111-1111-1111y",
    "+1 (743) 555-3824x +12 +441234567890 4111111111111111",
    "1" * 5000 + " " + "1 " * 3000,
    "a@b" * 500 + "a@b.c",
    "." * 3000 + "@" + "-" * 50,
]


def test_base_spans(spark):
    given = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + TEXTS[2:3]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(given)], "doc_id long, text string, base int, terms string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in pii.find_spans(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(given)}
    assert pii.find_spans(df.limit(0)).count() == 0


def test_base_spans_of_long_runs(spark):
    given = ["a" * 1_000_000 + " x@y.com", "1" * 300_000 + " 1.2.3.4", "a.a" * 100_000 + "@b.c", "x@" + "a." * 50_000 + "c", "1.2.3." * 5000]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in pii.find_spans(df).collect()}
    assert [len(got[i]) for i in range(5)] == [1, 1, 1, 1, 7500 - 3750] and got[0] == [(1_000_001, 0, 1_000_008)] and got[2] == [(0, 0, 300_004)]
    rng = random.Random(3)
    fuzz = ["".join(rng.choice("ab1 9.@-_%+()é\n") for _ in range(rng.randrange(60))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(fuzz)), "doc_id long, text string")
    found = df.select("doc_id", pii.base_spans(F.col("text")).alias("base")).collect()
    assert all([(s["start"], s["kind"], s["end"]) for s in r["base"]] == base(fuzz[r["doc_id"]]) for r in found)


WORDS = r"[^\W_]+(?:['’_-][^\W_]+)*"


def plain_terms(texts, threshold=0.8, chance=0.05):
    """The disclosing terms of each different text, counted by walking all texts."""
    terms = {t: {w.lower() for w in re.findall(WORDS, t)} for t in texts}
    mails = {t: {m.lower() for m in re.findall(r"\S+@\S+", t)} for t in terms}
    others, wanted = len(terms) - 1, {}
    for t in terms:
        tests = 0
        hits = []
        for e in mails[t]:
            n_e = sum(e in mails[u] for u in terms)
            if n_e < 2 or n_e >= others:
                continue
            tests += len(terms[t])
            for w in terms[t]:
                n_w, k = sum(w in terms[u] for u in terms), sum(w in terms[u] and e in mails[u] for u in terms) - 1
                expected = (n_e - 1) * (n_w - 1) / others
                if k > expected and math.log2(k * others / (n_e * n_w)) / math.log2(others / n_e) >= threshold:
                    hits.append((w, k * math.log(k / expected) - k + expected))
        wanted[t] = {w for w, evidence in hits if evidence >= math.log(tests / chance)}
    return wanted


def test_terms_equal_brute_force(spark):
    rng = random.Random(6)
    names = [f"Name{i}" for i in range(30)]
    rows = []
    for i in range(160):
        words = [rng.choice(names + ["and", "the"]) for _ in range(8)]
        if i % 5 == 0:
            words.insert(rng.randrange(8), f"m{i % 7}@ex.org")
            words.insert(rng.randrange(8), f"Owner{i % 7 if i % 25 else i % 3}")
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[5][1]) for i in range(4)] + [(600, "once@ex.org is of Hapax")]
    wanted = plain_terms([t for _, t in rows])
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text_of, marked = dict(rows), 0
    assert len(got) == len(rows)
    for r in got:
        t = text_of[r["doc_id"]]
        inside = lambda m: any(s["start"] < m.end() and m.start() < s["end"] for s in r["base"])  # noqa: E731, B023
        want = [(m.start(), m.end()) for m in re.finditer(WORDS, t) if m[0].lower() in wanted[t] and not inside(m)]
        assert [(s["start"], s["end"]) for s in r["terms"]] == want
        marked += len(want)
    assert marked > 20


def test_disclosing_terms(spark):
    rows = [(i, f"Please reach Zorntal via zt@ex.org now word{i} and then") for i in range(5)]
    rows += [(i, f"please reach others now via and then number{i}") for i in range(5, 60)]
    rows += [(60 + i, "Copied Quamble wrote q@ex.org here") for i in range(4)] + [(99, "Zorntal is far from here")] + [(None, None), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] == "Please reach <TERM> via <EMAIL> now word0 and then"
    assert clean[60] == "Copied Quamble wrote <EMAIL> here"  # copies of one text prove nothing
    assert clean[99] == rows[-3][1] and clean[100] is None and len(clean) == len(rows)


def test_terms_need_other_texts(spark):
    filler = "please reach others now via and then"
    far = " ".join([filler] * 5)
    rows = [(i, f"Zorntal {far} 'zt' wrote{i} _zorntal_ by zt@ex.org {far} Zorntal") for i in range(3)]
    rows += [(3, f"Quamble {far} q@ex.org Quamble")] + [(i, f"{filler} wrote by number{i}") for i in range(4, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    # terms far from the entity and with marks around them; of an entity in one text no word is known to disclose it
    for i in range(3):
        assert clean[i] == f"<TERM> {far} '<TERM>' wrote{i} _<TERM>_ by <EMAIL> {far} <TERM>"
    assert clean[3] == rows[3][1].replace("q@ex.org", "<EMAIL>")
    assert all(clean[i] == t for i, t in rows[4:])


def test_planted_names_are_found_and_clean_words_stay(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rows = [(i, f"{t} Zorn{i % 40}tal wrote by zt{i % 40}@ex.org" if i % 7 == 0 else t) for i, t in enumerate(docs)]
    planted = {i for i, _ in rows if i % 7 == 0}
    names = n_clean = n_lost = 0
    for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = rows[r["doc_id"]][1]
        marked = [t[s["start"] : s["end"]] for s in r["terms"]]
        own = [w for w in marked if re.fullmatch(r"Zorn\d+tal", w)]
        names += len(own) if r["doc_id"] in planted else 0
        if r["base"]:
            n_clean += len(re.findall(WORDS, t))
            n_lost += len(marked) - len(own)
    assert names >= 0.95 * len(planted) and n_lost <= 0.001 * n_clean


def test_texts_of_very_many_terms(spark):
    text = " ".join(f"w{i}" for i in range(80_000))
    rows = [(i, f"{text} x{i} Zorntal zt@ex.org" + " a@b.c" * 5000) for i in range(2)] + [(i, f"number{i} w{i}") for i in range(2, 40)]
    rows += [(i, f"Zorntal u{i} zt@ex.org") for i in range(40, 44)] + [(i, f"plain v{i}") for i in range(44, 3000)]
    got = {r["doc_id"]: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and len(got[0]["base"]) == 5001
    assert all("Zorntal" in [rows[i][1][s["start"] : s["end"]] for s in got[i]["terms"]] for i in (40, 43))


@pytest.mark.parametrize("bits", [64, 2**20])
def test_document_frequency(spark, bits):
    texts = [f"a b{i % 7} c{i % 50} d{i}" for i in range(400)] + ["a b1 c1 d1"] * 3 + [""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = {r["k"]: r["w"] for r in spark.createDataFrame([(w,) for w in ("a", "b3", "c9", "d1", "none")], "w string").select("w", pii.term_key(F.col("w")).alias("k")).collect()}
    wanted = spark.createDataFrame([(k,) for k in keys], "term long")
    got = {keys[r["term"]]: r["n_term"] for r in pii.document_frequency(rows, wanted, bits).collect()}
    assert got == {w: sum(w in t.split() for t in set(texts)) for w in ("a", "b3", "c9", "d1")}
    assert pii.document_frequency(rows, wanted.limit(0), bits).count() == 0


def test_clear_of(spark):
    rng = random.Random(4)
    spans = lambda n: [(rng.randrange(3), s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(n))]
    terms, base = spans(200), spans(15)
    kind = "text_key int, start int, end int"
    got = pii.clear_of(spark.createDataFrame(terms, kind), spark.createDataFrame(base, kind)).collect()
    want = [t for t in terms if not any(t[0] == b[0] and b[1] < t[2] and t[1] < b[2] for b in base)]
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(want) < len(terms)


def test_sanitised_overlaps(spark):
    text = "call +4111111111111111 or 4111 1111 1111 1111"
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitise(row).first()["text"] == "call +<CARD> or <CARD>"


def test_native_plan(spark, sf_dir):
    for name in ("op7_quality_rules", "op8_pii_disclosure"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op10_toxicity_compression"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    y, score, predicted = (np.array([r[c] for r in held]) for c in ("toxic", "score", "predicted"))
    assert ((score >= 0) & (score <= 1)).all() and ((score >= 0.7) == predicted).all()
    # the word list used before reached 0.95, 0.85 and 0.01; raw text under trained dictionaries does not on so few labels
    assert area(score, y) > 0.9 and predicted[y == 1].mean() > 0.7 and predicted[y == 0].mean() < 0.03


def labelled_rows():
    """Toxic documents that hold marks in ever other contexts, and one passage copied in many toxic documents."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(("ba", "ko", "li", "tu", "sen", "mor", "ad")) for _ in range(rng.randrange(2, 5)))
    passage = " ".join(word() for _ in range(80))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic and i % 8 == 0:
            words = passage.split()
            words[rng.randrange(80)] = word()
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgwit", "praxilow", "quembly fit"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels, passage


def test_toxicity_equals_a_plain_scorer_and_ignores_copies(spark):
    import zstandard as z

    rows, labels, passage = labelled_rows()
    more = [(1000, passage), (1001, rows[4][1].replace("o", "0").replace("i", "1")), (1002, None), (1003, "w " * 30_000), (1003, ""), (None, rows[4][1])]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows + more], "doc_id long, text string, part string, carried int")
    model = toxicity.train(docs, spark.createDataFrame(labels + [(2, None), (3, 7)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(more)

    def packer(content):
        options = z.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=5, min_match=6, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
        return z.ZstdCompressor(compression_params=options, dict_data=z.ZstdCompressionDict(content + bytes(range(128, 176)), dict_type=z.DICT_TYPE_RAWCONTENT))

    plain, other = packer(model.ordinary + b"\xff" * len(model.toxic)), packer(model.ordinary + model.toxic)

    def want(text):
        data = (" " + " ".join((text or "").lower().translate(str.maketrans("430157@$", "aeoistas")).split()) + " ").encode()
        ends = bytes(range(128, 176))
        g = [len(plain.compress(data[i : i + 64] + ends)) - len(other.compress(data[i : i + 64] + ends)) for i in range(0, max(1, len(data) - 16), 48)]
        over, n = sum(max(0, x - 2) for x in g), len(g) + 8
        x = [math.log1p(max(0, max(g))), math.log1p(over), sum(g) / n, over / n, math.log1p(sum(sorted((max(0, v) for v in g))[-4:])), math.log1p(50 * over / n)]
        return 1 / (1 + math.exp(-model.weights[-1] - sum(w * (v - m) / s for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=False))))

    text_of = dict(rows + more[:4])
    assert all(abs(r["score"] - want(text_of[r["doc_id"]])) < 1e-9 for r in got if r["doc_id"] not in (None, 1003))
    y, score = (np.array(v) for v in zip(*((labels[r["doc_id"]][1], r["score"]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900), strict=True))
    assert area(score, y) > 0.97
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1000] < 0.7  # a passage that is copied in one class does not mark it
    assert abs(by_id[1001] - by_id[4]) < 1e-9 and by_id[None] == by_id[4]  # lookalikes are read as letters


@pytest.mark.parametrize("labels", [[], [(1, 1), (None, 1), (2, None), (1, 1)]])
def test_toxicity_without_labels(spark, labels):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, ""), (1, "some text")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs.withColumn("toxic", F.lit("x")), toxicity.train(docs, known)).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)


def test_spellings_that_hide_words():
    same = toxicity.canonical("You are an awful idiot, so-called")
    for text in ("You are an aw-ful id.i*ot, so_called", "YOU  are an\nawful idiot, so--called", "You are an aw​ful 1d10t, socalled", "Ｙｏｕ are an @wful idi­ot, so-called"):
        assert toxicity.canonical(text) == same.replace(b"so-called", b"socalled")
    assert toxicity.canonical("you i d i o t\nthere") == toxicity.canonical("you idiot there")
    assert toxicity.canonical("a b - c. d, e -f") == b" a b - c. d, e -f "
    assert toxicity.canonical("") == b"  "


def test_dictionary_knows_whole_records():
    head, tail = bytes(random.Random(1).choices(range(97, 123), k=70_000)), b"".join(b"<li>entry of the footer of the site, number %d</li>" % (i % 7) for i in range(4000))
    records = [head[i:] + head[:i] + tail for i in range(40)]
    content = warc.build_dictionary(records, 16_384, 50_000_000).as_bytes()
    assert b"footer of the site" in content  # it begins behind the first 65,536 bytes of every record
