import random

from pyspark.sql import functions as F

from wakeline.operators import coding

PORTS = "pos long, portcode string, country_code string, city_code string, country_name string, city_name string"


def grams(text):
    return {text[i : i + 3] for i in range(len(text) - 2)}


def words(rng):
    return " ".join("".join(rng.choices("abcde", k=rng.randrange(1, 7))) for _ in range(rng.randrange(4)))


def test_ngram_scorer_against_all_pairs(spark):
    rng = random.Random(1)
    names = [words(rng).upper() for _ in range(150)] + [f"HARBOUR NUMBER {i}" for i in range(60)] + ["", "AB"]
    ports = [(i, f"P{i:04}", "PP", "", "", name) for i, name in enumerate(names)]
    texts = sorted({words(rng) for _ in range(120)} | {n.lower() for n in names[::9]} | {"harbour number", "harbour numbre 7", "xyz", "ab", ""})
    df, p = spark.createDataFrame([(t,) for t in texts], "clean_dest string"), spark.createDataFrame(ports, PORTS)
    want = {}
    for t in texts:
        g = grams(t)
        scores = [(-len(g & h) / len(g | h), i) for i, h in enumerate(grams(n.lower()) for n in names) if g & h]
        want[t] = (f"P{min(scores)[1]:04}", round(-min(scores)[0] * 100, 2)) if scores else (None, 0.0)
    assert {r["clean_dest"]: (r["code"], r["confidence"]) for r in coding.ngram_scorer(df, p).collect()} == want
    assert coding.ngram_scorer(df, p.limit(0)).filter("code is null and confidence = 0").count() == len(texts)
    assert coding.ngram_scorer(df.limit(0), p).count() == 0


def test_few_pairs_are_compared(spark):
    names = [f"port of number {i} harbour" for i in range(400)]
    sets = lambda rows, key: spark.createDataFrame(rows, f"{key[0]} {key[1]}, text string").select(key[0], coding.trigrams(F.col("text")).alias("grams"))
    p, t = sets(list(enumerate(names)), ("pos", "long")), sets([(n, n) for n in names[:100]], ("clean_dest", "string"))
    asked = coding.by_rarity(t, p, "clean_dest").withColumn("least", F.lit(0.6))
    pairs = coding.prefix_pairs(asked, coding.by_rarity(p, p, "pos"))
    alike = t.crossJoin(p.withColumnRenamed("grams", "g")).withColumn("both", F.size(F.array_intersect("grams", "g")))
    alike = alike.filter(F.col("both") >= 0.6 * (F.size("grams") + F.size("g") - F.col("both"))).select("clean_dest", "pos")
    assert alike.exceptAll(pairs).count() == 0
    exact = coding.prefix_pairs(asked.withColumn("least", F.lit(0.95)), coding.by_rarity(p, p, "pos"))
    assert exact.count() < 0.1 * 100 * 400  # every pair shares a trigram


def test_names_are_found_by_their_rarest_trigram(spark):
    ports = [(i, f"P{i:04}", "PP", "", "SOME LAND", f"SUPPLIER {i:03} BAY") for i in range(200)] + [(200, "Q", "QQ", "", None, "SUPPLIER ODD"), (201, "R", "", "", "X", None)]
    p = spark.createDataFrame(ports, PORTS)
    df = spark.createDataFrame([(w,) for w in ("SUPPLIER", "R ODD", "17 BAY", "LAND", "NOWHERE", "SUPP ODD")], "word string")
    got = {}
    for r in coding.names_holding(df, p).collect():
        got[r["word"]] = min(got.get(r["word"], 999), r["pos"])
    assert got == {"SUPPLIER": 0, "R ODD": 200, "17 BAY": 17, "LAND": 0}


def test_ships_without_a_number_keep_their_own_codes(spark):
    ports = spark.createDataFrame([(0, "KRPUS", "KR", "PUS", "KOREA", "BUSAN"), (1, "CNSHA", "CN", "SHA", "CHINA", "SHANGHAI")], PORTS)
    registered = spark.createDataFrame([("busan", "KRPUS"), ("shanghai", "CNSHA")], "clean_dest string, portcode string")
    rows = [(1, 0, "BUSAN"), (2, 0, "SHANGHAI"), (3, None, "BUSAN"), (4, None, "SHANGHAI"), (5, 7, "BUSAN"), (6, 7, "Shanghai"), (7, 7, None), (8, 7, "x")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "event_id long, mmsi long, destination string, dest_code string")
    got = {r["event_id"]: r["dest_code"] for r in coding.code_destinations(df, ports, registered).collect()}
    assert got == {1: "KRPUS", 2: "CNSHA", 3: "KRPUS", 4: "CNSHA", 5: "CNSHA", 6: "CNSHA", 7: "kept", 8: "kept"}


def test_a_batch_reads_its_rows_once_to_code_them(spark):
    ports = spark.createDataFrame([(i, f"AB{i:03}", "AB", f"{i:03}", "Land", "Busan" if i % 2 else "Ulsan") for i in range(9, 0, -1)], "pos long, portcode string, country_code string, city_code string, country_name string, city_name string")
    rows = spark.createDataFrame([(1, "Busan"), (2, "BUSAN"), (3, None), (4, "ulsan port"), (4, "ulsan port")], "event_id long, destination string")
    done = coding.code_batch(rows, ports)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert sorted((r["event_id"], r["clean_dest"], r["pred"]) for r in done.collect()) == [(1, "busan", "AB001"), (2, "busan", "AB001"), (3, "", ""), (4, "ulsan port", "AB002"), (4, "ulsan port", "AB002")]
