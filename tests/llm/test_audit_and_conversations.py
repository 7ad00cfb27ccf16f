import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from wakeline.llm import divergence, repair, replies
from wakeline.llm.queries import OP11_SQL, OP12_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, term string, p long"
TURNS = "conv_id long, turn long, role string, text string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return sorted((tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in result.fetchall()), key=repr)


def terms_of(text):
    return [m.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


def test_terms():
    for text in ("Ünter DEN Linden-Straße\x00x2y_z{q}|~ é", "", "..", "a" * 10 + " " + "b " * 9):
        assert [t.decode() for run in divergence.term_runs(text.encode()) for t in run] == terms_of(text)
    long = "word ÉCOLE " * 300_000
    assert [t.decode() for run in divergence.term_runs(long.encode()) for t in run] == terms_of(long)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    sketch, true = divergence.Sketch(1024, 3, 3), Counter()
    for _ in range(5):
        hashes = rng.choice(np.arange(5000, dtype=np.uint64), 800) * np.uint64(2**40 + 7)
        sketch.add(hashes)
        true.update(hashes.tolist())
    keys = np.array(list(true), np.uint64)
    estimates = sketch.estimate(keys)
    assert all(e >= min(3, true[k]) for e, k in zip(estimates.tolist(), keys.tolist(), strict=True))
    assert len(sketch.estimate(keys[:0])) == 0
    with pytest.raises(ValueError):
        divergence.Sketch(1000, 3, 3)


def test_sketch_drops_rare_terms_before_the_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7).select("lang", "source", "text")
    truth = defaultdict(Counter)
    for r in docs.collect():
        truth[r["lang"]].update(set(terms_of(r["text"] or "")))
    kept = {(lang, t) for lang, c in truth.items() for t, n in c.items() if n >= 3}
    passed = {(r["lang"], r["term"]) for r in divergence.count_terms(docs, divergence.frequency_sketch(docs)).select("lang", "term").distinct().collect()}
    assert kept <= passed and len(passed) < 1.05 * len(kept) < 0.5 * sum(map(len, truth.values()))


@pytest.mark.parametrize("width", [1 << 20, 16])
def test_divergence_of_awkward_documents(spark, width):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma", "ÉTÉ", "été", f"w{rng.randrange(30)}x"]) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None]), "t", 1) for i in range(200)]
    docs += [(1, "alpha alpha", "en", "a", "t", 1)] * 3 + [(None, None, "de", "x", None, None), (7, "", "de", "y", None, None), (8, "once", "it", "z", None, None), (9, "big " * 200_000, "en", "b", "t", 1)]
    df = spark.createDataFrame(docs, DOCS)
    got = rows(divergence.source_divergence(df, width=width), "item", "lang", "part", "rank", "source", "value")
    pdf = df.toPandas()
    assert got == by_sql(OP11_SQL, documents=pdf)
    assert {r[1] for r in got if r[2] == "pair"} == {"", "en", "fr", "de"}
    assert [r[5] for r in got if r[1] == "de"] == [0, 0]
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_divergence_ranks_and_large_counts(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    docs = [(i, " ".join(words), "en", "a", "", 0) for i in range(3)] + [(9, "other", "en", "b", "", 0)] * 3
    got = divergence.source_divergence(spark.createDataFrame(docs, DOCS)).collect()
    ranked = sorted((r["rank"], r["item"]) for r in got if r["part"] == "term" and r["source"] == "a")
    assert ranked == list(enumerate(sorted(words)[:200], 1))
    n, total, v = 10**13, 10**15, 10**6
    row = spark.range(1).selectExpr(f"{divergence.share(f'{n}L', f'{total}L', f'{v}L')} as p").first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (total + v)


def test_trees_against_a_walk(spark):
    rng = random.Random(5)
    nodes = []
    for tree in range(40):
        n = rng.choice([1, 2, 5, 30, 90])
        deep = rng.random() < 0.5
        for i in range(n):
            parent = None if i == 0 or rng.random() < 0.03 else max(0, i - rng.choice([1, 1, 2])) if deep else rng.randrange(i)
            nodes.append((tree if tree else None, i, parent, rng.choice(["user", "assistant", None]), rng.choice(["hi", None, "é\n<|end|>\n"]), rng.choice([None, float("nan"), 0.5, 1.0, 2.0])))
    nodes += [(77, 1, 2, "user", "circle", 1.0), (77, 2, 1, "user", "circle", 1.0), (77, 3, 2, "user", "under", 1.0), (78, 1, 1, "user", "own parent", 1.0), (79, 5, 99, "user", "lost parent", 1.0), (80, None, 1, "user", "no id", 1.0)]
    by_tree = defaultdict(dict)
    for t, i, parent, _, _, score in nodes:
        if i is not None:
            by_tree[t][i] = (parent, 0.0 if score is None or score != score else score)
    want = []
    for t, own in by_tree.items():
        answered = {p for i, (p, _) in own.items() if p != i}
        paths = []
        for leaf in own.keys() - answered:
            path = [leaf]
            while (up := own[path[-1]][0]) in own and up != path[-1] and len(path) < 200:
                path.append(up)
            if len(path) < 200:
                paths.append((-sum(own[i][1] for i in path) / len(path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:3], 1):
            want += [(t, leaf, rank, back, i) for back, i in enumerate(path)]
    df = spark.createDataFrame([(*n, "x") for n in nodes], "conv_id long, node_id long, parent_id long, role string, text string, score double, leaf_id string")
    assert rows(replies.best_branches(df, 3), "conv_id", "leaf_id", "rank", "back", "node_id") == sorted(want, key=repr)
    said = {(n[0], n[1]): (n[3] or "", n[4] or "") for n in nodes}
    paths = defaultdict(list)
    for t, leaf, _, _, i in sorted(want, key=lambda w: -w[3]):
        paths[t, leaf].append(said[t, i])
    done = replies.reply_conversations(df, 3).collect()
    assert {(r["conv_id"], r["leaf_id"]): list(replies.read_turns(r["formatted"])) for r in done} == paths
    for r in done:
        assert list(replies.read_loss(r["formatted"], r["loss"])) == [t for role, t in paths[r["conv_id"], r["leaf_id"]] if role == "assistant"]
    assert replies.reply_conversations(df.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "<|turn|>", "<|end|>\n", "</s>", "[/INST]", "<<SYS>>", "\n", "ä", "n"]
    told = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(800)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(told)], "conv_id long, turn long, text string")
    out = df.select("conv_id", replies.escape(df["text"]).alias("e"), replies.role_line(df["text"]).alias("r")).collect()
    for row in out:
        text = told[row["conv_id"]]
        assert replies.unescape(row["e"]) == text and replies.read_role(row["r"]) == text
        assert "\n" not in row["r"] and not any(c in row["e"] or c in row["r"] for c in ("<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def awkward_turns():
    rng = random.Random(11)
    out = []
    for conv in range(300):
        n = rng.choice([1, 2, 3, 5, 9, 60])
        at = 0
        for _ in range(n):
            at += rng.choice([0, 1, 1, 1, 3])
            out.append((conv if conv else None, rng.choice([at, at, at, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b?", "cut", " \t\n", "", None, "é!  ", f"{rng.random()}"])))
    out += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}" + "." * (t % 7 > 0)) for t in range(3000)]
    return out + [(1001, 0, "user", "long " * 200_000), (1001, 1, "assistant", "ok.")]


def test_reply_query_equals_sql(spark, sf_dir, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    df = spark.createDataFrame([(*t, "x") for t in awkward_turns()], TURNS + ", node_id string")
    df.write.parquet(path)
    got = rows(QUERIES["op12_reply_trees"](spark, str(tmp_path)), "conv_id", "formatted_chars", "loss_chars", "loss_sha256", "n_turns", "turns_sha256")
    # SQL sorts nulls of a turn and of a role last; here they come first and count as empty
    sql = OP12_SQL.replace("order by turn, role, text", "order by turn nulls first, raw_role nulls first, raw_text nulls first").replace("select conv_id, turn, coalesce(role", "select conv_id, turn, role as raw_role, text as raw_text, coalesce(role", 1).replace("select -7, 0, 'user',", "select -7, 0, 'user', '', 'user',").replace("select -7, 1, 'assistant',", "select -7, 1, 'assistant', '', 'assistant',")
    assert got == by_sql(sql, conversations=df.drop("node_id").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    df.limit(0).write.mode("overwrite").parquet(path)
    assert rows(QUERIES["op12_reply_trees"](spark, str(tmp_path)), "conv_id", "n_turns") == [(-7, 2)]


def cheapest(letters):
    """(cost, edits) by a search in order of cost and then of the edits' letters."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, edits, i, last = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(letters) and last in ("", "a"):
            return cost, edits
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if follow != "s":
            role = "a" if follow == "a" else "u"
            heapq.heappush(queue, (cost + 5, edits + "I", i, role))
        if i < len(letters):
            heapq.heappush(queue, (cost + 2, edits + "D", i + 1, last))
            kind, late = letters[i].lower(), 5 * letters[i].isupper()
            if kind != "x":
                if kind in follow:
                    heapq.heappush(queue, (cost + late, edits + "K", i + 1, kind))
                heapq.heappush(queue, (cost + late + 1, edits + "R", i + 1, "a" if follow == "a" else "u"))


def repaired(turns):
    """The plain form of `repair_structure` on rows (turn, role, text) of one conversation."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    letters, seen, counts = "", set(), Counter()
    for _, role, text in turns:
        visible = text.strip(" \t\n\x0b\x0c\r")
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        letters += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = cheapest(letters)
    out, i, last = [], 0, ""
    for e in audit:
        if e != "D":
            role = "u" if last != "u" else "a"
            name = {"u": "user", "a": "assistant"}[role]
            if e == "K":
                name = turns[i][1]
                role = name[0]
            out.append((name, "" if e == "I" else turns[i][2]))
            last = role
        i += e != "I"
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in out))


def harmed(turns):
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            yield from [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def check_repair(spark, path, turns):
    groups = {t[0]: [] for t in turns}
    for conv, *row in harmed(turns):
        groups[conv].append(row)
    want = {}
    for conv, own in groups.items():
        *numbers, text = repaired(own) if own else (0, 0, 0, 0, 0, 0, "", "")
        want[conv] = (*numbers, hashlib.sha256(text.encode()).hexdigest())
    got = QUERIES["op13_structure_repair"](spark, path).collect()
    assert {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got} == want
    assert len(got) == len(want)


def test_repair_query_against_a_search(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    turns = awkward_turns()
    df = spark.createDataFrame([(*t, "x") for t in turns], TURNS + ", key string")
    df.write.parquet(path)
    check_repair(spark, str(tmp_path), turns)
    df.limit(0).write.mode("overwrite").parquet(path)
    assert QUERIES["op13_structure_repair"](spark, str(tmp_path)).count() == 0


def test_repair_query_on_the_given_table(spark):
    d = "/root/testdata/sf0.01"
    check_repair(spark, d, [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_layers_share_prefixes():
    rng = random.Random(4)
    signatures = sorted({"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(9))) for _ in range(3000)} | {"ua" * 200, "ua" * 200 + "x", "uA" * 150 + "oS"})
    layers = repair.Layers()
    assert [layers.answer(s) for s in signatures] == [cheapest(s) for s in signatures]
    shared = len({s[:i] for s in signatures for i in range(1, len(s) + 1)})
    assert layers.computed == shared < 0.6 * sum(map(len, signatures))
