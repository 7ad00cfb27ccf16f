import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
from test_archives_and_scores import WORDS, base, plain_terms
from test_duplicates import brute_classes
from test_encoding import check_packed
from test_quality_and_lines import base as base_figures
from test_quality_and_lines import plain_verdict
from tokenizers import Tokenizer

import corpus_pipeline as P
from wakeline.llm import darts, packing, pii, store

ORDER = ["quality_rules", "line_dedup", "near_dedup", "private_data", "best_fit_packing"]


def test_stages(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ORDER
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    sizes = [before.count()]
    for _, stage in P.STAGES[:-1]:
        after = P.materialise(stage(spark, before, sf_dir), "stage")
        assert after.columns == docs.columns
        sizes.append(after.count())
        before = after
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4]
    # nothing near-duplicate is left, each document is there once
    classes = darts.near_duplicates(before).collect()
    assert len(classes) == sizes[4]
    pieces = P.STAGES[-1][1](spark, before, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in before.select("doc_id").collect()}
    tokens = sum(p["length"] for p in pieces)
    assert len({p["sequence_id"] for p in pieces}) <= -(-tokens // 2048) * 1.05 + 1
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_awkward_documents(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"word{i} of the text," for i in range(30)) + "."
    rows = [(1, good, "en", "a", None), (1, good, "en", "a", None), (2, good, None, None, 5), (None, good + " more", "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, kind)
    kept = docs
    for _, stage in P.STAGES[:-1]:
        kept = P.materialise(stage(spark, kept, sf_dir), "stage")
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == ["1", "None"]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def plain_lines(rows, n_min=3, ratio=0.1):
    pages, met = Counter(r[2] for r in rows), defaultdict(int)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r")
    for _, text, source in rows:
        for k in {key(x) for x in text.split("\n")} - {""}:
            met[source, k] += 1
    dropped = lambda source, k: k and met[source, k] >= n_min and met[source, k] > ratio * pages[source]
    return [(i, "\n".join(x for x in text.split("\n") if not dropped(source, key(x))), source) for i, text, source in rows]


def plain_clean(text, wanted):
    spans = base(text)
    for m in re.finditer(WORDS, text):
        if m[0].lower() in wanted and not any(s < m.end() and m.start() < e for s, _, e in spans):
            spans.append((m.start(), 4, m.end()))
    out, at = "", 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += text[at:start] + f"<{pii.KINDS[kind].upper()}>"
        at = max(at, end)
    # of overlapping spans the first one's mark stands for all, up to the last one's end
    return out + text[at:]


def plain_pipeline(rows):
    """(doc_id, piece, start, length, ids_crc32) of all pieces, each stage done by the plain version that its operator is held against."""
    judged = [(i, plain_verdict(t), base_figures(t), source) for i, t, source in rows]
    kept = [(i, clean, source) for i, (_, lost, clean), figures, source in judged if not figures[5] and lost <= 0.5 * figures[1]]
    before = kept
    kept = plain_lines(kept)
    assert kept != before
    classes = brute_classes([(i, t) for i, t, _ in kept])
    kept = list({(i, t): t for i, t, _ in kept if i is not None and classes[i] == i}) + [(i, t) for i, t, _ in kept if i is None]
    assert len(kept) < len(before)
    wanted = plain_terms([t for _, t in kept])
    assert any("zorntal" in w for w in wanted.values())
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text in kept:
        ids = [*tokenizer.encode(plain_clean(text, wanted[text]), add_special_tokens=False).ids, 0]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        out += [(i, n, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    return out


def test_pipeline_equals_plain_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    long = [t for _, t, _ in given if t and len(t) > 1500]
    mixed = [" ".join(long[2 * i].split(" ")[:100] + long[2 * i + 1].split(" ")[-100:]) for i in range(8)]  # near to neither
    extra = [(90_000 + i, f"{t}\nZorntal wrote this by zt@ex.org with others.", f"s{i % 3}") for i, t in enumerate(mixed)]
    extra += [(91_000 + i, f"{long[i + 6]}\nOur footer of the site.", "footers") for i in range(5)]
    extra += [(92_000, long[0], None), (92_000, long[0], None), (None, long[1], "x"), (None, long[1], "x"), (92_001, None, "x"), (92_002, "", None)]
    extra += [(92_003, "\n".join(long[:40]), "y")]
    rows = given + extra
    folder = str(tmp_path / "in")
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    before = len(store.WRITTEN)
    got = P.run(spark, f"file://{folder}")
    done = [tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()]
    want = plain_pipeline(rows)
    assert sorted(map(repr, done)) == sorted(map(repr, want))
    tokens = sum(r[3] for r in want)
    assert check_packed(got.collect(), 2048) <= -(-tokens // 2048) * 1.05 + 1
    # only the result is left of what the run wrote
    assert len(store.WRITTEN) == before + 1
    shared = Path(store.shared_dir(spark).removeprefix("file://"))
    assert not list(shared.glob("quality_rules-*")) and len(list(shared.glob("best_fit_packing-*"))) == 1
