"""Repair of the structure of conversations by cheapest edits.

Each conversation becomes a signature, a letter for the role and the fault of
each row. Signatures are sorted over the cluster; neighbours share prefixes, so
each task walks them as a prefix trie that keeps one layer of a dynamic program
for each letter of the present path: a shared prefix is computed once, and an
answer is read off where a signature ends. The texts stay aside until the edits
are known.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.store import materialise
from wakeline.llm.text import SPACES

#: States of the role sequence: nothing yet, after `s`, after `u`, after `a`. It may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a user may follow; an assistant follows a user only.
BEFORE_USER = (START, SYSTEM, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: Letter of a row that must go; the others are s, u, a and o (any other role), capital if the row is truncated.
GONE = "x"
#: Layers after which what all states have in common is put away.
TRIM = 64

Best = tuple[int, str]


class Layers:
    """The path through the trie to the present signature, with the best edits for each state after each of its letters."""

    def __init__(self):
        self.letters = ""
        #: For each letter, for each state: its cost, the state before and the edits that lead here.
        self.steps: list[list[tuple[int, int, str] | None]] = []
        self.computed = 0
        first: list[tuple[int, int, str] | None] = [(0, -1, "")] + [None] * 3
        self.root = self.inserted(first, [""] * 4)
        self.tails = [s[2] if s else "" for s in self.root]

    @staticmethod
    def inserted(step: list, prefix: list[str]) -> list:
        """A layer after the empty rows that may be inserted behind it; `prefix` has the edits of the layer before."""

        def key(s) -> Best:
            return s[0], prefix[s[1]] + s[2]

        def best(options: list):
            return min((o for o in options if o), key=key, default=None)

        more = lambda s, n: s and (s[0] + n * INSERT_COST, s[1], s[2] + INSERT * n)
        user = best([step[USER], *(more(step[q], 1) for q in BEFORE_USER)])
        return [step[START], step[SYSTEM], user, best([step[ASSISTANT], more(user, 1)])]

    def extend(self, letter: str) -> None:
        before = self.steps[-1] if self.steps else self.root
        step: list[list[tuple[int, int, str]]] = [[], [], [], []]
        kind, late = letter.lower(), TRUNCATED_COST * letter.isupper()
        for q, s in enumerate(before):
            if s is None:
                continue
            step[q].append((s[0] + DELETE_COST, q, DELETE))
            if letter == GONE:
                continue
            if kind == "s" and q == START:
                step[SYSTEM].append((s[0] + late, q, KEEP))
            for role, name, fits in ((USER, "u", q in BEFORE_USER), (ASSISTANT, "a", q == USER)):
                if fits:
                    step[role].append((s[0] + late, q, KEEP) if kind == name else (s[0] + late + REROLE_COST, q, REROLE))
        least = [min(options, key=lambda s: (s[0], self.tails[s[1]] + s[2]), default=None) for options in step]
        layer = self.inserted(least, self.tails)
        self.tails = [self.tails[s[1]] + s[2] if s else "" for s in layer]
        self.steps.append(layer)
        self.computed += 1
        if len(self.steps) % TRIM == 0:
            self.trim()

    def trim(self) -> None:
        """Edits are only compared, so what all states begin with can go."""
        live = [t for t, s in zip(self.tails, self.steps[-1], strict=True) if s]
        n = len(os.path.commonprefix(live))
        self.tails = [t[n:] for t in self.tails]

    def edits(self, state: int) -> str:
        """The edits to a state of the last layer, from the way back."""
        parts = []
        for layer in reversed(self.steps):
            parts.append(layer[state][2])
            state = layer[state][1]
        return "".join([self.root[state][2], *reversed(parts)])

    def answer(self, signature: str) -> Best:
        """(cost, edits) of a signature; the layers of what it shares with the one before are used again."""
        shared = len(os.path.commonprefix([self.letters, signature]))
        if shared < len(self.letters):
            del self.steps[shared:]
            layer = self.steps[-1] if self.steps else self.root
            self.tails = [self.edits(q) if s else "" for q, s in enumerate(layer)]
            if self.steps:
                self.trim()
        for letter in signature[shared:]:
            self.extend(letter)
        self.letters = signature
        last = self.steps[-1] if self.steps else self.root
        ends = [(last[q][0], self.edits(q)) for q in (START, ASSISTANT) if last[q]]
        return min(ends)


def rows_of(edits: str, signature: str) -> list[tuple[int, str | None]]:
    """(row, role) of each row of the repaired conversation: row -1 is a new one, role null stays as it is."""
    out, row, state = [], 0, START
    for e in edits:
        if e != DELETE:
            state = SYSTEM if e == KEEP and signature[row].lower() == "s" else ASSISTANT if state == USER else USER
            name = None if e == KEEP else "user" if state == USER else "assistant"
            out.append((-1 if e == INSERT else row, name))
        row += e != INSERT
    return out


def solved(signatures: DataFrame) -> DataFrame:
    """Rows (conv, cost, audit, edits) of rows (conv, signature); sorted ranges of signatures, a common one split by `conv`."""
    key = pa.struct([("conv_id", pa.int64())])
    out = pa.schema([("conv", key), ("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, last, cost, audit, edits = Layers(), None, 0, "", []
        for batch in filter(len, batches):
            found = []
            for signature in batch["signature"].to_pylist():
                if signature != last:
                    cost, audit = layers.answer(signature)
                    last, edits = signature, [{"row": r, "role": n} for r, n in rows_of(audit, signature)]
                found.append((cost, audit, edits))
            columns = [batch["conv"].cast(key), *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(out)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    near = signatures.select("conv", "signature").repartitionByRange("signature", "conv").sortWithinPartitions("signature")
    return near.mapInArrow(work, "conv struct<conv_id:long>, cost long, audit string, edits array<struct<row:int,role:string>>")


def in_order() -> Column:
    """What rows of a conversation are sorted by."""
    return F.struct(F.col("turn").isNotNull().alias("has_turn"), F.col("turn"), F.col("role"), F.col("key"))


def repair_structure(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), one for each conv_id of rows (conv_id, turn, role, text).

    `repaired` lists (role, text) after the cheapest edits that make the roles
    a system row at most, then pairs of user and assistant, or nothing; `audit`
    names the edits. A row is blank, else a duplicate (its role and text came
    earlier), else truncated (its last visible character is none of `.!?`), else
    whole. Rows go by turn, nulls first; rows of one turn by role and the
    SHA-256 of the text, so repeated rows lie side by side. Null roles and texts
    count as one space, a null conv_id is a conversation of its own. An empty
    table gives no rows; columns other than the four are not read. A
    conversation's repaired form is one value, so its texts meet in one task;
    what is sorted before is some 100 bytes a row.
    """
    space = F.lit(" ")
    rows = turns.select(F.struct(F.col("conv_id").cast("long").alias("conv_id")).alias("conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.withColumn("key", F.sha2("text", 256))
    visible = F.btrim("text", F.lit(SPACES))
    lean = rows.select("conv", "turn", "role", "key", (visible == "").alias("blank"), F.right(visible, F.lit(1)).isin(".", "!", "?").alias("ended"))
    w = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "key")
    again = F.row_number().over(Window.partitionBy("conv", "role", "key").orderBy("at")) > 1
    initial = F.substring("role", 1, 1)
    marked = lean.withColumn("at", F.row_number().over(w)).withColumn("again", ~F.col("blank") & again)
    marked = marked.withColumn("pair", F.concat(F.lag(initial).over(w), initial)).withColumn("new_turn", ~F.col("turn").eqNullSafe(F.lag("turn").over(w)) & F.col("turn").isNotNull())
    cut = ~F.col("blank") & ~F.col("again") & ~F.col("ended")
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("blank") | F.col("again"), GONE).when(cut, F.upper(kind)).otherwise(kind)
    counts = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps"),
        F.count_if("blank").alias("blank"),
        F.count_if("again").alias("duplicate"),
        F.count_if(cut).alias("truncated"),
        F.count_if(~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", letter.alias("letter")))), lambda x: x["letter"]), "").alias("signature"),
    )
    counts = materialise(counts, "signatures")
    told = counts.drop("signature").join(solved(counts), "conv")
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(in_order().alias("order"), "role", "text"))).alias("rows")).join(told, "conv")

    def row(e: Column) -> Column:
        old = F.get(F.col("rows"), e["row"])
        return F.struct(F.coalesce(e["role"], old["role"]).alias("role"), F.when(e["row"] < 0, "").otherwise(old["text"]).alias("text"))

    return whole.select("conv.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.transform("edits", row).alias("repaired"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by the CRC-32 of `conv_id:turn`, modulo 20.

    0 drops the row, 1 empties the text, 2 takes its `.!?`, 3 repeats it, 4 makes
    it a user's. Nulls count as one space, in the key too.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("__fault"))
    fault = F.col("__fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = rows.filter(fault != 0).withColumns({"text": text, "role": F.when(fault == 4, "user").otherwise(F.col("role"))})
    return hurt.withColumn("__copy", F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__copy", "__fault")
