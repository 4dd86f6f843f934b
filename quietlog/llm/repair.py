"""Conversation structure repair by weighted CYK interval parsing.

A conversation is legal if its role initials read `(s?(ua)+)?`.  A turn may be kept (0), given the role user or
assistant (2) or deleted (3); an empty user or assistant turn may be inserted anywhere (2); a truncated turn that stays adds
1; blank and duplicate turns must be deleted.

Grammar: states are 0 (start), 1 (after s), 2 (after u), 3 (after a); a nonterminal is a pair of states, p -> q, and
its rules in Chomsky normal form are p -> q = p -> r, r -> q, or an edit of one turn.  Inserted turns stand in no input, so
their closure (the cheapest insertions from one state to another) is applied to the terminal cells, before and after.
A cell holds, for each nonterminal over its span, the least (cost, audit).  Equal costs over one span never go with
audits of which one begins the other (the longer would have an insertion more), so the least of a whole is made of
the least of its parts, and cells may be combined over any bracketing.

Charts are filled bottom-up by span length, with all splits, over eight cells; the chart's whole span is a cell of the chart
above.  Turns are numbered, and a chunk of 512 is one row of Spark: three storeys of charts.  Longer
conversations get more storeys, each a job over chunks of chunks, and the way back hands each chunk the states it lies
between.  So no task holds a conversation, however long; only its audit, one character a turn, and its digest are whole.

Rows: turns in ascending order, null first, then by role and text; null role or text is one space, and so is a null id
in what is hashed for the damage.  Rows without conv_id are one conversation.  A role's first character is its initial; an
empty role has a space, which no legal conversation holds.  Other columns stay out of the way; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.functions.text import pin
from quietlog.llm.turns import joined_sha256
from quietlog.operators.ranks import numbered
from quietlog.session import staged

#: cells of a chart, and turns or cells of a row
CHART, CHUNK = 8, 512
#: what is no text: space and \t to \r
SPACES = " \t\n\v\f\r"
INSERT, REROLE, DELETE, CUT_OFF = 2, 2, 3, 1
#: the state after a turn with an initial, by the state before
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
#: the state after an inserted or re-roled turn, which is user's or assistant's, and its role
MADE = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

Cell = dict[tuple[int, int], tuple[int, str]]


def product(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """The least of `into` and of what two neighbouring spans give."""
    out = {} if into is None else into
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            if (more := right.get((r, q))) is not None:
                found = (cost + more[0], audit + more[1])
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _closure() -> Cell:
    """The cheapest insertions from state to state."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    one: Cell = {(p, q): (INSERT, "I") for p, (q, _) in MADE.items()}
    for _ in range(4):
        product(dict(out), one, out)
    return out


CLOSURE = _closure()


@lru_cache(64)
def terminal(kind: str) -> Cell:
    """The cell of one turn: `x` must go; else its initial, in upper case if truncated (`o`: no initial of the grammar)."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "x":
        more = CUT_OFF if kind.isupper() else 0
        for p, (q, _) in MADE.items():
            edits[p, q] = min(edits.get((p, q), (99, "")), (REROLE + more, "R"))
        for (p, initial), q in NEXT.items():
            if initial == kind.lower():
                edits[p, q] = min(edits.get((p, q), (99, "")), (more, "K"))
    return product(product(CLOSURE, edits), CLOSURE)


def chart(cells: list[Cell]) -> Cell:
    """The cell over a row of cells: spans by length, all splits."""
    spans = {(i, 1): c for i, c in enumerate(cells)}
    for length in range(2, len(cells) + 1):
        for start in range(len(cells) - length + 1):
            spans[start, length] = {}
            for cut in range(1, length):
                product(spans[start, cut], spans[start + cut, length - cut], spans[start, length])
    return spans[0, len(cells)]


@lru_cache(1 << 15)
def short(kinds: str) -> Cell:
    """The cell of a few turns; many conversations are alike."""
    return chart([terminal(k) for k in kinds])


def storeys(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        cells = [chart(cells[i : i + CHART]) for i in range(0, len(cells), CHART)]
    return cells[0]


def parsed(kinds: str) -> Cell:
    return storeys([short(kinds[i : i + CHART]) for i in range(0, len(kinds), CHART)])


def passes(cells: list[Cell], start: int, end: int) -> list[tuple[int, int]]:
    """The states that each cell lies between, where the whole leads from `start` to `end` by its least (cost, audit)."""
    # the least of the first cells, from `start`, by the state they end in; of equal ones, any gives the same audit
    ways: list[dict[int, tuple[tuple[int, str], int]]] = []
    so_far = {start: (0, "")}
    for cell in cells:
        step: dict[int, tuple[tuple[int, str], int]] = {}
        for p, (cost, audit) in so_far.items():
            for q in range(4):
                if (more := cell.get((p, q))) is not None:
                    found = ((cost + more[0], audit + more[1]), p)
                    if q not in step or found < step[q]:
                        step[q] = found
        ways.append(step)
        so_far = {q: best for q, (best, _) in step.items()}
    out = []
    for step in reversed(ways):
        before = step[end][1]
        out.append((before, end))
        end = before
    return out[::-1]


def edits(kinds: str, start: int, audit: str) -> list[tuple[str, str, str]]:
    """For each turn of an audit: roles inserted before it, its edit with the new role if any, roles inserted at the end."""
    state, out, before = start, [], []
    turns = iter(kinds)
    for edit in audit:
        if edit == "I":
            state, role = MADE[state]
            before.append(role)
            continue
        kind, role = next(turns), ""
        if edit == "R":
            state, role = MADE[state]
        elif edit == "K":
            state = NEXT[state, kind.lower()]
        out.append([",".join(before), edit + role, ""])
        before = []
    if before:
        out[-1][2] = ",".join(before)
    return [tuple(x) for x in out]


def _structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


CELLS = _structs(p=T.IntegerType(), q=T.IntegerType(), cost=T.LongType(), audit=T.StringType())


def _rows(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()]


def _cell(rows) -> Cell:
    return {(r["p"], r["q"]): (r["cost"], r["audit"]) for r in rows}


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


@F.pandas_udf(CELLS)
def parse_chunk(kinds: pd.Series) -> pd.Series:
    return kinds.map(lambda k: _rows(parsed(k)))


@F.pandas_udf(T.LongType())
def count_illegal(initials: pd.Series) -> pd.Series:
    return initials.map(_illegal)


@F.pandas_udf(CELLS)
def parse_cells(cells: pd.Series) -> pd.Series:
    return cells.map(lambda row: _rows(storeys([_cell(c["cells"]) for c in row])))


@F.pandas_udf(_structs(p=T.IntegerType(), q=T.IntegerType()))
def pass_cells(cells: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    found = [passes([_cell(c["cells"]) for c in row], p, q) for row, p, q in zip(cells, start, end, strict=True)]
    return pd.Series([[{"p": p, "q": q} for p, q in way] for way in found])


@F.pandas_udf(_structs(before=T.StringType(), edit=T.StringType(), after=T.StringType()))
def chunk_edits(kinds: pd.Series, start: pd.Series, audit: pd.Series) -> pd.Series:
    return pd.Series([[{"before": b, "edit": e, "after": a} for b, e, a in edits(*x)] for x in zip(kinds, start, audit, strict=True)])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the hash of `conv_id:turn` deals out."""
    blank = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    kind = F.crc32(F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("damage"))
    changed = rows.where("damage <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        "damage",
    )
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return changed.withColumn("copy", F.explode(copies)).drop("copy", "damage")


def _same(a: DataFrame, b: DataFrame, *more: str) -> Column:
    out = a["conv_id"].eqNullSafe(b["conv_id"])
    for c in more:
        out = out & (a[c] == b[c])
    return out


def faulted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with place, initial and first fault (blank, duplicate, truncated or none); and their texts, by place."""
    ordered = numbered(rows, ["conv_id"], ["turn", "role", "text"]).withColumn("sha", F.sha2("text", 256))
    ordered = staged(ordered, "ordered")
    first = ordered.groupBy("conv_id", "role", "sha").agg(F.min("place").alias("first"))
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    marks = ordered.select("conv_id", "turn", "role", "sha", "place", (stripped == "").alias("blank"), F.right(stripped, F.lit(1)).isin(".", "!", "?").alias("ended"))
    joined = marks.join(first, _same(marks, first, "role", "sha")).select(marks["*"], "first")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    initial = F.when(F.col("role") == "", " ").otherwise(F.left("role", F.lit(1)))
    return staged(joined.select("conv_id", "turn", "place", fault.alias("fault"), initial.alias("initial")), "faulted"), ordered


def _chunks(turns: DataFrame) -> DataFrame:
    """A row per conversation and 512 turns: kinds of turn, and how many of its neighbours don't go together."""
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(
        F.when(~F.col("initial").isin("s", "u", "a"), F.when(F.col("fault") == "truncated", "O").otherwise("o"))
        .otherwise(F.when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
    )
    chunk = ((F.col("place") - 1) / CHUNK).cast("long")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    rows = turns.select("conv_id", "place", kind.alias("kind"), known.alias("initial"), chunk.alias("chunk"))
    # a chunk's first turn also ends the last pair of the chunk before
    both = rows.unionByName(rows.where((F.col("place") % CHUNK == 1) & (F.col("chunk") > 0)).withColumns({"chunk": F.col("chunk") - 1, "kind": F.lit("")}))
    whole = both.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "initial"))).alias("turns"))
    return whole.select(
        "conv_id", "chunk",
        F.array_join("turns.kind", "").alias("kinds"),
        count_illegal(F.array_join("turns.initial", "")).alias("illegal"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation of `rows` (conv_id, turn, role, text): faults, and the cheapest repair with its audit and digest."""
    turns, ordered = faulted(rows)
    chunks = staged(_chunks(turns).withColumn("cells", parse_chunk("kinds")), "chunks")
    floors = [chunks.select("conv_id", F.col("chunk").alias("at"), "cells")]
    most = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1
    while most > 1:
        parent = (F.col("at") / CHART / CHART).cast("long")
        under = floors[-1].groupBy("conv_id", parent.alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "cells"))).alias("below"))
        floors.append(staged(under.select("conv_id", F.col("up").alias("at"), parse_cells("below").alias("cells"), "below"), "floor"))
        most = -(-most // CHART**2)
    root = floors[-1].select("conv_id", "at", F.array_min(F.transform(F.filter("cells", lambda c: (c.p == 0) & c.q.isin(*ACCEPTED)), lambda c: F.struct(c.cost, c.audit, c.q))).alias("best"))
    root = staged(root.select("conv_id", "at", "best.cost", "best.audit", F.lit(0).alias("p"), "best.q"), "root")
    ways = root.select("conv_id", "at", "p", "q")
    for floor in floors[:0:-1]:
        over = floor.join(ways, _same(floor, ways, "at")).select(floor["conv_id"], floor["at"], pass_cells("below", "p", "q").alias("way"))
        ways = over.select("conv_id", F.col("at").alias("up"), F.posexplode("way").alias("nth", "s")).select("conv_id", (F.col("up") * CHART**2 + F.col("nth")).alias("at"), "s.p", "s.q")
    bases = chunks.join(ways, chunks["conv_id"].eqNullSafe(ways["conv_id"]) & (chunks["chunk"] == ways["at"])).select(chunks["*"], "p", "q")
    own = F.filter("cells", lambda c: (c.p == F.col("p")) & (c.q == F.col("q")))[0]["audit"]
    each = bases.select("conv_id", "chunk", F.posexplode(pin(chunk_edits("kinds", "p", own))).alias("nth", "e"))
    steps = each.select("conv_id", (F.col("chunk") * CHUNK + F.col("nth") + 1).alias("place"), "e.before", "e.edit", "e.after")
    texts = ordered.join(steps, _same(ordered, steps, "place")).select(ordered["conv_id"], ordered["place"], "role", "text", "before", "edit", "after")
    line = F.when(F.col("edit") == "D", "").otherwise(F.concat(F.lit("\n"), F.when(F.col("edit") == "K", F.col("role")).otherwise(F.substring("edit", 2, 9)), F.lit(":"), F.col("text")))
    made = lambda c: F.array_join(F.transform(F.filter(F.split(c, ","), lambda r: r != ""), lambda r: F.concat(F.lit("\n"), r, F.lit(":"))), "")
    shas = joined_sha256(texts, "conv_id", "place", F.concat(made("before"), line, made("after")), "repaired_sha256")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    faults = turns.groupBy("conv_id").agg(count("blank"), count("duplicate"), count("truncated"))
    spans = turns.groupBy("conv_id", "turn").count().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    pairs = chunks.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    out = faults
    for part in (spans, pairs, root.select("conv_id", "cost", "audit"), shas):
        out = out.join(part, out["conv_id"].eqNullSafe(part["conv_id"])).drop(part["conv_id"])
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired; those that the damage leaves without turns too."""
    found = repaired(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["conv_id"]), "left").drop(found["conv_id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
