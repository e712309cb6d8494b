"""Repair of conversations at least cost: rank-convergence parallel Viterbi.

A repaired conversation is empty, or an optional system turn before user and assistant turns in alternation. Going over its rows,
one keeps a row, gives it another role, deletes it (blank and repeated rows must go) or inserts an empty turn before it. The
least cost from each of four states to the end is a vector, found from the last row back. Rows are ordered by range partitions and
cut into chunks, each a string of one letter a row. All chunks of long conversations start at once from speculative vectors;
fix-up passes give a chunk the vector that the next one has found and rerun it until old and new vectors differ by a constant only,
from where on nothing changes. Some rows never make vectors agree (a run of one role keeps its parity): what is unsettled
after FIXUPS passes is folded exactly from the chunks' cost matrices, a row a chunk. With all vectors stitched, each chunk traces
its edits forward, the least letter among those of least cost first.

Nulls in any column count as one space, except that null turns come first and are no turns for gaps. Turns that are equal go by
role, then by the text's XXH64; equal rows are repeats. An empty table gives no rows; further columns are not read.
A conversation's hash is fed in order as rows stream by, its length does not matter to memory; its audit is one string.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserax.llm.common import materialise, partitions

#: Rows of a conversation in a chunk are 2 to this power at most.
CHUNK_BITS = 16
#: Passes before chunks that do not converge are folded.
FIXUPS = 3

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, system, user, assistant. A new or rerouted turn leads from each to NEXT; KEEP has where roles s, u, a lead.
NEXT, ENDS = (2, 2, 3, 2), (0, 3)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: A row's letter: its role's initial, in capitals if truncated; what must be deleted has its own letters.
FINE, CUT, FORCED = "suax", "SUAX", "bcde"
TERMINAL, FLAT = "0 10 5 0", "0 0 0 0"
FAR = 10**6
SPACE = r"\x20\x09-\x0D"

# Damage and faults: columns and aggregates


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of stops, repeated or given to the user, by the CRC of conv_id and turn modulo 20."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("d"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.filter("d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """rows in order, written: gid grows with conv_id, turn, role and text over all partitions, which no one conversation can fill."""
    rows = rows.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h", "tie"]
    rows = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return materialise(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("gid")), "ordered")


def faults(rows: DataFrame) -> DataFrame:
    """(gid, conv_id, turn, fault, letter): each row's first fault, 'blank', 'duplicate', 'truncated' or null, and its letter."""
    seen = rows.filter(F.col("text").rlike(f"[^{SPACE}]")).groupBy("conv_id", "role", F.md5(F.col("text").cast("binary")).alias("m")).agg(F.min("gid").alias("gid"))
    marked = rows.select(
        "gid", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"),
    ).join(seen.select("gid", F.lit(True).alias("new")), "gid", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(F.col("fault").isNull(), known).when(F.col("fault") == "truncated", F.upper(known)).otherwise(F.translate(known, FINE, FORCED))
    return marked.withColumn("fault", fault).select("gid", "conv_id", "turn", "fault", letter.alias("letter"))


def chunks(marked: DataFrame) -> DataFrame:
    """(conv_id, start, letters, last, many, after), written: a row for each run of a conversation's rows in a block of a partition."""
    block = F.shiftright("gid", CHUNK_BITS)
    runs = marked.groupBy("conv_id", block.alias("block")).agg(F.min("gid").alias("start"), F.sort_array(F.collect_list(F.struct("gid", "letter"))).alias("rows"))
    runs = runs.select("conv_id", "start", F.array_join("rows.letter", "").alias("letters"))
    own = Window.partitionBy("conv_id")
    after = F.lead(F.substring("letters", 1, 1)).over(own.orderBy("start"))
    return materialise(runs.select("*", after.isNull().alias("last"), (F.count("*").over(own) > 1).alias("many"), after.alias("after")), "chunks")


# The machine: vectors less their least number, of which there are few, so a row costs a look-up


def _choices(q: int, letter: str, after: tuple) -> list[tuple]:
    """(cost, rank of the edit, next state, edit) of each edit of the row in state q: D, K and R are in the order of their letters."""
    found = [(DELETE + after[q], 0, q, "D")]
    if letter not in FORCED:
        extra, role = (TRUNCATED if letter in CUT else 0), letter.lower()
        if role in KEEP[q]:
            found.append((extra + after[KEEP[q][role]], 2, KEEP[q][role], "K"))
        found.append((REROLE + extra + after[NEXT[q]], 3, NEXT[q], "R"))
    return found


@functools.cache
def _before(letter: str, after: tuple) -> tuple[tuple, int]:
    """(vector before the row less its least number, that number)."""
    own = [min(_choices(q, letter, after))[0] for q in range(4)]
    full = [min(own[q], INSERT + own[NEXT[q]], 2 * INSERT + own[NEXT[NEXT[q]]]) for q in range(4)]
    low = min(full)
    return tuple(x - low for x in full), low


@functools.cache
def _move(q: int, letter: str, after: tuple) -> tuple[str, int, int]:
    """(edits, next state, cost) of the row in state q; u, a: inserted user, assistant; U, A: rerouted to them."""
    (before, low), edits, cost = _before(letter, after), "", 0
    while True:
        best = {rank: (to, edit) for c, rank, to, edit in _choices(q, letter, after) if c == before[q] + low}
        if 0 not in best and INSERT + before[NEXT[q]] == before[q]:
            q, cost = NEXT[q], cost + INSERT
            edits += FINE[q - 1]
            continue
        to, edit = best[min(best)]
        cost += DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (TRUNCATED if letter in CUT else 0)
        return edits + (FINE[to - 1].upper() if edit == "R" else edit), to, cost


def _vector(text: str) -> tuple:
    low = min(v := [int(x) for x in text.split()])
    return tuple(x - low for x in v)


def _text(vector: tuple) -> str:
    return " ".join(map(str, vector))


def backward(letters: str, end: str) -> str:
    """The vector before the first row, from that after the last."""
    v = _vector(end)
    for x in reversed(letters):
        v = _before(x, v)[0]
    return _text(v)


def rerun(letters: str, old_end: str, new_end: str, old_start: str) -> str:
    """backward(letters, new_end), only as far as the vectors of the old end differ by more than a constant."""
    old, new = _vector(old_end), _vector(new_end)
    for x in reversed(letters):
        if old == new:
            return old_start
        old, new = _before(x, old)[0], _before(x, new)[0]
    return _text(new)


def matrix(letters: str) -> list[list[int]]:
    """For each state after the last row, the costs to it from the states before the first."""
    found = []
    for q in range(4):
        v, total = tuple(0 if p == q else FAR for p in range(4)), 0
        for x in reversed(letters):
            v, low = _before(x, v)
            total += low
        found.append([c + total for c in v])
    return found


def traced(letters: str, end: str, q: int, last: bool) -> tuple[str, int, int]:
    """(edits of the rows, a comma between rows, cost, state after the last row)."""
    after, v = [], _vector(end)
    for x in reversed(letters):
        after.append(v)
        v = _before(x, v)[0]
    pieces, total = [], 0
    for x, v in zip(letters, reversed(after), strict=True):
        edits, q, cost = _move(q, x, v)
        pieces.append(edits)
        total += cost
    while last and q not in ENDS:
        q, total = NEXT[q], total + INSERT
        pieces[-1] += FINE[q - 1]
    return ",".join(pieces), total, q


# Passes over the chunks


def _backward() -> Column:
    return F.pandas_udf(lambda letters, end: pd.Series([backward(*x) for x in zip(letters, end, strict=True)]), "string")


def _rerun() -> Column:
    return F.pandas_udf(lambda a, b, c, d: pd.Series([rerun(*x) for x in zip(a, b, c, d, strict=True)]), "string")


def _exits():
    def each(letters: pd.Series, end: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series(["".join(str(traced(a, b, q, c)[2]) for q in range(4)) for a, b, c in zip(letters, end, last, strict=True)])

    return F.pandas_udf(each, "string")


def _matrices():
    return F.pandas_udf(lambda letters: pd.Series([sum(matrix(x), []) for x in letters]), "array<long>")


def _traced():
    def each(letters: pd.Series, end: pd.Series, state: pd.Series, last: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([traced(*x) for x in zip(letters, end, state, last, strict=True)], columns=["edits", "cost", "state"])

    return F.pandas_udf(each, "edits string, cost long, state int")


def _fold(found: pd.DataFrame) -> pd.DataFrame:
    """The vectors after a conversation's chunks, from their matrices."""
    found, v, ends = found.sort_values("start"), _vector(TERMINAL), []
    for m in reversed(found["m"].tolist()):
        ends.append(_text(v))
        full = [min(int(m[4 * q + p]) + v[q] for q in range(4)) for p in range(4)]
        v = tuple(x - min(full) for x in full)
    return pd.DataFrame({"start": found["start"], "end": ends[::-1]})


def _states(found: pd.DataFrame) -> pd.DataFrame:
    """The state before each of a conversation's chunks, from where each state leads in them."""
    found, q, states = found.sort_values("start"), 0, []
    for x in found["exits"]:
        states.append(q)
        q = int(x[q])
    return pd.DataFrame({"start": found["start"], "state": states})


def stitched(many: DataFrame, passes: int | None = None) -> DataFrame:
    """(start, end, state): the vector after each chunk of the long conversations, and the state before it."""
    passes = FIXUPS if passes is None else passes
    order = Window.partitionBy("conv_id").orderBy("start")
    first = many.withColumn("end", F.when(F.col("last"), TERMINAL).otherwise(FLAT))
    now = materialise(first.withColumn("front", _backward()("letters", "end")), "speculated")
    wanted = lambda df: df.withColumn("want", F.when(F.col("last"), F.col("end")).otherwise(F.lead("front").over(order)))
    for k in range(passes):
        if wanted(now).filter("want <> end").isEmpty():
            break
        moved = F.when(F.col("want") != F.col("end"), _rerun()("letters", "end", "want", "front")).otherwise(F.col("front"))
        now = materialise(wanted(now).withColumn("front", moved).withColumn("end", F.col("want")).drop("want"), f"pass{k}")
    open_ = materialise(wanted(now).filter("want <> end").select("conv_id").distinct(), "open")
    if not open_.isEmpty():
        rest = now.join(open_, now.conv_id.eqNullSafe(open_.conv_id), "leftsemi")
        exact = rest.select("conv_id", "start", _matrices()("letters").alias("m")).groupBy("conv_id").applyInPandas(_fold, "start long, end string")
        now = now.join(exact.withColumnRenamed("end", "exact"), "start", "left").withColumn("end", F.coalesce("exact", "end")).drop("exact")
    now = materialise(now, "settled")
    states = now.select("conv_id", "start", _exits()("letters", "end", "last").alias("exits")).groupBy("conv_id").applyInPandas(_states, "start long, state int")
    return now.select("start", "end").join(states, "start")


def edited(found: DataFrame) -> DataFrame:
    """(conv_id, start, edits, cost), written: the edits of each chunk's rows in the cheapest repair, the ASCII-least of equals."""
    done = stitched(found.filter("many"))
    both = found.join(done, "start", "left").select("conv_id", "start", "letters", "last", F.coalesce("end", F.lit(TERMINAL)).alias("end"), F.coalesce("state", F.lit(0)).alias("state"))
    return materialise(both.select("conv_id", "start", _traced()("letters", "end", "state", "last").alias("t")).select("conv_id", "start", "t.edits", "t.cost"), "edited")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, gid, turn, edits, role, text): each ordered row with its edits; role is what it has now, null if the row is deleted."""
    each = edits.select("start", F.posexplode(F.split("edits", ",")).alias("k", "edits")).select((F.col("start") + F.col("k")).alias("gid"), "edits")
    own = F.regexp_extract("edits", "([DKUA])", 1)
    role = F.when(own == "K", F.col("role")).when(own == "U", "user").when(own == "A", "assistant")
    return rows.join(each, "gid").select("conv_id", "gid", "turn", "edits", role.alias("role"), "text")


def lines(found: DataFrame) -> DataFrame:
    """(conv_id, gid, line): what each row and the turns inserted beside it leave of the conversation, role:text, a line each."""
    parts = F.transform(
        F.split("edits", "(?<=.)(?=.)"),
        lambda x: F.when(x == "u", "user:").when(x == "a", "assistant:").when(x != "D", F.concat(F.col("role"), F.lit(":"), F.col("text"))),
    )
    return found.select("conv_id", "gid", F.array_compact(parts).alias("parts")).filter(F.size("parts") > 0).select("conv_id", "gid", F.array_join("parts", "\n").alias("line"))


def digests(found: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines of each conversation that has any, in order; lines stream through, none is held."""
    kind = found.schema["conv_id"].dataType

    def each(batches):
        name, state = None, None
        for b in batches:
            ids, out = [], []
            for i, line in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if state is None or i != name:
                    if state is not None:
                        ids.append(name)
                        out.append(state.hexdigest())
                    name, state = i, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(out, pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], b.schema.field(0).type), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    rows = found.repartition(partitions(found.sparkSession), "conv_id").sortWithinPartitions("conv_id", "gid")
    return rows.mapInArrow(each, f"conv_id {kind.simpleString()}, sha256 string")


def audited(turns: DataFrame) -> DataFrame:
    """Per conversation of turns: the faults that damage left, the cheapest repair's cost and edits, and the repaired text's hash."""
    rows = ordered(damaged(turns))
    marked = materialise(faults(rows), "faults")
    found = chunks(marked)
    edits = edited(found)
    count = lambda x: F.sum((F.col("fault") == x).cast("long"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    per_row = marked.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *(count(x).alias(x) for x in ("blank", "duplicate", "truncated")))
    roles = F.translate(F.concat("letters", F.coalesce("after", F.lit(""))), CUT + FORCED, FINE + FINE)
    wrong = F.length(roles) - 1 - F.regexp_count(roles, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    per_chunk = found.groupBy("conv_id").agg(F.sum(wrong).alias("illegal"))
    letters = F.translate(F.col("edits"), "uaUA,", "IIRR")
    whole = F.array_join(F.sort_array(F.collect_list(F.struct("start", letters.alias("x"))))["x"], "")
    per_edit = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), whole.alias("audit"))
    parts = [turns.select("conv_id").distinct(), per_row, per_chunk, per_edit, digests(lines(repaired(rows, edits)))]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
