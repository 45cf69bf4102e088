"""Cheapest repair of conversations, by a Viterbi recursion whose chunks run in parallel.

A conversation is repaired if its role initials read ``(s?(ua)+)?``. Turns may be kept,
given another role, deleted, or added; the cheapest edits follow from the least cost to go
from each of four states (nothing yet, after s, after u, after a) before each turn. A turn
that has to be deleted costs the same from every state, so only the other, live ones count.

The live turns of all conversations are numbered in order and cut into chunks of bounded
size, so one conversation may be cut over many tasks. Costs run backward. Each chunk starts
from a speculative vector of costs to go, the last one of a conversation from the true one.
Where a vector turns out to differ from the one that the next chunk begins with, and not by
a constant alone, the chunk is run again, both vectors side by side, until they differ by a
constant: from there on the earlier run holds. Passes are repeated until none is left.
Vectors that differ by a constant lead to the same edits, so each chunk then traces its own
from the stitched costs: letter by letter the least in ASCII that is still on a cheapest
path. The state a chunk is entered in comes from the maps of states through the chunks
before it, composed two by two, so their number counts by its logarithm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.llm.common import stored

#: Live turns of one conversation in a chunk at most; a chunk is a short string.
CHUNK = 1024
SPACE = " \t\n\x0b\f\r"
#: Numbers in one table of costs at most, so that a step's memory does not follow the batch.
_CELLS = 1 << 20

# --- The recursion over a matrix of turns, a row per chunk ------------------------

#: Turns that need not be deleted: by initial (x: another), upper case if truncated. A blank pads.
SYMBOLS = "suaxSUAX "
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ADDED = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])  # what an added or re-roled turn leads to
ADDED_TWICE = ADDED[ADDED]
_NEVER = 1 << 40
_KEPT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
KEEP_TO = np.array([[_KEPT.get(c.lower(), {}).get(s, s) for s in range(4)] for c in SYMBOLS])
KEEP_COST = np.array([[int(c.isupper()) if s in _KEPT.get(c.lower(), {}) else _NEVER for s in range(4)] for c in SYMBOLS])
REROLE_COST = np.array([_NEVER if c == " " else 2 + c.isupper() for c in SYMBOLS])
DELETE_COST = np.array([0 if c == " " else 3 for c in SYMBOLS])
#: Costs to go after the last turn: add nothing, u and a, or a.
END = (0, 4, 2, 0)
_CODE = np.full(256, SYMBOLS.index(" "), np.uint8)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


def codes_of(texts: list[str]) -> np.ndarray:
    """Symbols as numbers, a row per text, filled up at the right."""
    width = max(map(len, texts), default=0)
    return _CODE[np.frombuffer("".join(t.ljust(width) for t in texts).encode(), np.uint8)].reshape(len(texts), width)


def step(after: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Costs to go before a turn from those after it; turns added before it included."""
    keep = KEEP_COST[codes] + np.take_along_axis(after, KEEP_TO[codes], 1)
    least = np.minimum(np.minimum(DELETE_COST[codes][:, None] + after, keep), REROLE_COST[codes][:, None] + after[:, ADDED])
    return np.minimum(np.minimum(least, 2 + least[:, ADDED]), 4 + least[:, ADDED_TWICE])


def whole_run(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go before each turn and after the last: an array of turns + 1, chunks, states."""
    table = np.empty((codes.shape[1] + 1, len(codes), 4), np.int64)
    table[-1] = end
    for t in range(codes.shape[1] - 1, -1, -1):
        table[t] = step(table[t + 1], codes[:, t])
    return table


def fix_up(codes: np.ndarray, end: np.ndarray, old_end: np.ndarray, old_start: np.ndarray) -> tuple[np.ndarray, int]:
    """Vectors before the chunks for new ones after them, and how many turns were run again.

    A chunk stops where the new and the old vector differ by a constant: from there on,
    its old vector holds but for that constant.
    """
    new, old, found = end.copy(), old_end.copy(), np.zeros_like(end)
    running, t = np.arange(len(codes)), codes.shape[1]
    turns = 0
    while True:
        apart = new[running] - old[running]
        parallel = (apart == apart[:, :1]).all(axis=1)
        found[running[parallel]] = old_start[running[parallel]] + apart[parallel, :1]
        running = running[~parallel]
        if not len(running) or not t:
            break
        t -= 1
        turns += len(running)
        new[running] = step(new[running], codes[running, t])
        old[running] = step(old[running], codes[running, t])
    found[running] = new[running]
    return levelled(found), turns


def levelled(vectors: np.ndarray) -> np.ndarray:
    """The same vectors with a least entry of 0: equal if they differed by a constant."""
    return vectors - vectors.min(axis=1, keepdims=True)


def trace(codes: np.ndarray, table: np.ndarray, state: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Least edits from each chunk's state: the states after it, edits per turn, and edits after a conversation's last.

    Edits are written as i and j (a user or assistant turn added), D, K, and u and a (given
    that role). Without ``last``, no edits are written.
    """
    n, width = codes.shape
    state, at = state.copy(), np.arange(n)
    marks = np.zeros((n, width, 3), np.uint8)
    for t in range(width):
        code, here, after = codes[:, t], table[t], table[t + 1]
        open_ = np.flatnonzero(code != SYMBOLS.index(" "))
        for k in range(3):
            if not len(open_):
                break
            s, c = state[open_], code[open_]
            cost = here[open_, s]
            delete = DELETE_COST[c] + after[open_, s] == cost
            add = ~delete & (2 + here[open_, ADDED[s]] == cost)
            keep = ~delete & ~add & (KEEP_COST[c, s] + after[open_, KEEP_TO[c, s]] == cost)
            to = np.where(delete, s, np.where(keep, KEEP_TO[c, s], ADDED[s]))
            user = ADDED[s] == AFTER_U
            letter = np.where(user, ord("u"), ord("a"))
            letter = np.where(keep, ord("K"), np.where(add, np.where(user, ord("i"), ord("j")), np.where(delete, ord("D"), letter)))
            marks[open_, t, k] = letter
            state[open_] = to
            open_ = open_[add]
    if last is None:
        return state, marks, []
    tails = {START: "", AFTER_S: "ij", AFTER_U: "j", AFTER_A: ""}
    return state, marks, [tails[int(s)] if end else "" for s, end in zip(state[at], last, strict=True)]


# --- Rows -------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by a hash of their place; nulls are read as one space in texts, roles and the hash."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = rows.filter("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return kept.drop("copy")


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows stored with ``place``: their number in the order, from 0, without gaps.

    The order is cut into ranges, each sorted by its own task. A table of one row per range
    adds up the ranges before; it is as long as the shuffle has partitions, and is broadcast.
    """
    columns = [F.col(c).asc_nulls_first() for c in order]
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = stored(ranged.withColumn("within", F.monotonically_increasing_id()), name)
    numbered = ranged.withColumn("part", F.shiftright("within", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    shifts = stored(counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift")), f"{name}-ranges")
    place = F.col("shift") + F.col("within").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(shifts), "part").withColumn("place", place).drop("part", "shift", "within")


def judged(turns: DataFrame) -> DataFrame:
    """Turns of conv_id, turn, role, text (no nulls in role and text) in order, each with its first ``fault``.

    Adds ``k`` (the conversation, never null), ``place``, ``initial`` (s, u, a, or x) and
    ``fault``: blank, duplicate, truncated or null.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    # Equal rows stay apart by where they were read, so that no range has to take all copies.
    rows = turns.select(key.alias("k"), "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("tie"))
    rows = in_order(rows, ["k", "turn", "role", "text", "tie"], "repair-turns").drop("tie")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    first = F.substring("role", 1, 1)
    rows = rows.select(
        "*",
        F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
        (last == "").alias("blank"),
        last.isin(".", "!", "?").alias("ended"),
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), F.col("role"), F.col("text")).alias("h2"),
    )
    same = rows.filter("not blank").groupBy("k", "h1", "h2").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("rows"))
    same = stored(same.filter("rows > 1").select("k", "h1", "h2", "earliest"), "repair-repeated")
    rows = rows.join(same, ["k", "h1", "h2"], "left")
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("place") > F.col("earliest"), "duplicate").when(~F.col("ended"), "truncated")
    )
    return rows.select("k", "conv_id", "turn", "role", "text", "place", "initial", fault.alias("fault"))


def illegal_steps(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(k, illegal): neighbours whose initials are not su, ua or au.

    Initials are gathered by stretches of bounded size; the last turn of a stretch is also
    the first of the next, so no pair is lost or counted twice.
    """
    stretch = F.expr(f"place div {chunk}")
    ends = F.when(F.col("place") % chunk == chunk - 1, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    parts = turns.select("k", "place", "initial", F.explode(ends).alias("stretch")).groupBy("k", "stretch")
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "initial"))), lambda x: x["initial"]), "")
    wrong = F.length("shown") - 1 - F.regexp_count("shown", F.lit("(?=su|ua|au)"))
    return parts.agg(shown.alias("shown")).groupBy("k").agg(F.sum(wrong).cast("long").alias("illegal"))


# --- Chunks ------------------------------------------------------------------------


def chunks_of(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(k, block, first, last, places, symbols): live turns in pieces of at most ``chunk``, stored."""
    live = turns.filter("fault is null or fault = 'truncated'")
    symbol = F.when(F.col("fault").isNotNull(), F.upper("initial")).otherwise(F.col("initial"))
    live = live.select("k", F.col("place").alias("turn_place"), symbol.alias("symbol"))
    live = in_order(live, ["turn_place"], "repair-live").withColumn("block", F.expr(f"place div {chunk}"))
    held = F.sort_array(F.collect_list(F.struct("turn_place", "symbol")))
    pieces = live.groupBy("k", "block").agg(held.alias("held"))
    pieces = pieces.select(
        "k", "block", F.col("held.turn_place").alias("places"), F.array_join("held.symbol", "").alias("symbols")
    )
    pieces = stored(pieces, "repair-chunks")
    spans = pieces.groupBy("k").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    return stored(pieces.join(stored(spans, "repair-spans"), "k"), "repair-chunks")


_VECTOR = "array<int>"


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).astype(np.int64)


def _listed(vectors: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * 4), pa.array(vectors.reshape(-1).astype(np.int32)))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches with their symbols as numbers: chunks of like length together, tables of bounded size."""
    for batch in batches:
        lengths = np.array([len(t) for t in batch.column("symbols").to_pylist()])
        order = np.argsort(lengths, kind="stable")[::-1]
        begin = 0
        while begin < len(order):
            rows = max(1, _CELLS // (4 * (int(lengths[order[begin]]) + 1)))
            part = batch.take(pa.array(order[begin : begin + rows]))
            yield part, codes_of(part.column("symbols").to_pylist())
            begin += rows


def _with(part: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    for name, column in columns.items():
        i = part.schema.get_field_index(name)
        part = part.set_column(i, name, column) if i >= 0 else part.append_column(name, column)
    return part


def _costs(chunks: DataFrame) -> DataFrame:
    """Chunks of conversations with several, with ``end``: true costs to go after each, but for a constant."""

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes in _by_length(batches):
            end = np.tile(np.array(END), (len(codes), 1))
            start = levelled(whole_run(codes, end)[0]) if len(codes) else end
            yield _with(part, end=_listed(end), start=_listed(start))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes in _by_length(batches):
            old_end, start = _vectors(part.column("end")), _vectors(part.column("start"))
            wanted = _vectors(part.column("wanted"))
            start, _ = fix_up(codes, wanted, old_end, start)
            yield _with(part, end=_listed(wanted), start=_listed(start)).drop_columns(["wanted"])

    schema = f"k string, block long, first long, last long, symbols string, end {_VECTOR}, start {_VECTOR}"
    several = chunks.filter("first < last").select("k", "block", "first", "last", "symbols")
    state = stored(several.mapInArrow(speculate, schema), "repair-costs")
    while True:
        following = state.select("k", (F.col("block") - 1).alias("block"), F.col("start").alias("wanted"))
        joined = state.join(following, ["k", "block"], "left").withColumn("wanted", F.coalesce("wanted", "end"))
        if joined.filter("wanted <> end").isEmpty():
            return state
        columns = ["k", "block", "first", "last", "symbols", "end", "start"]
        state = stored(joined.select(*columns, "wanted").mapInArrow(again, schema), "repair-costs")


def _entered(costs: DataFrame) -> DataFrame:
    """(k, block, end, state): the state in which the least edits enter each chunk of ``costs``."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes in _by_length(batches):
            table = whole_run(codes, _vectors(part.column("end")))
            to = np.stack([trace(codes, table, np.full(len(codes), s), None)[0] for s in range(4)], axis=1)
            yield _with(part.select(["k", "block", "first"]), to=_listed(to))

    through = stored(costs.select("k", "block", "first", "symbols", "end").mapInArrow(maps, f"k string, block long, first long, to {_VECTOR}"), "repair-maps")
    through = through.withColumn("origin", F.col("block"))
    settled = (F.col("origin") == F.col("first")) | (F.size(F.array_distinct("to")) == 1)
    while not through.filter(~settled).isEmpty():
        before = through.select("k", (F.col("block") + 1).alias("origin"), F.col("to").alias("by"), F.col("origin").alias("from"))
        joined = through.join(before, ["k", "origin"], "left")
        composed = F.transform("by", lambda s: F.get(F.col("to"), s))
        to = F.when(settled, F.col("to")).otherwise(composed)
        through = stored(joined.select("k", "block", "first", to.alias("to"), F.when(settled, F.col("origin")).otherwise(F.col("from")).alias("origin")), "repair-maps")
    left = through.select("k", (F.col("block") + 1).alias("block"), F.get("to", F.lit(0)).alias("state"))
    found = costs.select("k", "block", "end").join(left, ["k", "block"], "left")
    return stored(found.withColumn("state", F.coalesce("state", F.lit(START))), "repair-entered")


def edits_of(chunks: DataFrame) -> DataFrame:
    """(k, block, cost, places, edits, tail): the least edits before and of each live turn, and after the last."""
    entered = _entered(_costs(chunks))
    several = chunks.filter("first < last").join(entered, ["k", "block"])
    one = chunks.filter("first = last").withColumns({"end": F.array(*map(F.lit, END)), "state": F.lit(START)})
    columns = ["k", "block", "first", "last", "places", "symbols", "end", "state"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes in _by_length(batches):
            blocks, firsts, lasts = (part.column(c).to_numpy(zero_copy_only=False) for c in ("block", "first", "last"))
            table = whole_run(codes, _vectors(part.column("end")))
            state = part.column("state").to_numpy(zero_copy_only=False).astype(np.int64)
            _, marks, tails = trace(codes, table, state, blocks == lasts)
            # From the start for a conversation's first chunk; what a later one adds to the constant for the others.
            cost = np.where(blocks == firsts, table[0][:, START], table[0].min(axis=1))
            lengths = [len(s) for s in part.column("symbols").to_pylist()]
            words = marks.reshape(len(codes), -1).view("S3").astype("U3") if marks.size else np.zeros((len(codes), 0), "U3")
            edits = pa.array([row[:n].tolist() for row, n in zip(words, lengths, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("block"), pa.array(cost, pa.int64()), part.column("places"), edits, pa.array(tails, pa.string())],
                ["k", "block", "cost", "places", "edits", "tail"],
            )

    schema = "k string, block long, cost long, places array<long>, edits array<string>, tail string"
    return stored(one.select(*columns).unionByName(several.select(*columns)).mapInArrow(each, schema), "repair-edits")


# --- Results ------------------------------------------------------------------------

_AFTER_ALL = (1 << 63) - 1


def _edited(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns and edits of each conversation together and in order, in one task each, never held at once."""
    of_turns = edits.select("k", F.explode(F.arrays_zip("places", "edits")).alias("x")).select("k", "x.places", "x.edits")
    none = F.lit(None).cast("string")
    rows = turns.select("k", "place", F.lit(1).alias("part"), none.alias("edits"), "role", "text")
    rows = rows.unionByName(of_turns.select("k", F.col("places").alias("place"), F.lit(0).alias("part"), "edits", none.alias("role"), none.alias("text")))
    tails = edits.filter("tail <> ''").select("k", F.lit(_AFTER_ALL).alias("place"), F.lit(0).alias("part"), F.col("tail").alias("edits"), none.alias("role"), none.alias("text"))
    return rows.unionByName(tails).repartition("k").sortWithinPartitions("k", "place", "part")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(k, letters, turns written) of one row after another."""
    held = ""
    for batch in batches:
        for k, place, part, edits, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if part == 0 and place != _AFTER_ALL:
                held = edits
                continue
            letters = edits if part == 0 else held or "D"
            held, written = "", []
            for letter in letters:
                if letter != "D":
                    new = {"i": "user", "j": "assistant", "u": "user", "a": "assistant"}.get(letter, role)
                    written.append((new, "" if letter in "ij" else text))
            yield k, letters, written


_AUDIT = str.maketrans("ijua", "IIRR")


def _per_conversation(rows: DataFrame) -> DataFrame:
    """(k, audit, repaired_sha256): digests are fed turn by turn, so a text is held alone, and the audit as a result is."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, audit, empty = None, hashlib.sha256(), [], True

        def told() -> pa.RecordBatch:
            columns = [[now], ["".join(audit).translate(_AUDIT)], [digest.hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["k", "audit", "repaired_sha256"])

        for k, letters, written in _replayed(batches):
            if k != now:
                if now is not None:
                    yield told()
                now, digest, audit, empty = k, hashlib.sha256(), [], True
            audit.append(letters)
            for role, text in written:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if now is not None:
            yield told()

    return rows.mapInArrow(each, "k string, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations: conv_id, ``n`` (from 0 in each), role, text.

    Takes what ``repair`` takes, and treats it alike.
    """
    turns = judged(turns)
    turns = stored(turns, "repair-judged")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, out = None, 0, []

        def made() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["k", "n", "role", "text"])

        for k, _, written in _replayed(batches):
            now, n = k, n if k == now else 0
            for role, text in written:
                out.append((k, n, role, text))
                n += 1
            if len(out) >= 1000:
                yield made()
                out = []
        if out:
            yield made()

    rows = _edited(turns, edits_of(chunks_of(turns, chunk))).mapInArrow(each, "k string, n long, role string, text string")
    kind = turns.schema["conv_id"].dataType
    conv_id = F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).cast(kind).alias("conv_id")
    return rows.select(conv_id, "n", "role", "text")


def repair(turns: DataFrame, conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id of ``conversations``: what is wrong with its ``turns``, the cost, the edits and a digest of the result.

    Turns have conv_id, turn, role and text; null roles and texts have to be replaced first
    (``damaged`` does). Order is by turn, nulls first; turns that share a number by role,
    then text, both by code point. A null conv_id names one conversation. Repeated rows are
    duplicates. Conversations without turns have zeros, an empty audit and the digest of
    nothing. ``gaps`` is null where it does not fit a long. An empty table gives no rows.
    Other columns are not read. One conversation may hold any share of the turns: only its
    digest, which has an order, and its audit are put together by one task, turn by turn.
    """
    turns = stored(judged(turns), "repair-judged")
    edits = edits_of(chunks_of(turns, chunk))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    wide = lambda c: c.cast("decimal(38, 0)")
    of = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = (wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")).try_cast("long")
    counts = turns.groupBy("k").agg(
        *map(of, ("blank", "duplicate", "truncated")), F.when(F.max("turn").isNull(), 0).otherwise(gaps).alias("gaps")
    )
    costs = edits.groupBy("k").agg(F.sum("cost").alias("live_cost"))
    everything = conversations.select("conv_id").distinct().withColumn("k", key)
    for part in (counts, costs, illegal_steps(turns, chunk), _per_conversation(_edited(turns, edits))):
        everything = everything.join(part, "k", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    deleted = number(F.col("blank")) + number(F.col("duplicate"))
    return everything.select(
        "conv_id",
        F.when(F.col("blank").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps"),
        *[number(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        (3 * deleted + number(F.col("live_cost"))).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
