"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar.

Three weighted machines are composed state by state, as a search asks for it:
* the input acceptor reads the conversation's rows, each a symbol of its role's initial and its fault;
* the edit transducer keeps a row (0), gives it another role (2), deletes it (3) or inserts an empty row (2); blank and duplicate rows can't stay, and
  rows that end in mid-sentence cost 1 more if they do. It inserts twice in a row at most: any more would come back to where it was, at a cost;
* the role grammar accepts `(s?(ua)+)?` over the initials of the roles that are written.
States of the composition are (place in the input, inserts in a row, grammar state), which is a topological order; weights are (cost, string of the edits'
initials), least first. The arcs of a state have different initials, so the first one settles how two strings compare, and weights
need only keep their cost and first arc. The shortest path is followed from the front.

Rows are shuffled once, by conversation, and repaired in a scan of each sorted partition. Conversations of more than MOST_ROWS rows or MOST_BYTES
bytes go another way, in segments, so no task holds one of them: rows are dealt by ranges of (conversation, turn, ...) into segments; each gives the
costs from each grammar state to each other one (min-plus matrices); one scan over a conversation's matrices tells each segment the state it begins
in and what each state costs after its end; then all segments are walked at once. Which rows repeat an earlier segment's is settled by the
first segment of each digest of role and text. What comes out is one row for each conversation, or segment of one, with its repaired turns.

Order: by turn, nulls first; rows of one turn by role, by the first PREFIX characters of the text, and by the text's SHA-256.
Defined cases: a null role or text counts as one space, a null conv_id or turn stays null (one space in the damage's key); a null conv_id is a conversation
like others. Rows that repeat are rows of their own, all but the first of which are duplicates. An empty role has no initial and can't be kept.
Conversations without rows cost nothing and stay, without turns.
"""

from __future__ import annotations

import hashlib
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import HEAVY, LEAST_HEAVY, marked, read, releasing, stored

#: Beyond these a conversation is worked on in segments of about SEGMENT bytes, of which there are MOST_SEGMENTS at most.
MOST_ROWS, MOST_BYTES = 1 << 14, 8 << 20
SEGMENT, MOST_SEGMENTS = 16 << 20, 1 << 16
PREFIX = 64
WHITE = "\\t\\n\\u000b\\f\\r "
DROP, EMPTY, UNSTOP, REPEAT, TO_USER = range(5)

# Faults of a row, and the grammar over initials of roles: state -> {initial: next state}; it ends in ACCEPTING.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
WRITABLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
IN_A_ROW, FAR = 2, 1 << 40

#: label of the edit, whether it reads a row, inserts in a row after it, initial written ("" for none), whether the row's own role stays, cost
Edit = namedtuple("Edit", "label reads inserts written own cost")


@lru_cache(maxsize=4096)
def edits(symbol: tuple[str, int] | None, inserted: int) -> tuple[Edit, ...]:
    """Arcs of the edit transducer for an input symbol (None: the input's end) after so many inserts in a row."""
    out = [Edit(INSERT, False, inserted + 1, w, False, COSTS[INSERT]) for w in WRITABLE if inserted < IN_A_ROW]
    if symbol is not None:
        initial, fault = symbol
        out.append(Edit(DELETE, True, 0, "", False, COSTS[DELETE]))
        if fault in (FINE, TRUNCATED):
            more = int(fault == TRUNCATED)
            out.append(Edit(KEEP, True, 0, initial, True, COSTS[KEEP] + more))
            out += [Edit(REROLE, True, 0, w, False, COSTS[REROLE] + more) for w in WRITABLE]
    return tuple(out)


@lru_cache(maxsize=4096)
def arcs(symbol: tuple[str, int] | None, inserted: int, state: int) -> tuple[tuple[Edit, int], ...]:
    """(edit, next grammar state) of a state of the composition, by initial: the edits whose output the grammar takes."""
    found = [(e, state if not e.written and e.label == DELETE else GRAMMAR[state].get(e.written)) for e in edits(symbol, inserted)]
    return tuple(sorted(((e, to) for e, to in found if to is not None), key=lambda x: (x[0].label, -x[0].own)))


def relative(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """(costs less the least one, that one), so that equal situations are equal wherever they come."""
    least = min(costs)
    least = 0 if least >= FAR else least
    return tuple(c - least if c < FAR else FAR for c in costs), least


@lru_cache(maxsize=1 << 14)
def layer(symbol: tuple[str, int] | None, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, dict]:
    """(relative costs to the end from each grammar state before a symbol, their least, each state's first arc), given the costs after it.

    At the input's end (None) `after` is what stopping costs.
    """
    cost, first = {}, {}
    for inserted in range(IN_A_ROW, -1, -1):
        for state in range(len(GRAMMAR)):
            best, arc = (FAR, None) if symbol is not None else (after[state], None)
            for e, to in arcs(symbol, inserted, state):
                total = e.cost + (after[to] if e.reads else cost[e.inserts, to])
                if total < best:  # arcs come by initial, so the first of equals has the least string
                    best, arc = total, (e, to)
            cost[inserted, state], first[inserted, state] = min(best, FAR), arc
    return *relative([cost[0, s] for s in range(len(GRAMMAR))]), first


#: What each grammar state costs at the end of a conversation, its inserts included, and the arcs there.
AT_END, _, STOPS = layer(None, tuple(0 if s in ACCEPTING else FAR for s in range(len(GRAMMAR))))


def costs_before(symbols: list[tuple[str, int]], after: tuple[int, ...]) -> list[int]:
    """Costs to the end from each grammar state before these rows, inserts before each row included."""
    after, total = relative(after)
    for symbol in reversed(symbols):
        after, more, _ = layer(symbol, after)
        total += more
    return [c + total if c < FAR else FAR for c in after]


def matrix(symbols: list[tuple[str, int]]) -> list[int]:
    """Costs from each grammar state to each one over these rows, row by row."""
    n = range(len(GRAMMAR))
    columns = [costs_before(symbols, tuple(0 if s == to else FAR for s in n)) for to in n]
    return [columns[to][s] for s in n for to in n]


def shortest_path(symbols: list[tuple[str, int]], state: int, after: tuple[int, ...], end: bool) -> Iterator[tuple[Edit, int | None, int]]:
    """(edit, place of the row that it reads, grammar state then) along the least path from a grammar state; `end`: the conversation ends with these rows."""
    firsts, after = [], relative(after)[0]
    for symbol in reversed(symbols):
        after, _, first = layer(symbol, after)
        firsts.append(first)
    for i in range(len(symbols)):
        first, inserted = firsts[len(symbols) - i - 1], 0
        while True:
            e, state = first[inserted, state]
            yield e, i if e.reads else None, state
            if e.reads:
                break
            inserted = e.inserts
    inserted = 0
    while end and (arc := STOPS[inserted, state]) is not None:
        e, state = arc
        yield e, None, state
        inserted = e.inserts


def damage_key() -> Column:
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return F.crc32(key.cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with each row dropped, emptied, stripped of stops, repeated or made the user's, by crc32 of `conv_id:turn`."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), damage_key().alias("how"))
    text = F.when(F.col("how") == EMPTY, "").when(F.col("how") == UNSTOP, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where(F.col("how") != DROP).select("conv_id", "turn", F.when(F.col("how") == TO_USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == REPEAT, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def looked_at(rows: DataFrame) -> DataFrame:
    """rows with `look`: FINE, TRUNCATED or BLANK; nulls as one space."""
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    bare = F.expr(f"rtrim('{WHITE}', text)")
    return rows.withColumn("look", F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED))


def in_order() -> list[Column]:
    """The order of a conversation's rows."""
    return [F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, PREFIX), F.sha2("text", 256)]


#: One row for each conversation (segment 0), or for each segment of one. illegal and turns count what a segment adds to those before it.
PIECE = "segment int, rows long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, cost long, audit string, repaired array<struct<role:string,text:string>>"
COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns")
#: What the other segments need to know of one: also the ends, the symbols and the costs between grammar states.
KNOWN = PIECE[: PIECE.index("cost long")] + "first string, last string, initials array<string>, faults array<int>, costs array<long>"


def faults(roles: list[str], texts: list[str], looks: list[int], before: list[bool]) -> list[int]:
    """The fault of each row; before: whether an earlier segment has its role and text."""
    seen, out = set(), []
    for role, text, look, old in zip(roles, texts, looks, before, strict=True):
        if look != BLANK:
            look = DUPLICATE if old or (role, text) in seen else look
            seen.add((role, text))
        out.append(look)
    return out


def runs(batches, keys: tuple[str, ...]):
    """(key, columns as lists) of each run of equal keys of sorted batches."""
    held: dict[str, list] = {}
    at = None
    for batch in batches:
        columns = {c: batch.column(k).to_pylist() for k, c in enumerate(batch.schema.names)}
        places = list(zip(*[columns[k] for k in keys], strict=True))
        for key, group in groupby(range(len(places)), places.__getitem__):
            group = list(group)
            if key != at or not held:
                if held:
                    yield at, held
                at, held = key, {c: [] for c in columns}
            for c, values in columns.items():
                held[c] += values[group[0] : group[-1] + 1]
    if held:
        yield at, held


LEGAL = ("su", "ua", "au")


def counted(own: dict[str, list], found: list[int]) -> dict:
    """What is counted over some rows in order."""
    initials = [r[:1] for r in own["role"]]
    turns = [t for t in own["turn"] if t is not None]
    of = {"rows": len(found), "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(TRUNCATED)}
    of["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return of | {"low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "first": initials[0], "last": initials[-1], "initials": initials, "faults": found}


def turns_of(path, own: dict[str, list]) -> dict:
    """cost, string of the edits' initials, and repaired turns of a path."""
    cost, audit, turns = 0, [], []
    for e, i, _ in path:
        cost += e.cost
        audit.append(e.label)
        if e.label != DELETE:
            turns.append({"role": own["role"][i] if e.own else WRITABLE[e.written], "text": "" if i is None else own["text"][i]})
    return {"cost": cost, "audit": "".join(audit), "repaired": turns}


def size_of(own: dict[str, list]) -> int:
    return sum(map(len, own["text"])) + 64 * len(own["text"])


#: Characters, about, that are given to Spark together.
TOGETHER = 1 << 20


def emitted(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)


def arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def in_batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema):
    """Batches of rows(row, its size)."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= TOGETHER:
            yield emitted(held, schema)
            held, size = [], 0
    if held:
        yield emitted(held, schema)


def typed(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "look")


def repair_short(rows: DataFrame) -> DataFrame:
    """Conversations that a task can hold -> conv_id and PIECE, one row each."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {PIECE}"
    out = arrow(rows.sparkSession, schema)

    def scan(batches):
        def each():
            for (conv,), own in runs(batches, ("conv_id",)):
                found = faults(own["role"], own["text"], own["look"], [False] * len(own["role"]))
                path = shortest_path(symbols(own["role"], found), 0, AT_END, True)
                yield {"conv_id": conv, "segment": 0} | counted(own, found) | turns_of(path, own), size_of(own)

        yield from in_batches(each(), out)

    dealt = typed(rows).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *in_order())
    return dealt.mapInArrow(releasing(scan), schema)


def symbols(initials: list[str], found: list[int]) -> list[tuple[str, int]]:
    return [(r[:1], f) for r, f in zip(initials, found, strict=True)]


def segmented(rows: DataFrame, segments: int) -> DataFrame:
    """rows with the number of their segment, in order over each conversation, and `before`: whether an earlier segment has their role and text."""
    what = F.sha2(F.concat_ws("\x00", F.col("conv_id").isNull().cast("string"), F.col("conv_id").cast("string"), F.octet_length("role").cast("string"), "role", "text"), 256)
    dealt = typed(rows).repartitionByRange(segments, F.asc_nulls_first("conv_id"), *in_order()).withColumns({"segment": F.spark_partition_id(), "what": what})
    dealt = stored(dealt, "segments")
    seen = stored(dealt.groupBy("what").agg(F.min("segment").alias("lead"), F.max("segment").alias("tail"), F.count("*").alias("n")).where("lead < tail").select("what", "lead", "n"), "seen")
    # fewer than HEAVY digests are broadcast; the rest meet theirs in a plain join
    heavy = F.col("n") > max(LEAST_HEAVY, dealt.count() // HEAVY)
    hot = F.broadcast(seen.where(heavy).select("what", "lead"))
    rest = dealt.join(F.broadcast(seen.where(heavy).select("what")), "what", "left_anti").join(seen.where(~heavy).select("what", "lead"), "what", "left")
    return dealt.join(hot, "what").unionByName(rest).withColumn("before", F.coalesce(F.col("lead") < F.col("segment"), F.lit(False))).drop("what", "lead")


def repair_long(rows: DataFrame, segments: int) -> DataFrame:
    """Conversations of any length -> conv_id and PIECE, a row for each segment."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    own = stored(segmented(rows, segments), "rows")
    place = [F.asc_nulls_first("conv_id"), F.col("segment")]
    sorted_rows = lambda df: df.repartition("conv_id", "segment").sortWithinPartitions(*place, *in_order())

    def per_segment(schema: str, each):
        out = arrow(rows.sparkSession, schema)
        return lambda batches: in_batches(((r, 256 + 16 * r["rows"]) for r in each(batches)), out)

    def know(batches):
        for (conv, segment), held in runs(batches, ("conv_id", "segment")):
            found = faults(held["role"], held["text"], held["look"], held["before"])
            yield {"conv_id": conv, "segment": segment, "costs": matrix(symbols(held["role"], found))} | counted(held, found)

    known = stored(sorted_rows(own).mapInArrow(releasing(per_segment(schema := f"conv_id {kind}, {KNOWN}", know)), schema), "known")

    # what each state costs after a segment, from the last one back; what the segment before it had
    def backward(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["segment"])
        after, last = list(AT_END), len(held) - 1
        for k in range(last, -1, -1):
            r = held[k]
            r["after"], r["final"] = after, k == last
            n = len(AT_END)
            after = [min(min(r["costs"][s * n + t] + r["after"][t] for t in range(n)), FAR) for s in range(n)]
            if k:
                r["illegal"] += held[k - 1]["last"] + r["first"] not in LEGAL
        high = None
        for r in held:
            r["turns"] -= r["low"] is not None and r["low"] == high
            high = high if r["high"] is None else r["high"]
        return pa.Table.from_pylist([{n: r[n] for n in ends.names} for r in held], ends)

    ends = arrow(rows.sparkSession, END := f"conv_id {kind}, segment int, after array<long>, final boolean, illegal long, turns long")
    ended = stored(known.drop("initials", "faults").groupBy("conv_id").applyInArrow(backward, END), "ends")
    meet = lambda a, b: a.join(b.withColumnsRenamed({"conv_id": "_conv", "segment": "_segment"}), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment"))).drop("_conv", "_segment")

    # where each state of the grammar leads over a segment, then the state that each segment begins in
    def lead(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own = symbols(r["initials"], r["faults"])
                yield {"conv_id": r["conv_id"], "segment": r["segment"], "rows": 1, "to": [last_state(own, s, r["after"]) for s in range(len(AT_END))]}

    def last_state(own, state, after):
        if costs_before(own, after)[state] >= FAR:
            return 0  # no way leads through it
        for _, _, state in shortest_path(own, state, after, False):
            pass
        return state

    def forward(table: pa.Table) -> pa.Table:
        state, out = 0, []
        for r in sorted(table.to_pylist(), key=lambda r: r["segment"]):
            out.append({"conv_id": r["conv_id"], "segment": r["segment"], "state": state})
            state = r["to"][state]
        return pa.Table.from_pylist(out, begins)

    begins = arrow(rows.sparkSession, BEGIN := f"conv_id {kind}, segment int, state int")
    leads = meet(known.select("conv_id", "segment", "initials", "faults"), ended.select("conv_id", "segment", "after")).mapInArrow(releasing(per_segment(schema := f"conv_id {kind}, segment int, to array<int>", lead)), schema)
    begun = leads.groupBy("conv_id").applyInArrow(forward, BEGIN)
    told = stored(meet(ended, begun), "told")

    def walk(batches):
        for (conv, segment), held in runs(batches, ("conv_id", "segment")):
            found = faults(held["role"], held["text"], held["look"], held["before"])
            of = {n: held[n][0] for n in ("state", "after", "final", "illegal", "turns")}
            path = shortest_path(symbols(held["role"], found), of["state"], of["after"], of["final"])
            yield {"conv_id": conv, "segment": segment} | counted(held, found) | {"illegal": of["illegal"], "turns": of["turns"]} | turns_of(path, held)

    return sorted_rows(meet(own, told)).mapInArrow(releasing(per_segment(schema := f"conv_id {kind}, {PIECE}", walk)), schema)


def repaired(conversations: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame | None]:
    """conversations(conv_id, turn, role, text) -> (conv_id and PIECE of those that a task can hold, the same for segments of the others; None where there are none)."""
    rows = looked_at(conversations.select("conv_id", "turn", "role", "text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = stored(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)), "long")
    total = long.agg(F.sum("bytes")).first()[0]
    if total is None:
        return repair_short(rows), None
    # a bitmap of bounded size deals the rows; short conversations may go the long way too
    some, others = marked(rows, long, ["conv_id"])
    return repair_short(others), repair_long(some, max(2, min(MOST_SEGMENTS, -(-total // segment))))


def repair(conversations: DataFrame, **limits) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id and PIECE: repaired turns of each conversation, or of its segments in order."""
    short, long = repaired(conversations, **limits)
    return short if long is None else short.unionByName(long)


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(short: DataFrame, long: DataFrame | None) -> DataFrame:
    """One row for each conversation: what was counted, the edits, and the SHA-256 of its repaired `role:text` lines.

    The pieces of a long conversation pass through one task in order, one at a time, as SHA-256 reads them in order.
    """
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    # no column of the pieces is wider than a long; only turns at both of its ends are further apart
    gaps = lambda low, high, n: F.coalesce(F.expr(f"try_cast(CAST({high} AS decimal(38,0)) - {low} + 1 - {n} AS bigint)"), F.when(F.col(low).isNull(), 0))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    out = short.select("conv_id", gaps("low", "high", "turns").alias("gaps"), *counts, F.sha2(lines, 256).alias("repaired_sha256"))
    if long is None:
        return out
    kind = long.schema["conv_id"].dataType.simpleString()

    def scan(batches):
        def told():
            return {"conv_id": at, "low": low, "high": high, "turns": turns} | sums | {"audit": "".join(audit), "repaired_sha256": state.hexdigest()}

        at, state = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != at:
                    if state is not None:
                        yield pa.RecordBatch.from_pylist([told()], schema)
                    at, state, written, audit = r["conv_id"], hashlib.sha256(), False, []
                    low, high, turns, sums = None, None, 0, dict.fromkeys(counts[:-1], 0)
                low, high, turns = r["low"] if low is None else low, high if r["high"] is None else r["high"], turns + r["turns"]
                sums = {c: v + r[c] for c, v in sums.items()}
                audit.append(r["audit"])
                if r["some"]:
                    state.update((b"\n" if written else b"") + r["lines"].encode())
                    written = True
        if state is not None:
            yield pa.RecordBatch.from_pylist([told()], schema)

    schema = arrow(short.sparkSession, FORM := f"conv_id {kind}, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    pieces = long.select("conv_id", "segment", "low", "high", "turns", *counts, (F.size("repaired") > 0).alias("some"), lines.alias("lines"))
    whole = pieces.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment").mapInArrow(releasing(scan), FORM)
    return out.unionByName(whole.select("conv_id", gaps("low", "high", "turns").alias("gaps"), *counts, "repaired_sha256"))


def repaired_digests(conversations: DataFrame, **limits) -> DataFrame:
    """conversations, damaged, repaired and told by digests(); those that the damage left no row have zeros."""
    out = digests(*repaired(damaged(conversations), **limits))
    gone = conversations.groupBy("conv_id").agg(F.max((damage_key() != DROP).cast("int")).alias("left")).where("left = 0")
    zeros = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.unionByName(gone.select("conv_id", *(v.alias(c) for c, v in zeros.items()), F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(read(spark, sf_dir, "conversations"))


def _weights(before: str, label: str, cost: str) -> str:
    return f"{{'c': {before}.c + {cost}, 'a': '{label}' || {before}.a}}"


_GO = (2, 2, 3, 2)
_STAY = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
_ROW = ", ".join(
    "list_min([" + ", ".join([_weights(f"e{s}", "D", "3"), f"CASE WHEN fault < 2 THEN {_weights(f'e{_GO[s]}', 'R', '2 + fault')} END"] + [f"CASE WHEN fault < 2 AND initial = '{x}' THEN {_weights(f'e{t}', 'K', 'fault')} END" for x, t in _STAY[s]]) + f"]) AS e{s}"
    for s in range(4)
)
_INSERTED = ", ".join(f"list_min([x.e{s}, {_weights(f'y.e{_GO[s]}', 'I', '2')}]) AS e{s}" for s in range(4))


def _insert(x: str, y: str, out: str) -> str:
    """Relation `out`: the weights of x, or of an insert before y, which has the same key."""
    return f"{out} AS (SELECT x.conv_id, x.i, {_INSERTED} FROM {x} x JOIN {y} y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.i = y.i)"


SQL = f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keyed AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda j: CAST(ascii(substr(k, j, 1)) AS BIGINT))),
    lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 20 AS how FROM named),
damaged AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) FROM keyed WHERE how <> 0)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, {PREFIX}), sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM damaged),
faulty AS (SELECT conv_id, turn, role, text, i, n, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
    CASE WHEN bare = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault FROM ordered),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
best AS (SELECT DISTINCT conv_id, n + 1 AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS e0, {{'c': CAST(4 AS BIGINT), 'a': 'II'}} AS e1, {{'c': CAST(2 AS BIGINT), 'a': 'I'}} AS e2, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS e3 FROM faulty
  UNION ALL SELECT * FROM (WITH stepped AS (SELECT f.conv_id, f.i, {_ROW} FROM best b JOIN faulty f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i - 1),
    {_insert('stepped', 'stepped', 'once')}, {_insert('stepped', 'once', 'twice')} SELECT * FROM twice)),
paths AS (SELECT conv_id, e0.c AS cost, e0.a AS audit FROM best WHERE i = 1),
replay AS (SELECT conv_id, audit, 1 AS p, CAST(1 AS BIGINT) AS i, 0 AS s, CAST([] AS VARCHAR[]) AS lines FROM paths
  UNION ALL SELECT r.conv_id, audit, p + 1, CASE WHEN audit[p] = 'I' THEN r.i ELSE r.i + 1 END, CASE audit[p] WHEN 'D' THEN s WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END,
    CASE audit[p] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE audit[p] WHEN 'R' THEN text ELSE '' END) END
    FROM replay r LEFT JOIN faulty f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i WHERE p <= length(audit)),
texts AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM replay WHERE p > length(audit))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON o.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN paths p ON o.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN texts x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
"""
