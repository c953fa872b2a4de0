"""Repair of conversation structure: the cheapest edits that give turns in order, as a shortest path.

The path goes through a graph of (turn, role so far). The weight of an edge is one whole number: its
high digits carry the edit's cost, and of its low digits, three bits each, the one at the edit's
place in the audit carries the letter, so that the ordinary minimum of whole numbers prefers the
lower cost and then the ASCII-least audit, whose end is padded by zeros. A long conversation is cut
into segments, each with the least weights between any two states, which join end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

#: What the edits cost; a truncated turn that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters of the audit, ASCII order; each is a digit of three bits.
LETTER = {"D": 1, "I": 2, "K": 3, "R": 4}
#: Turns of a segment.
SEGMENT = 256
#: States are the role so far: nothing, system, user, assistant. What a role's initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: A way from a state to another: its weight, and the letters of its audit.
Way = tuple[int, int]


def _inserted(ways: dict[int, Way], wide: int) -> dict[int, Way]:
    """The least ways once turns may be put in: at most a user's and then an assistant's."""
    out = dict(ways)
    for to, froms in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        for state in froms:
            if state in out:
                value, n = out[state]
                new = (value + (INSERT << 3 * wide) + (LETTER["I"] << 3 * (wide - n - 1)), n + 1)
                out[to] = min(out.get(to, new), new)
    return out


def _turned(ways: dict[int, Way], initial: str, fault: int, wide: int) -> dict[int, Way]:
    """The least ways past a turn: kept, given another role or deleted."""
    out: dict[int, Way] = {}
    for state, (value, n) in ways.items():
        late = TRUNCATED if fault == 3 else 0
        edits = [("D", DELETE, state)]
        if fault in (0, 3):
            if (state, initial) in NEXT:
                edits.append(("K", late, NEXT[state, initial]))
            edits.append(("R", REROLE + late, ASSISTANT if state == USER else USER))
        for letter, cost, to in edits:
            new = (value + (cost << 3 * wide) + (LETTER[letter] << 3 * (wide - n - 1)), n + 1)
            out[to] = min(out.get(to, new), new)
    return out


def segment_ways(turns: list[tuple[str, int]]) -> tuple[int, list[dict[int, Way]]]:
    """(digits, ways): from each state the least way to each through turns of (role's initial, fault), none put in after the last."""
    wide = 2 * len(turns) + 4
    found = []
    for start in range(4):
        ways: dict[int, Way] = {start: (0, 0)}
        for initial, fault in turns:
            ways = _turned(_inserted(ways, wide), initial, fault, wide)
        found.append(ways)
    return wide, found


def _joined(wide: int, first: dict[int, Way], more: int, then: list[dict[int, Way]]) -> dict[int, Way]:
    """Least ways through a segment of `wide` digits and one of `more`.

    Ways of equal cost over the same turns never begin with one another, since what is over would
    be insertions that cost more, so the least of the parts make the least of the whole.
    """
    out: dict[int, Way] = {}
    low, low_more = (1 << 3 * wide) - 1, (1 << 3 * more) - 1
    for state, (value, n) in first.items():
        for to, (value2, n2) in then[state].items():
            cost = (value >> 3 * wide) + (value2 >> 3 * more)
            new = ((cost << 3 * (wide + more)) | ((value & low) << 3 * more) | ((value2 & low_more) << 3 * (wide - n)), n + n2)
            out[to] = min(out.get(to, new), new)
    return out


def cheapest(segments: list[tuple[int, list[dict[int, Way]]]]) -> tuple[int, str]:
    """(cost, audit) of the least way from the start to the end of a conversation of such segments."""
    wide, ways = 0, {START: (0, 0)}
    for more, then in segments:
        ways, wide = _joined(wide, ways, more, then), wide + more
    ways = {s: (v << 6, n) if wide else (0, 0) for s, (v, n) in ways.items()}  # two more digits, for turns put in at the end
    wide += 2
    ends = _inserted(ways, wide)
    value, n = min(ends[s] for s in (START, ASSISTANT) if s in ends)
    digits = f"{value & ((1 << 3 * wide) - 1):0{wide}o}"[:n] if n else ""
    return value >> 3 * wide, digits.translate({ord(str(d)): c for c, d in LETTER.items()})


class _Conversation:
    """Turns of one conversation, as they come: counts, and the digest of what the audit leaves of them."""

    def __init__(self, conv: pa.Scalar):
        self.conv, self.segments, self.counts = conv, [], [0, 0, 0, 0]
        self.illegal = self.distinct = self.at = 0
        self.low = self.high = self.initial = None
        self.state, self.any, self.cost, self.audit, self.sha = START, False, 0, None, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any, self.state = True, NEXT[self.state, role[:1]]

    def _puts_in(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put("assistant" if self.state == USER else "user", "")
            self.at += 1

    def begin(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest(self.segments)
            self.segments = []

    def turn(self, number: int | None, role: str, text: str, fault: int) -> None:
        self.begin()
        self.counts[fault] += 1
        if number is not None:
            self.distinct += number != self.high
            self.low, self.high = number if self.low is None else self.low, number
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self._puts_in()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._put(role, text)
        elif letter == "R":
            self._put("assistant" if self.state == USER else "user", text)

    def result(self) -> tuple:
        self.begin()
        self._puts_in()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost, self.audit, self.sha.hexdigest())


def faults(turns: DataFrame) -> DataFrame:
    """Add `fault` to turns(key, turn, role, text, sha, copies), distinct rows: 1 blank, 3 truncated, 2 the same role and text at an earlier turn, 0 none."""
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    firsts = turns.groupBy("key", "role", "sha").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    blank, whole = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, 1).when(F.col("first").isNotNull() & (place > F.col("first")), 2).when(whole, 0).otherwise(3)
    return turns.join(firsts, ["key", "role", "sha"], "left").withColumn("fault", fault).drop("first")


def _segments(rows: DataFrame) -> DataFrame:
    """(key, order columns of the first turn, wide, ways): conversations cut where tasks and SEGMENT turns end.

    The rows are dealt by ranges of (conversation, order), so a long conversation is in many tasks.
    """
    kind = rows.schema["turn"].dataType.simpleString()
    order = ["key", "later", "turn", "role", "sha", "copy"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def closed() -> dict:
            wide, ways = segment_ways([(r["role"][:1], r["fault"]) for r in held])
            flat = [{"start": s, "end": e, "length": n, "weight": v.to_bytes(v.bit_length() // 8 + 1, "big")} for s, w in enumerate(ways) for e, (v, n) in w.items()]
            return {c: held[0][c] for c in order} | {"wide": wide, "ways": flat}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and (r["key"] != held[0]["key"] or len(held) == SEGMENT):
                    out.append(closed())
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], shape)

    sent = rows.select(*order, "fault").repartitionByRange(*order).sortWithinPartitions(*order)
    ways = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int64()), ("weight", pa.binary())]))
    shape = pa.schema([("key", pa.string()), ("later", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("sha", pa.binary()), ("copy", pa.int32()), ("wide", pa.int64()), ("ways", ways)])
    schema = f"key string, later boolean, turn {kind}, role string, sha binary, copy int, wide long, ways array<struct<start: int, end: int, length: bigint, weight: binary>>"
    return sent.mapInArrow(cut, schema)


def repair(turns: DataFrame, everyone: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of each conversation that make its roles an optional system turn, then user and assistant in turn.

    Turns go by number, nulls first, and of one number by role and the text's digest. A blank turn
    (no character but white space), a duplicate (role and text of an earlier turn) and a truncated one
    (not ending in `.!?`) are faults; the first that holds counts. Blank turns and duplicates must be
    deleted. Roles count by their first letter as it is, so a role without one is never kept.

    Returns conv_id, gaps (missing numbers), blank, duplicate, truncated, illegal (neighbours out of
    order), cost, audit (a letter an edit: Keep, Rerole, Delete, Insert; the ASCII-least of the
    cheapest) and repaired_sha256 (of `role:text` of what is left, by newlines). A null role or text
    counts as one space, a null conversation id is one conversation. `everyone` may name further
    conversations (conv_col) that have no turns: they get zeros, an empty audit and the digest of an
    empty text. Repeated rows are duplicates; other columns don't enter. Turn numbers are whole.
    """
    key = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string")))
    conv, space = F.col(conv_col), F.lit(" ")
    plain = turns.select(key(conv).alias("key"), conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"))
    same = plain.groupBy("key", "conv", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies"))
    found = keep(faults(keep(same.withColumn("sha", F.unhex(F.sha2("text", 256))), "repair-turns")), "repair-faults")
    again = F.when((F.col("copy") > 0) & (F.col("fault") != 1), 2).otherwise(F.col("fault"))
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("fault", again).withColumn("later", F.col("turn").isNotNull())
    ids = turns.select(conv.alias("conv")) if everyone is None else everyone.select(conv.alias("conv")).unionByName(turns.select(conv.alias("conv")))
    # The segments of a conversation come first, then its turns, then its id.
    every = _segments(rows).withColumn("kind", F.lit(0)).unionByName(rows.drop("copies").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    every = every.unionByName(ids.distinct().withColumn("key", key(F.col("conv"))).withColumn("kind", F.lit(2)), allowMissingColumns=True)
    sent = every.repartition("key").sortWithinPartitions("key", "kind", "later", "turn", "role", "sha", "copy")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, done = None, None, []
        for batch in batches:
            convs = batch["conv"]
            for i, r in enumerate(batch.drop_columns(["conv"]).to_pylist()):
                if r["key"] != last:
                    last, now = r["key"], _Conversation(None)
                if r["kind"] == 0:
                    ways: list[dict[int, Way]] = [{}, {}, {}, {}]
                    for w in r["ways"]:
                        ways[w["start"]][w["end"]] = (int.from_bytes(w["weight"], "big"), w["length"])
                    now.segments.append((r["wide"], ways))
                elif r["kind"] == 1:
                    now.turn(r["turn"], r["role"], r["text"], r["fault"])
                else:  # the id is a conversation's last row
                    now.conv = convs[i].as_py()
                    done.append(now.result())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], pa.schema([(conv_col, convs.type), *((n, pa.int64()) for n in names[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())]))
                done = []

    names = [conv_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kind = turns.schema[conv_col].dataType.simpleString()
    return sent.select("key", "kind", "conv", "turn", "role", "text", "fault", "wide", "ways").mapInArrow(mend, f"`{conv_col}` {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations, some of them spoilt by crc32 of `conv_id:turn`: dropped, emptied, without `.!?`, repeated or given to the user."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    place = F.pmod(F.crc32(F.encode(F.concat(some("conv_id"), F.lit(":"), some("turn")), "UTF-8")), F.lit(20))
    rows = conversations.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), place.alias("place")).filter("place <> 0")
    text: Column = F.when(F.col("place") == 1, "").when(F.col("place") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("place") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("place") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations in a known way and repair them."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations.select("conv_id"))
