"""Message rows to ordered conversations with speaker roles.

Method: rows are keyed by conversation and sorted by instant and place of export; a finite-state
automaton reads the roles in that order and keeps the conversations it accepts.

No group is gathered in one task: duplicates are removed by a partial aggregate over (session,
place); the sort is a range partitioning over (session, instant, place), so a session of any size is
spread over tasks.  The automaton runs on pieces of ``CHUNK`` rows side by side: what a piece does to
every state is an element of the automaton's transition monoid, which is derived from ``TRANSITIONS``
alone; a session's few elements are then multiplied in order.  Places count from the session's first
row, and a verdict goes back to the rows by session and piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import role
from ..operators import timestamps
from ..runtime import materialize

#: Anything but white space.
SOLID = r"[^\s\p{Z}\x1c-\x1f\x85]"
#: Anything but white space, zero-width and control characters.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}ᅟᅠ⠀ㅤ]"

# The automaton: letter c customer, s service, u unknown role; state -> letter -> state.
START, ASKED, ANSWERED, UNASKED, BROKEN = "start", "asked", "answered", "unasked", "broken"
TRANSITIONS = {
    START: {"c": ASKED, "s": UNASKED, "u": BROKEN},
    UNASKED: {"c": ASKED, "s": UNASKED, "u": BROKEN},
    ASKED: {"c": ASKED, "s": ANSWERED, "u": BROKEN},
    ANSWERED: {"c": ASKED, "s": ANSWERED, "u": BROKEN},
    BROKEN: {"c": BROKEN, "s": BROKEN, "u": BROKEN},
}
ACCEPTED = ANSWERED


LETTERS = "csu"
#: Bits of the number of rows in a piece.
CHUNK = 12


class Monoid:
    """The maps of states that words bring about: elements, their products, and where START goes."""

    def __init__(self, transitions: dict[str, dict[str, str]], start: str = START):
        states = list(transitions)
        self.letters = [tuple(transitions[s][x] for s in states) for x in LETTERS]
        self.elements = [tuple(states)]
        then = lambda f, g: tuple(g[states.index(s)] for s in f)
        for e in self.elements:  # grows while new products are found
            self.elements += [x for x in dict.fromkeys(then(e, g) for g in self.letters) if x not in self.elements]
        number = {e: i for i, e in enumerate(self.elements)}
        self.steps = [number[then(e, g)] for e in self.elements for g in self.letters]
        self.products = [number[then(e, f)] for e in self.elements for f in self.elements]
        self.final = [e[states.index(start)] for e in self.elements]

    def _fold(self, numbers: Column, table: list[int], width: int) -> Column:
        cells = F.array(*[F.lit(x) for x in table])
        return F.aggregate(numbers, F.lit(0), lambda e, x: F.element_at(cells, e * width + x.cast("int") + 1))

    def read(self, letters: Column) -> Column:
        """Element of a word, an array of numbers of letters in order."""
        return self._fold(letters, self.steps, len(LETTERS))

    def multiply(self, elements: Column) -> Column:
        """Product of an array of elements in order."""
        return self._fold(elements, self.products, len(self.elements))

    def state(self, element: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.final]), element + 1)


def sequence(messages: DataFrame, stores: DataFrame) -> DataFrame:
    """One row for each message (session_id, message_id, input_order, speaker, kept, unknown), in
    order; ``seq`` LONG counts over the whole result, a session's kept messages first.

    Rows without session id (null or blank) are left out; rows of equal session and place are one
    message, that of the smallest message_id.  A role that sender_type doesn't tell is that of the
    same sender's other messages in the session if they agree; a null sender has none.  Kept are
    messages of customers and services with a visible character.
    """
    sources = timestamps.store_sources(stores)
    named = messages.where(F.col("session_id").rlike(SOLID)).select("session_id", "input_order", "message_id", "sender", role(F.col("sender_type")).alias("role"), "message_content", "message_time", "external_store_id")
    code = F.when(F.col("role") == "customer", 0).when(F.col("role") == "service", 1).when(F.col("role") == "system", 2)
    m = named.select(
        "session_id",
        "input_order",
        "message_id",
        # Senders are only compared within a session, so a 64-bit hash does.
        F.when(F.col("sender").isNotNull(), F.xxhash64("sender")).alias("sender"),
        code.alias("role"),
        F.coalesce(F.col("message_content").rlike(VISIBLE), F.lit(False)).alias("visible"),
        F.col("message_time").alias("text"),
        F.col("external_store_id").alias("source_id"),
    )
    # Times are read in the scan, before the first shuffle; from here on all columns but the session
    # have a fixed width, so that the aggregates hash in place.
    orders = timestamps.source_orders(m.select("source_id", "text"), sources)
    m = timestamps.to_instants(m, sources, orders=orders).select("session_id", "input_order", "message_id", "sender", "role", "visible", "epoch_ms")
    first = lambda c: F.min_by(c, "message_id").alias(c)
    m = m.groupBy("session_id", "input_order").agg(first("sender"), first("role"), first("visible"), first("epoch_ms"), F.min("message_id").alias("message_id"))
    # Read three times below: by the roles, and by the sampling and the sorting of the ranges.
    m = materialize(m)
    told = m.where("role is not null and sender is not null").groupBy("session_id", "sender").agg(F.min("role").alias("lo"), F.max("role").alias("hi")).where("lo = hi").select("session_id", "sender", F.col("lo").alias("told"))
    # Only the few rows that need it take part in the join.
    columns = ["session_id", "input_order", "message_id", "role", "visible", "epoch_ms"]
    open_ = m.where("role is null").join(told, ["session_id", "sender"], "left").withColumn("role", F.col("told")).select(*columns)
    m = m.where("role is not null").select(*columns).unionByName(open_)
    kept = F.coalesce(F.col("role") < 2, F.lit(False)) & F.col("visible")
    rows = m.select("session_id", "message_id", "input_order", F.when(F.col("role") == 0, "customer").when(F.col("role") == 1, "service").when(F.col("role") == 2, "system").alias("speaker"), kept.alias("kept"), F.col("role").isNull().alias("unknown"), "epoch_ms")
    order = ["session_id", F.col("kept").desc(), F.col("epoch_ms").asc_nulls_last(), F.col("input_order").asc_nulls_last(), "message_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("epoch_ms").withColumn("_id", F.monotonically_increasing_id())
    # The place of a row is only known once the partitions stand still: written to the shared folder.
    rows = materialize(rows).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").count().collect()  # one number a partition
    starts, at = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((r["_part"], at))
        at += r["count"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    return rows.join(offsets, "_part").withColumn("seq", F.col("_start") + F.col("_id") - F.shiftleft("_part", 33)).drop("_part", "_id", "_start")


def verdicts(rows: DataFrame, transitions: dict[str, dict[str, str]] = TRANSITIONS) -> DataFrame:
    """(session_id, first_seq, last_seq, messages, state, whole): the automaton's state of each
    session; whole is whether all places from 1 to n are there."""
    monoid = Monoid(transitions)
    kept = F.col("kept")
    letter = F.when(F.col("unknown"), 2).when(kept & (F.col("speaker") == "customer"), 0).when(kept, 1)
    word = F.collect_list(F.when(letter.isNotNull(), F.shiftleft("seq", 2) + letter))  # at most 2^CHUNK numbers
    pieces = rows.groupBy("session_id", F.shiftright("seq", CHUNK).alias("piece")).agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count_if(kept).alias("messages"),
        F.min("input_order").alias("lo"),
        F.max("input_order").alias("hi"),
        F.count("*").alias("n"),
        monoid.read(F.transform(F.array_sort(word), lambda x: x.bitwiseAND(F.lit(3)))).alias("element"),
    )
    run = F.array_sort(F.collect_list(F.struct("piece", "element")))  # one a piece
    return pieces.groupBy("session_id").agg(
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.sum("messages").alias("messages"),
        monoid.state(monoid.multiply(F.transform(run, lambda x: x["element"]))).alias("state"),
        (F.coalesce(F.min("lo") == 1, F.lit(False)) & F.coalesce(F.max("hi") == F.sum("n"), F.lit(False))).alias("whole"),
    )


def conversations(messages: DataFrame, stores: DataFrame) -> DataFrame:
    """(session_id, pos INT, message_id, speaker) of the kept conversations.

    Dropped: sessions whose places (all rows counted) aren't 1..n, with a message of unknown role,
    without messages, without customer, or not ending with the service.  Ties of instant and place
    go by message_id; unreadable times come last.  An empty table gives no rows.
    """
    rows = sequence(messages, stores)
    good = verdicts(rows).where((F.col("state") == ACCEPTED) & F.col("whole"))
    good = good.select("session_id", "first_seq", F.explode(F.sequence(F.shiftright("first_seq", CHUNK), F.shiftright("last_seq", CHUNK))).alias("piece"))
    out = rows.where("kept").withColumn("piece", F.shiftright("seq", CHUNK)).join(good, ["session_id", "piece"])
    return out.select("session_id", (F.col("seq") - F.col("first_seq") + 1).cast("int").alias("pos"), "message_id", "speaker")
