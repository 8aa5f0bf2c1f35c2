"""Repair of conversation structure by signatures.

A conversation's roles and faults are a string of one letter a row. Strings repeat far more than conversations, so each
distinct one is solved once, by recursion over its ends with a memo, and the solution is joined back and replayed on the
rows. Strings of over CHUNK rows are cut: a piece's solution is then a table of the best way from each state in which it
can be entered to each in which it can be left, and a conversation's tables are combined from the last to the first.

States of the repaired roles `(s?(ua)+)?`: nothing yet, a system row, a user row, a full round. Edits are K (keep),
R (give the row the role that is due, user or assistant), D (delete) and I (insert an empty row of the role that is due).
As the state tells the role, the edits' letters tell the whole repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import materialize, rejoin

#: Rows of a signature at most.
CHUNK = 64
#: Signatures' ends that a worker remembers.
MEMO = 1 << 16

NOTHING, SYSTEM, USER, ROUND = range(4)
#: The state behind a user and an assistant row, where they are due.
AFTER = {NOTHING: USER, SYSTEM: USER, ROUND: USER, USER: ROUND}
RIGHT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ROUND, "u"): USER, (USER, "a"): ROUND}
#: Costs of the edits, and of a row that stays though its text is cut off.
RENAME, DELETE, INSERT, OPEN = 2, 3, 2, 1

Way = tuple[int, str]


def _step(letter: str, state: int) -> dict[int, Way]:
    """The best way through one row, with what is inserted before it: by the state behind it, its cost and edits."""
    out: dict[int, Way] = {}
    role, open_ = letter.lower(), OPEN * letter.isupper()
    for n in range(3):  # more insertions only go round
        found = [(state, DELETE, "D")]
        if role != "x":
            found.append((AFTER[state], RENAME + open_, "R"))
            if (state, role) in RIGHT:
                found.append((RIGHT[state, role], open_, "K"))
        for after, cost, edit in found:
            way = (n * INSERT + cost, "I" * n + edit)
            out[after] = min(way, out.get(after, way))
        state = AFTER[state]
    return out


@lru_cache(MEMO)
def solve(signature: str, state: int) -> dict[int, Way]:
    """By the state that the rows leave: the cheapest edits, of equal ones those whose letters come first. No edits of a
    way begin another's, as both end in a row's own edit, so the best way's parts are best themselves."""
    if signature == "$":
        n = (0, 2, 1, 0)[state]
        return {ROUND if n or state == ROUND else NOTHING: (n * INSERT, "I" * n)}
    if not signature:
        return {state: (0, "")}
    out: dict[int, Way] = {}
    for middle, (cost, edits) in _step(signature[0], state).items():
        for end, (more, rest) in solve(signature[1:], middle).items():
            way = (cost + more, edits + rest)
            out[end] = min(way, out.get(end, way))
    return out


def ways(signature: str) -> str:
    """The table of a signature: `state,state,cost,edits` of each way, joined by semicolons. ^: it begins a conversation,
    $: it ends one."""
    begins = signature.startswith("^")
    return ";".join(f"{a},{b},{cost},{edits}" for a in ((NOTHING,) if begins else range(4)) for b, (cost, edits) in sorted(solve(signature.removeprefix("^"), a).items()))


def combine(tables: list[str]) -> Way:
    """Cost and edits of a conversation from the tables of its pieces in order: each step keeps, for a state, the next
    state and how its edits rank among those of the other states, so that no long strings are compared."""
    cost, rank = {NOTHING: 0, ROUND: 0}, {NOTHING: 0, ROUND: 0}
    steps: list[dict[int, tuple[int, str]]] = []
    for table in reversed(tables):
        best: dict[int, tuple] = {}
        for way in table.split(";"):
            a, b, own, edits = way.split(",")
            a, b = int(a), int(b)
            if b in cost:
                new = (int(own) + cost[b], edits, rank[b], b)
                best[a] = min(new, best.get(a, new))
        order = {k: i for i, k in enumerate(sorted({x[1:3] for x in best.values()}))}
        cost, rank = {a: x[0] for a, x in best.items()}, {a: order[x[1:3]] for a, x in best.items()}
        steps.append({a: (x[3], x[1]) for a, x in best.items()})
    state, found = NOTHING, []
    for step in reversed(steps):
        state, edits = step[state]
        found.append(edits)
    return cost[NOTHING], "".join(found)


def rowed(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, gone: nulls of role and text are a space; gone rows only name their conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role, text, (F.lit(False) if gone is None else gone).alias("gone"))


def damaged(conversations: DataFrame) -> DataFrame:
    """rowed(), with each row damaged by the checksum of its conversation and turn: of 20 values 0 drops the row, 1 empties
    the text, 2 removes its ends of sentences, 3 repeats the row, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rowed(conversations).withColumn("kind", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.drop("col")


#: Rows of a turn follow by role and text's hash: an order that the table's storage doesn't change.
ORDER = ("turn", "role", "digest")  # ascending order has nulls first
SUMS = ("blank", "duplicate", "truncated", "illegal")


def pieces(rows: DataFrame) -> DataFrame:
    """Of rowed(): conv_id, chunk, signature and the piece's counts. Texts stay where they are, only their hashes go to
    the conversation's task, which passes them as sorted streams."""
    r = rows.select(
        "conv_id", "turn", "role", "gone", F.unhex(F.sha2("text", 256)).alias("digest"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
    ).repartition("conv_id")
    own = Window.partitionBy("conv_id", "gone").orderBy(*ORDER)
    r = r.select("*", F.row_number().over(own).alias("place"), F.lag("role").over(own).alias("before"), F.lag("turn").over(own).alias("turn_before"), F.lead("gone").over(own).isNull().alias("last"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("place")) > 1
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("open"), "truncated")
    r = r.select("*", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    bad = F.col("before").isNotNull() & ~F.concat(F.substring("before", 1, 1), F.substring("role", 1, 1)).isin("su", "ua", "au")
    new = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    r = r.select(
        "conv_id", "turn", "place", F.when(~F.col("gone"), F.floor((F.col("place") - 1) / CHUNK)).alias("chunk"), F.concat(F.when(F.col("place") == 1, "^").otherwise(""), letter, F.when(F.col("last"), "$").otherwise("")).alias("letter"),
        *[(~F.col("gone") & F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in SUMS[:3]], (~F.col("gone") & bad).alias("illegal"), (~F.col("gone") & new).alias("new"), F.when(~F.col("gone"), F.col("turn")).alias("own_turn"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "")
    out = r.where("chunk IS NOT NULL").groupBy("conv_id", "chunk").agg(whole.alias("signature"), F.min("own_turn").alias("low"), F.max("own_turn").alias("high"), F.sum(F.col("new").cast("long")).alias("turns"), *[F.sum(F.col(c).cast("long")).alias(c) for c in SUMS])
    lost = r.where("chunk IS NULL").select("conv_id").distinct()
    return out.unionByName(lost, allowMissingColumns=True)


def audits(rows: DataFrame) -> DataFrame:
    """Of rowed(): gaps, blank, duplicate, truncated, illegal, cost and audit (the edits' letters) of each conv_id. A piece's
    rows and tables are bounded; a conversation's audit is one value of a letter a row."""
    found = materialize(pieces(rows), "dialogue-pieces")

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ways(s) for s in b.column(0).to_pylist()], pa.string())], ["signature", "ways"])

    solved = found.where("signature IS NOT NULL").select("signature").distinct().mapInArrow(table, "signature string, ways string")
    each = rejoin(found, solved, ["signature"], "conv_id", "left")
    span = F.max("high") - F.min("low") + 1 - F.sum("turns")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    each = each.groupBy("conv_id").agg(none(span).alias("gaps"), *[none(F.sum(c)).alias(c) for c in SUMS], F.array_sort(F.collect_list(F.when(F.col("ways").isNotNull(), F.struct("chunk", "ways")))).alias("tables"))
    each = each.withColumn("tables", F.transform("tables", lambda x: x["ways"]))
    kept = [c for c in each.columns if c != "tables"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [combine(t) for t in b.column("tables").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([c for c, _ in best], pa.int64()), pa.array([e for _, e in best], pa.string())], [*kept, "cost", "audit"])

    kind = dict(each.dtypes)
    return each.mapInArrow(fold, ", ".join(f"{c} {kind[c]}" for c in kept) + ", cost long, audit string")


STATS = ("gaps", *SUMS, "cost", "audit")


def beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's audit, then its rows in order, dealt by conversation: what replay() reads as a stream."""
    a = found.select("conv_id", F.struct(*STATS).alias("found"))
    r = rows.where("NOT gone").select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    both = a.unionByName(r, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("found").isNull(), *ORDER).select("conv_id", "found", "role", "text")


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, found) of each conversation, each followed by (edit, role, text) of its repaired rows."""
    audit, at, state = "", 0, NOTHING

    def due(edit: str, role: str, text: str) -> tuple:
        nonlocal state
        if edit == "K":
            state = RIGHT[state, role[:1]]
            return edit, role, text
        state = AFTER[state]
        return edit, "user" if state == USER else "assistant", "" if edit == "I" else text

    def inserted() -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield due("I", "", "")

    for b in batches:
        for conv, found, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if found is not None:
                yield from inserted()
                audit, at, state = found["audit"], 0, NOTHING
                yield conv, found
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit != "D":
                yield due(edit, role, text)
    yield from inserted()


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit, role, text of every row of the repaired conversations (conv_id, turn, role, text).

    Rows go by turn, nulls first, those of one turn by role and text; roles and texts that are null are a space. Blank and
    repeated rows are deleted, roles become `(s?(ua)+)?` with the cheapest edits. Null conv_ids are one conversation;
    repeated rows are duplicates. Conversations that lose all rows have none. Empty table: no rows. Other columns are not
    read. A conversation passes its task as a stream, a letter a row is held; a text is held whole, a few times.
    """
    rows = rowed(conversations)
    kind = dict(rows.dtypes)["conv_id"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out = None, 0, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], ids), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], ["conv_id", "place", "edit", "role", "text"])

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        ids = first.schema.field("conv_id").type

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        held = 0
        for x in replay(chained()):
            if len(x) == 2:
                conv, place = x[0], 0
                continue
            place += 1
            out.append((conv, place, *x))
            held += 100 + len(x[2])
            if held > 1 << 22:
                yield batch()
                out, held = [], 0
        yield batch()

    return beside(rows, audits(rows)).mapInArrow(emit, f"conv_id {kind}, place long, edit string, role string, text string")


def digested(rows: DataFrame) -> DataFrame:
    """Of rowed(): what audits() returns and repaired_sha256, over the repaired rows as `role:text`, joined by newlines. The
    hash takes the rows one after another, as they pass."""
    kind = dict(rows.dtypes)["conv_id"]
    counts = STATS[:-1]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv = found = digest = ids = None

        def typed(bs):
            nonlocal ids
            for b in bs:
                ids = b.schema.field("conv_id").type
                yield b

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * (len(STATS) + 2)
            types = [ids or pa.int64(), *[pa.int64()] * len(counts), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", *STATS, "repaired_sha256"])

        for x in replay(typed(batches)):
            if len(x) == 2:
                if found is not None:
                    out.append((conv, *(found[c] for c in STATS), digest.hexdigest()))
                    if len(out) >= 4096:
                        yield batch()
                        out = []
                conv, found, digest, first = *x, hashlib.sha256(), True
                continue
            digest.update((f"{x[1]}:{x[2]}" if first else f"\n{x[1]}:{x[2]}").encode())
            first = False
        if found is not None:
            out.append((conv, *(found[c] for c in STATS), digest.hexdigest()))
        if out:
            yield batch()

    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    return beside(rows, audits(rows)).mapInArrow(emit, schema)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return digested(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


def _steps() -> str:
    """The single rows' ways as SQL values."""
    return ", ".join(f"('{c}', {a}, {b}, {cost}, '{edits}')" for c in "suaoxSUAO" for a in range(4) for b, (cost, edits) in sorted(_step(c, a).items()))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
ORACLE = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM (SELECT *, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) FROM c WHERE k > 0)),
o AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS i FROM o),
l AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(i) ELSE i END AS letter, max(place) OVER (PARTITION BY conv_id) AS n FROM f),
step(letter, a, b, cost, edits) AS (VALUES {_steps()}),
e(a, cost, edits) AS (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')),
r AS (SELECT l.conv_id, l.place AS place, e.a, e.cost, e.edits AS audit FROM l, e WHERE l.place = l.n
 UNION ALL SELECT conv_id, place - 1, a, m.cost, m.audit FROM (SELECT r.conv_id, r.place, step.a, min({{'cost': r.cost + step.cost, 'audit': step.edits || r.audit}}) AS m FROM r JOIN l ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.place = r.place JOIN step ON step.letter = l.letter AND step.b = r.a GROUP BY r.conv_id, r.place, step.a) WHERE place > 0),
s AS (SELECT conv_id, cost, audit FROM r WHERE place = 0 AND a = 0),
t AS (SELECT conv_id, i, audit[i] AS x, len(replace(audit[:i], 'I', '')) AS place, len(replace(audit[:i], 'D', '')) AS nth FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM s) WHERE audit[i] <> 'D'),
p AS (SELECT t.*, l.role, l.text, max(CASE WHEN t.nth = 1 AND t.x = 'K' AND l.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS s FROM t LEFT JOIN l ON t.x <> 'I' AND l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.place = t.place),
q AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (nth - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole FROM p GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT i.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated, coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(s.cost, 0)::BIGINT AS cost, coalesce(s.audit, '') AS audit, sha256(coalesce(q.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM i.conv_id
"""
