"""Conversation structure repair: cheapest edits as optimal arcs of a bidirectional shortest-path graph, walked by least letter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches, table

#: Costs of the edits. A kept row is free; one that is left truncated adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and characters at which a block of a conversation is closed. Blocks only bound memory; results don't depend on where they are cut.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 22
#: What a repaired conversation may still become: nothing yet, a system turn, after a user's turn, after an assistant's. It may end in START and ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
INF = float("inf")
#: (state, role's initial) -> state after such a turn.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: state -> (role that may be inserted or given there, state after it).
TURN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"


@dataclass
class Turn:
    """A row: its fault is "blank", "duplicate", "truncated" or none."""

    role: str
    text: str
    fault: str = ""

    def arcs(self, state: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next state) of what may be done with the row in a state."""
        yield "D", DELETE, state
        if self.fault not in ("blank", "duplicate"):
            more = TRUNCATED if self.fault == "truncated" else 0
            to = STEP.get((state, self.role[:1]))
            if to is not None:
                yield "K", more, to
            yield "R", REROLE + more, TURN[state][1]


def _insert(costs: list[float], back: bool = False) -> list[float]:
    """Costs at one place of the conversation, with any insertions there; ``back``: costs to go."""
    out = list(costs)
    for _ in range(3):  # no state is more than three insertions from another
        for q in TURN:
            a, b = (TURN[q][1], q) if back else (q, TURN[q][1])
            out[b] = min(out[b], out[a] + INSERT)
    return out


def forward(turns: list[Turn], entry: list[float]) -> list[list[float]]:
    """Least costs to each state before each row and after the last; what is inserted there is included."""
    out = [_insert(entry)]
    for t in turns:
        new = [INF] * 4
        for q, c in enumerate(out[-1]):
            if c < INF:
                for _, cost, to in t.arcs(q):
                    new[to] = min(new[to], c + cost)
        out.append(_insert(new))
    return out


def backward(turns: list[Turn], leave: list[float]) -> list[list[float]]:
    """Least costs from each state before each row, and after the last, to an end, when ``leave`` holds those after the last; what is inserted there is included."""
    out = [_insert(leave, back=True)]
    for t in reversed(turns):
        out.append(_insert([min((cost + out[-1][to] for _, cost, to in t.arcs(q)), default=INF) for q in range(4)], back=True))
    return out[::-1]


def walk(turns: list[Turn], state: int, entry: list[float], leave: list[float], last: bool) -> tuple[str, int, list[str]]:
    """(letters, state after, repaired turns) of the least string of optimal arcs from ``state``.

    An arc is optimal where the cost to its start, its own and the cost from its end make the least cost of all. The frontier is the set of states that the letters so far can have led
    to, and each step takes the least letter of any optimal arc that leaves it. Insertions after the block's last row belong to the next block, unless it is the ``last``.
    """
    to_here, to_go = forward(turns, entry), backward(turns, leave)
    best = min(a + b for a, b in zip(to_here[0], to_go[0]))
    tight = lambda i, q, cost, j, to: to_here[i][q] + cost + to_go[j][to] == best
    frontier, letters, out, i = {state}, [], [], 0
    while i < len(turns) or last:
        options: dict[str, set[int]] = {}
        for q in frontier:
            if i < len(turns):
                for letter, cost, to in turns[i].arcs(q):
                    if tight(i, q, cost, i + 1, to):
                        options.setdefault(letter, set()).add(to)
            if tight(i, q, INSERT, i, TURN[q][1]):
                options.setdefault("I", set()).add(TURN[q][1])
        if i == len(turns) and (not options or any(to_go[i][q] == 0 for q in frontier)):
            break
        letter = min(options)
        role = TURN[min(frontier)][0]  # a letter leads from one state to one other, so the frontier is one state
        if letter in "KR":
            out.append(f"{turns[i].role if letter == 'K' else role}:{turns[i].text}")
        elif letter == "I":
            out.append(f"{role}:")
        frontier, i = options[letter], i + (letter != "I")
        letters.append(letter)
    return "".join(letters), min(frontier), out


NOTHING, OPEN_END = [0, INF, INF, INF], [0 if q in ENDS else INF for q in range(4)]


def transfer(turns: list[Turn]) -> list[list[float]]:
    """Least costs over a block from each state to each state."""
    return [forward(turns, [0 if p == q else INF for p in range(4)])[-1] for q in range(4)]


def _fault(text: str) -> str:
    body = text.rstrip(SPACES)
    return "blank" if not body else "" if body[-1] in ".!?" else "truncated"


@dataclass
class Block:
    """Rows of one conversation, in order, as far as they lie together."""

    turns: list[Turn] = field(default_factory=list)
    numbers: list[int | None] = field(default_factory=list)
    chars: int = 0

    def add(self, number: int | None, role: str, text: str, seen: set[bytes]) -> None:
        fault, key = _fault(text), digest(role, text)
        self.turns.append(Turn(role, text, "duplicate" if not fault == "blank" and key in seen else fault))
        self.numbers.append(number)
        self.chars += len(text)
        seen.add(key)

    def facts(self) -> dict:
        """What the sums over a conversation need of a block."""
        known = [n for n in self.numbers if n is not None]
        starts = [t.role[:1] for t in self.turns]
        return {
            "lowest": known[0] if known else None, "highest": known[-1] if known else None, "distinct": sum(1 for _ in groupby(known)),
            **{f: sum(t.fault == f for t in self.turns) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in LEGAL for a, b in zip(starts, starts[1:])), "head": starts[0] if starts else None, "tail": starts[-1] if starts else None,
        }


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()[:16]


def gaps(lowest: int | None, highest: int | None, distinct: int) -> int:
    return 0 if lowest is None else min(highest - lowest + 1 - distinct, (1 << 63) - 1)


FACTS = "lowest long, highest long, distinct long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def repair(turns: list[Turn]) -> tuple[int, str, list[str]]:
    """(cost, audit, repaired turns) of a whole conversation."""
    audit, _, out = walk(turns, START, NOTHING, OPEN_END, True)
    return int(min(a + b for a, b in zip(NOTHING, backward(turns, OPEN_END)[0]))), audit, out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the contract's damage by crc32 of ``conv_id:turn`` modulo 20; a null counts as one space. Rows that are dropped stay as gone, without text, so that their conversation is still known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind < 2, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 0, "").when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("copies").alias("copy")).drop("copy")


def _partitions(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of (conversation, turn, role, text) and sorted: a hot conversation, a hot turn and equal rows are all split. Texts take part by their beginnings and a hash, as keys are sampled to the driver."""
    keys = ["conv_id", "turn", "__role", "__text", "__hash", "__row"]
    rows = rows.withColumns({"__role": F.substring("role", 1, 64), "__text": F.substring("text", 1, 256), "__hash": F.xxhash64("role", "text"), "__row": F.monotonically_increasing_id()})
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "gone")


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): ``conv_id``, counts, ``cost``, ``audit`` and ``repaired_sha256``, and ``n_rows`` that are left of it.

    Rows go by turn, nulls first; of one turn by role and text (by their first 64 and 256 characters, then a hash). A fault is the first of blank, duplicate (role and text seen earlier), truncated. Empty texts are
    blank; null roles and texts count as one space; roles count by their first letter. A conversation whose rows are all gone has zeros, an empty audit and the hash of nothing. A null conv_id is a conversation like others. An empty table
    gives no rows; other columns are ignored. Audits and texts may be as long as their conversation; a string longer than Spark's can't be returned.

    One shuffle deals rows by ranges. What lies whole inside a task's rows is repaired there. Conversations that reach a border of a task, or are longer than a block, go on by blocks: earlier copies in other blocks are
    found by a join of digests; costs of a block from state to state (4 x 4) give, by blocks in order, the costs on either side of each; blocks are then walked from every state
    that is optimal there, and the walks are linked from first to last. The hash of a repaired conversation takes its blocks one after the other, in one task but never together in memory.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, at int, whole boolean, n_rows long, {COUNTS}, audit string, sha string, numbers array<long>, roles array<string>, texts array<string>, new array<boolean>"
    names = [f.split()[0] for f in schema.replace(", ", ",").split(",")]
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size = TaskContext.get().partitionId(), [], 0
        current, block, seen, at, first = None, Block(), set(), 0, True

        def close(whole: bool) -> dict:
            row = dict.fromkeys(names) | {"conv_id": current[0], "part": part, "at": at, "whole": whole, "n_rows": len(block.turns)}
            if not whole:
                return row | {"numbers": block.numbers, "roles": [t.role for t in block.turns], "texts": [t.text for t in block.turns], "new": [t.fault != "duplicate" for t in block.turns]}
            facts, (cost, audit, turns) = block.facts(), repair(block.turns)
            text = "\n".join(turns).encode("utf-8", "surrogatepass")
            return row | {"gaps": gaps(facts["lowest"], facts["highest"], facts["distinct"]), **{k: facts[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "sha": hashlib.sha256(text).hexdigest()}

        def flush(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")]
            for conv, turn, role, text, gone in zip(*columns):
                if current is None or conv != current[0]:
                    if current is not None:
                        out.append(close(not first and at == 0))
                        size += block.chars
                        first = False
                    current, block, seen, at = (conv,), Block(), set(), 0
                elif len(block.turns) >= block_rows or block.chars >= block_chars:
                    out.append(close(False))
                    size += block.chars
                    block, seen, at = Block(), set(), at + 1
                if not gone:
                    block.add(turn, role, text, seen)
                if len(out) >= 512 or size >= BLOCK_CHARS:
                    yield flush(out)
                    out, size = [], 0
        if current is not None:
            out.append(close(False))
        if out:
            yield flush(out)

    all_ = table(_partitions(rows).mapInArrow(blocks, schema), "repair-blocks")
    done = all_.filter("whole").select("conv_id", *[F.col(c) for c in RESULT[:-1]], F.col("sha").alias("repaired_sha256"), "n_rows")
    return done.unionByName(_by_blocks(all_.filter("NOT whole").select("conv_id", "part", "at", "n_rows", "numbers", "roles", "texts", "new"), kind))


def _turns(row: dict) -> Block:
    b = Block()
    for number, role, text, new in zip(row["numbers"], row["roles"], row["texts"], row["new"]):
        fault = _fault(text)
        b.turns.append(Turn(role, text, fault if new or fault == "blank" else "duplicate"))
        b.numbers.append(number)
    return b


def _by_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """The result for conversations of several blocks (conv_id, part, at, n_rows, numbers, roles, texts, new)."""
    spark = blocks.sparkSession
    key = ["conv_id", "part", "at"]
    place = F.struct("part", "at")

    def mapped(df: DataFrame, schema: str, make) -> DataFrame:
        arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):  # a block at a time: it may hold long texts
                    yield pa.RecordBatch.from_pylist(make(batch.slice(i, 1).to_pylist()[0]), schema=arrow)

        return df.mapInArrow(run, schema)

    # rows whose role and text an earlier block holds
    digests = mapped(blocks, f"conv_id {kind}, part int, at int, d binary", lambda r: [{**{k: r[k] for k in key}, "d": d} for d in {digest(a, b) for a, b in zip(r["roles"], r["texts"])}])
    earliest = digests.groupBy("conv_id", "d").agg(F.min(place).alias("m"), F.max(place).alias("z")).filter("m < z").select(F.col("conv_id").alias("c"), F.col("d").alias("e"), "m")
    late = digests.join(earliest, digests["conv_id"].eqNullSafe(earliest["c"]) & (digests["d"] == earliest["e"]) & (place > F.col("m")))
    late = late.groupBy(*key).agg(F.collect_list("d").alias("late"))  # at most a block's rows
    on = [blocks[k].eqNullSafe(late[k]) for k in key]
    blocks = blocks.join(late, on[0] & on[1] & on[2], "left_outer").select(*[blocks[c] for c in blocks.columns], "late")

    def marked(row: dict) -> Block:
        late = set(map(bytes, row["late"] or ()))
        return _turns(row | {"new": [n and digest(a, b) not in late for n, a, b in zip(row["new"], row["roles"], row["texts"])]})

    def cost_rows(row: dict) -> list[dict]:
        b = marked(row)
        m = [[c if c < INF else -1 for c in line] for line in transfer(b.turns)]
        return [{**{k: row[k] for k in key}, "n_rows": row["n_rows"], **b.facts(), "m": [int(c) for line in m for c in line]}]

    costs = table(mapped(blocks, f"conv_id {kind}, part int, at int, n_rows long, {FACTS}, m array<long>", cost_rows), "repair-costs")

    # Costs on both sides of each block. A conversation has as many small rows here as blocks, not rows.
    sides = f"conv_id {kind}, part int, at int, final boolean, entry array<double>, leave array<double>, {COUNTS}, total_rows long"
    sides_arrow = to_arrow_schema(spark.createDataFrame([], sides).schema)

    def both_sides(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["at"]))
        over = [[[INF if c < 0 else c for c in r["m"][4 * q : 4 * q + 4]] for q in range(4)] for r in rows]
        to_here, to_go = [NOTHING], [OPEN_END]
        for m in over:
            to_here.append([min(to_here[-1][p] + m[p][q] for p in range(4)) for q in range(4)])
        for m in reversed(over):
            # insertions after the last row are in m already, those of the end too
            to_go.append([min(m[q][p] + to_go[-1][p] for p in range(4)) for q in range(4)])
        to_go.reverse()
        known = [r for r in rows if r["lowest"] is not None]
        shared = sum(a["highest"] == b["lowest"] for a, b in zip(known, known[1:]))
        some = [r for r in rows if r["head"] is not None]
        total = {
            "gaps": gaps(known[0]["lowest"], known[-1]["highest"], sum(r["distinct"] for r in known) - shared) if known else 0,
            **{f: sum(r[f] for r in rows) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(r["illegal"] for r in rows) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(some, some[1:])), "cost": int(to_go[0][START]), "total_rows": sum(r["n_rows"] for r in rows),
        }
        out = [{**{k: r[k] for k in key}, "final": i == len(rows) - 1, "entry": to_here[i], "leave": to_go[i + 1], **total} for i, r in enumerate(rows)]
        return pa.Table.from_pylist(out, schema=sides_arrow)

    side = table(costs.groupBy("conv_id").applyInArrow(both_sides, sides), "repair-sides")
    at_side = side.select(*[F.col(k).alias(f"__{k}") for k in key], "final", "entry", "leave")
    joined = blocks.join(at_side, blocks["conv_id"].eqNullSafe(F.col("__conv_id")) & (F.col("part") == F.col("__part")) & (F.col("at") == F.col("__at")))

    def walks(row: dict) -> list[dict]:
        turns, out = marked(row).turns, []
        total = min(a + b for a, b in zip(_insert(row["entry"]), backward(turns, row["leave"])[0]))
        for q in range(4):
            if row["entry"][q] + backward(turns, row["leave"])[0][q] == total:
                letters, to, lines = walk(turns, q, row["entry"], row["leave"], row["final"])
                out.append({**{k: row[k] for k in key}, "state": q, "next": to, "letters": letters, "lines": "".join(x + "\n" for x in lines)})
        return out

    walked = table(mapped(joined.select(*key, "numbers", "roles", "texts", "new", "late", "final", "entry", "leave"), f"conv_id {kind}, part int, at int, state int, next int, letters string, lines string", walks), "repair-walks")

    links = f"conv_id {kind}, part int, at int, state int"
    links_arrow = to_arrow_schema(spark.createDataFrame([], links).schema)

    def link(t: pa.Table) -> pa.Table:
        state, out = START, []
        for place, rows in groupby(sorted(t.to_pylist(), key=lambda r: (r["part"], r["at"])), key=lambda r: (r["part"], r["at"])):
            chosen = next(r for r in rows if r["state"] == state)
            out.append({"conv_id": chosen["conv_id"], "part": place[0], "at": place[1], "state": state})
            state = chosen["next"]
        return pa.Table.from_pylist(out, schema=links_arrow)

    chosen = walked.select(*key, "state", "next").groupBy("conv_id").applyInArrow(link, links)
    chosen = chosen.select(*[F.col(c).alias(f"__{c}") for c in (*key, "state")])
    path = walked.join(chosen, walked["conv_id"].eqNullSafe(F.col("__conv_id")) & (F.col("part") == F.col("__part")) & (F.col("at") == F.col("__at")) & (F.col("state") == F.col("__state"))).select(*key, "letters", "lines")

    hashes = f"conv_id {kind}, audit string, repaired_sha256 string"
    hashes_arrow = to_arrow_schema(spark.createDataFrame([], hashes).schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by conversation and in order; the last line end is held back, as it only stands between lines."""
        current, sha, letters, held = None, None, [], b""
        row = lambda: pa.RecordBatch.from_pylist([{"conv_id": current[0], "audit": "".join(letters), "repaired_sha256": sha.hexdigest()}], schema=hashes_arrow)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if current is None or current[0] != r["conv_id"]:
                    if current is not None:
                        yield row()
                    current, sha, letters, held = (r["conv_id"],), hashlib.sha256(), [], b""
                lines = held + r["lines"].encode("utf-8", "surrogatepass")
                held = lines[-1:]
                sha.update(lines[:-1])
                letters.append(r["letters"])
        if current is not None:
            yield row()

    out = path.repartition("conv_id").sortWithinPartitions(*key).mapInArrow(hashed, hashes)
    once = side.filter("final").select(F.col("conv_id").alias("__conv_id"), *RESULT[:-2], F.col("total_rows").alias("n_rows"))
    return out.join(once, out["conv_id"].eqNullSafe(F.col("__conv_id"))).select("conv_id", *RESULT[:-1], "repaired_sha256", "n_rows")
