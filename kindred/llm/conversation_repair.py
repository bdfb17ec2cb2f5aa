"""Repair of conversation structure: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

Edits: keep (0), give the role user or assistant (1), delete (2; blank and duplicate rows must go), insert an empty row (5); a truncated row
that stays costs 5 more.

Method: lazy weighted determinisation. The pattern is an automaton of four states with edits as weighted arcs. Read from the last row to the
first, the costs of reaching an end from each state are a vector; less its minimum, a vector is a state of a deterministic automaton. Few
vectors occur, and each is made when it is first met: a transition table from (vector, kind of row) to (vector, cost) is filled
on the way, so a conversation costs one lookup a row. Each entry keeps the tight arcs too: for each state the ASCII-least edit whose cost
and remaining cost add up. The trace goes back along the scan, from the first row to the last, over tight arcs only, and so gives the least of the cheapest edits.

Scale: rows that are equal in conversation, turn, role and text are one row with a number of copies, summed in part before the shuffle. A conversation of
up to ``SMALL_ROWS`` different rows and ``SMALL_BYTES`` of text is repaired in one task, which holds one conversation at a time. A larger one is cut into
blocks by ranges: a block's costs are a (min, +) matrix, the matrices of a conversation give each block its vector, the blocks' traces from all
four states give each block its first state, and only then are edits applied. Two things of a conversation are sequential by their nature, since the result
holds them as one value: the text of its edits, and the digest of the repaired texts, which is streamed in order through one task.

Defined cases: null text or role is one space, null conversations are one conversation, null turns come first; rows of one turn come by role
and text; equal rows repeat each other; roles other than s, u and a by their initial can only get a role or go; an empty table gives an empty
result; conversations of which all rows are dropped have zeros, no edits and the digest of the empty text; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .common import table

SMALL_ROWS = 50_000
SMALL_BYTES = 64 << 20
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60

#: States of the pattern: nothing yet, behind s, behind u, behind a. A u or a leads on from each of them in one way.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (0, 2 * INSERT, INSERT, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
INITIALS = tuple(KEPT)
MUST_GO = 0


def symbol(role: str, gone: bool, truncated: bool) -> int:
    """The kind of a row: MUST_GO, or by initial and whether it is truncated."""
    initial = role[:1]
    return MUST_GO if gone else 1 + 2 * INITIALS.index(initial if initial in KEPT else "") + truncated


class Transitions:
    """The transition table, filled as it is used."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int, tuple[tuple[str, int], ...]]] = {}

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """(number of the normalised vector, what was taken off)."""
        least = min(costs)
        vector = tuple(c - least if c < NEVER else NEVER for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def step(self, state: int, kind: int) -> tuple[int, int, tuple[tuple[str, int], ...]]:
        """(state before a row of that kind, cost, the tight edit of each state and where it leads)."""
        behind, options = self.vectors[state], []
        more = TRUNCATED if kind and (kind - 1) % 2 else 0
        kept = KEPT[INITIALS[(kind - 1) // 2]] if kind else {}
        for q in range(4):
            own = [(DELETE + behind[q], "D", q)]
            if kind:
                if q in kept:
                    own.append((more + behind[kept[q]], "K", kept[q]))
                own.append((RETYPE + more + behind[NEXT[q]], "R", NEXT[q]))
            options.append(own)
        costs = [min(c for c, *_ in own) for own in options]
        for _ in range(4):  # insertions before the row
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        edits = tuple(min((e, to) for c, e, to in [*own, (INSERT + costs[NEXT[q]], "I", NEXT[q])] if c == costs[q] or c >= NEVER) for q, own in enumerate(options))
        before, cost = self.state(tuple(min(c, NEVER) for c in costs))
        self.steps[state, kind] = before, cost, edits
        return self.steps[state, kind]

    def scan(self, kinds: bytes, costs: tuple[int, ...] = ENDS) -> tuple[list[tuple[tuple[str, int], ...]], tuple[int, ...]]:
        """(the tight edits at each row, the costs before the first row), given the costs behind the last row."""
        state, total = self.state(costs)
        tight: list = [None] * len(kinds)
        for at in range(len(kinds) - 1, -1, -1):
            kind = kinds[at]
            state, cost, tight[at] = self.steps.get((state, kind)) or self.step(state, kind)
            total += cost
        return tight, tuple(min(c + total, NEVER) for c in self.vectors[state])


def trace(tight: list[tuple[tuple[str, int], ...]], q: int = BEGIN) -> tuple[str, int]:
    """(the edits, the state behind them), from the first row on."""
    out = []
    for edits in tight:
        edit = "I"
        while edit == "I":
            edit, q = edits[q]
            out.append(edit)
    return "".join(out), q


def finish(q: int) -> str:
    """The insertions behind the last row."""
    return "I" * (ENDS[q] // INSERT)


def apply(audit: str, rows: Iterator[tuple[str, str]], q: int = BEGIN) -> Iterator[str]:
    """``role:text`` of the repaired rows."""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        q = KEPT[role[:1]][q] if edit == "K" else NEXT[q]
        yield f"{role if edit == 'K' else ROLES[q]}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: ``conv_id, turn, role, text, copies`` (0: the row was dropped)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit("null")).alias("key")


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(different rows with their faults: ``key, turn, role, text, copies, gone, truncated``; numbers per conversation)."""
    digest = F.unhex(F.sha2("text", 256))
    keyed = rows.select(_key(F.col("conv_id")), "turn", "role", "text", "copies", digest.alias("digest"))
    there = keyed.filter("copies > 0").groupBy("key", "turn", "role", "digest").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")  # null turns come first
    first = keyed.filter("copies > 0").groupBy("key", "role", "digest").agg(F.min(place).alias("first"))
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    blank, late, cut = body == "", place > F.col("first"), ~F.right(body, F.lit(1)).isin(".", "!", "?")
    judged = there.join(first, ["key", "role", "digest"]).select(
        "key", "turn", "role", "text", "copies", blank.alias("blank"), late.alias("late"), (~blank & ~late & cut).alias("truncated")
    )
    judged = materialise(judged)
    count = lambda c: F.sum(c.cast("long"))
    numbers = judged.groupBy("key").agg(
        count(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"), count(F.when(~F.col("blank"), F.col("copies") - (~F.col("late")).cast("long")).otherwise(0)).alias("duplicate"),
        count(F.col("truncated")).alias("truncated"), F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.sum("copies").alias("copies"),
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"),
    )
    turns = judged.filter("turn IS NOT NULL").select("key", "turn").distinct().groupBy("key").agg(F.count("*").alias("turns"))
    everyone = rows.select("conv_id").distinct().select("conv_id", _key(F.col("conv_id")))
    numbers = everyone.join(numbers, "key", "left").join(turns, "key", "left").select(
        "conv_id", "key", (F.coalesce("span", F.lit(0)) - F.coalesce("turns", F.lit(0))).alias("gaps"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "rows", "bytes", "copies")]
    )
    return judged.select("key", "turn", "role", "text", "copies", (F.col("blank") | F.col("late")).alias("gone"), F.col("truncated")), materialise(numbers)


class _Conversation:
    """The rows of one conversation, or of a block of it, in order."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int]] = []
        self.kinds = bytearray()
        self.illegal, self.first, self.last = 0, None, None

    def add(self, role: str, text: str, copies: int, gone: bool, truncated: bool) -> None:
        initial = role[:1]
        self.kinds.append(symbol(role, gone, truncated))
        self.kinds += bytes(copies - 1)  # MUST_GO
        self.illegal += copies - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = initial if self.first is None else self.first, initial
        self.rows.append((role, text, copies))

    def each(self) -> Iterator[tuple[str, str]]:
        return ((role, text) for role, text, copies in self.rows for _ in range(copies))


FIELDS = ("role", "text", "copies", "gone", "truncated")
ORDER = ("key", "turn", "role", "text")
REPAIR = "key string, illegal long, cost long, audit string, repaired_sha256 string"


def _in_tasks(rows: DataFrame) -> DataFrame:
    """A conversation at a time, from rows that are sorted in each task."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, key, now, out = Transitions(), None, _Conversation(), []

        def close() -> None:
            tight, costs = transitions.scan(bytes(now.kinds))
            audit, q = trace(tight)
            audit += finish(q)
            digest = hashlib.sha256("\n".join(apply(audit, now.each())).encode())
            out.append((key, now.illegal, costs[BEGIN], audit, digest.hexdigest()))

        def batch() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            done = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "illegal", "cost", "audit", "repaired_sha256"])
            out.clear()
            return done

        for some in batches:
            for row in zip(*(some.column(c).to_pylist() for c in ("key", *FIELDS)), strict=True):
                if row[0] != key:
                    if key is not None:
                        close()
                    key, now = row[0], _Conversation()
                now.add(*row[1:])
            if out:
                yield batch()
        if key is not None:
            close()
            yield batch()

    return rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text").select("key", *FIELDS).mapInArrow(repair, REPAIR)


def _block(rows: pa.Table) -> _Conversation:
    out = _Conversation()
    ordered = rows.take(pa.compute.sort_indices(rows, [(c, "ascending") for c in ORDER[1:]], null_placement="at_start"))
    for row in zip(*(ordered.column(c).to_pylist() for c in FIELDS), strict=True):
        out.add(*row)
    return out


def _in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Conversations of any size: blocks are scanned and traced apart and joined by small summaries."""
    ranged = rows.repartitionByRange(blocks, "key", F.asc_nulls_first("turn"), "role", "text").withColumn("block", F.spark_partition_id())
    ranged = materialise(ranged)
    at = lambda t, c: t.column(c)[0].as_py()
    ordered = lambda t: sorted(t.to_pylist(), key=lambda r: r["block"])

    def summary(rows: pa.Table) -> pa.Table:
        """The costs before the block for each single state behind it."""
        now, transitions = _block(rows), Transitions()
        unit = lambda q: tuple(0 if p == q else NEVER for p in range(4))
        matrix = [c for q in range(4) for c in transitions.scan(bytes(now.kinds), unit(q))[1]]
        return pa.table({"key": [at(rows, "key")], "block": pa.array([at(rows, "block")], pa.int32()), "matrix": [matrix], "illegal": [now.illegal], "first": [now.first], "last": [now.last]})

    def vectors(rows: pa.Table) -> pa.Table:
        """The costs behind each block; with the first one, those of the conversation."""
        all_rows, costs, out = ordered(rows), ENDS, []
        illegal = sum(r["illegal"] for r in all_rows) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(all_rows, all_rows[1:]))
        for r in reversed(all_rows):
            m = r["matrix"]
            out.append({"key": r["key"], "block": r["block"], "costs": list(costs)})
            costs = tuple(min(min(m[4 * p + q] + costs[p] for p in range(4)), NEVER) for q in range(4))
        names = {"key": pa.array([r["key"] for r in out]), "block": pa.array([r["block"] for r in out], pa.int32()), "costs": pa.array([r["costs"] for r in out], pa.list_(pa.int64()))}
        return pa.table(names | {"illegal": pa.array([illegal] * len(out), pa.int64()), "cost": pa.array([costs[BEGIN]] * len(out), pa.int64())})

    def traces(rows: pa.Table) -> pa.Table:
        """The edits and the last state from each first state."""
        tight, _ = Transitions().scan(bytes(_block(rows).kinds), tuple(at(rows, "costs")))
        found = [trace(tight, q) for q in range(4)]
        return pa.table({"key": [at(rows, "key")], "block": pa.array([at(rows, "block")], pa.int32()), "edits": [[e for e, _ in found]], "behind": pa.array([[q for _, q in found]], pa.list_(pa.int32()))})

    def choose(rows: pa.Table) -> pa.Table:
        q, out = BEGIN, []
        for r in ordered(rows):
            out.append({"key": r["key"], "block": r["block"], "q": q, "edits": r["edits"][q]})
            q = r["behind"][q]
        out[-1]["edits"] += finish(q)
        return pa.table({"key": [r["key"] for r in out], "block": pa.array([r["block"] for r in out], pa.int32()), "q": pa.array([r["q"] for r in out], pa.int32()), "edits": [r["edits"] for r in out]})

    def lines(rows: pa.Table) -> pa.Table:
        found = list(apply(at(rows, "edits"), _block(rows).each(), at(rows, "q")))
        n = len(found)
        return pa.table({"key": pa.array([at(rows, "key")] * n, pa.string()), "block": pa.array([at(rows, "block")] * n, pa.int32()), "pos": pa.array(range(n), pa.int64()), "line": pa.array(found, pa.string())})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out = None, None, []
        for batch in batches:
            for k, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, now.hexdigest()))
                    key, now = k, hashlib.sha256(line.encode())
                else:
                    now.update(b"\n" + line.encode())
        if key is not None:
            out.append((key, now.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*out, strict=True)], names=["key", "repaired_sha256"])

    on = ["key", "block"]
    sums = ranged.groupBy(*on).applyInArrow(summary, "key string, block int, matrix array<long>, illegal long, first string, last string")
    costs = materialise(materialise(sums).groupBy("key").applyInArrow(vectors, "key string, block int, costs array<long>, illegal long, cost long"))
    found = ranged.join(costs.select(*on, "costs"), on).groupBy(*on).applyInArrow(traces, "key string, block int, edits array<string>, behind array<int>")
    chosen = materialise(materialise(found).groupBy("key").applyInArrow(choose, "key string, block int, q int, edits string"))
    repaired = ranged.join(chosen, on).groupBy(*on).applyInArrow(lines, "key string, block int, pos long, line string")
    sha = repaired.repartition("key").sortWithinPartitions("key", "block", "pos").select("key", "line").mapInArrow(digests, "key string, repaired_sha256 string")
    pieces = F.array_sort(F.collect_list(F.struct("block", "edits")))
    audit = chosen.groupBy("key").agg(F.array_join(F.transform(pieces, lambda p: p["edits"]), "").alias("audit"))
    totals = costs.groupBy("key").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"))
    return totals.join(audit, "key").join(sha, "key", "left").select("key", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repair(rows: DataFrame, small_rows: int = SMALL_ROWS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every conversation of ``rows`` (as ``damaged`` gives them)."""
    judged, numbers = faults(rows)
    big = numbers.filter((F.col("rows") > small_rows) | (F.col("bytes") > small_bytes) | (F.col("copies") > small_rows)).select("key", "rows", "bytes")
    blocks = big.agg(F.sum(F.greatest(F.col("rows") / small_rows, F.col("bytes") / small_bytes))).first()[0]
    if blocks is None:
        done = _in_tasks(judged)
    else:
        done = _in_tasks(judged.join(big, "key", "left_anti")).unionByName(_in_blocks(judged.join(big, "key", "left_semi"), int(blocks) + 1))
    nothing = {"illegal": F.lit(0), "cost": F.lit(0), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return numbers.join(done, "key", "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", *[F.coalesce(c, v).alias(c) for c, v in nothing.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same by a table of costs and least edits from each row and state to the end."""
    option = "{{'c': ({c})::BIGINT, 'e': {e}}}".format
    states = ("b", "s", "u", "a")
    after = dict(zip(states, "uuau", strict=True))
    keeps = {"b": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    columns = []
    for q in states:
        to = after[q]
        kept = "".join(f" WHEN '{i}' THEN [{option(c=f'more + g.{t}.c', e=f"'K' || g.{t}.e")}]" for i, t in keeps[q].items())
        options = f"[{option(c=f'2 + g.{q}.c', e=f"'D' || g.{q}.e")}] || CASE WHEN gone THEN [] ELSE [{option(c=f'1 + more + g.{to}.c', e=f"'R' || g.{to}.e")}] || CASE left(role, 1){kept} ELSE [] END END"
        columns.append(f"list_sort({options})[1] AS {q}")
    inserted = lambda direct, of: ", ".join(f"list_sort([{direct}.{q}, {option(c=f'5 + {of}.{after[q]}.c', e=f"'I' || {of}.{after[q]}.e")}])[1] AS {q}" for q in states)
    return f"""WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
      h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
        lambda acc, b: list_reduce(list_prepend(xor(acc, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS fault FROM k),
      d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE fault <> 0),
      o AS (SELECT coalesce(conv_id::VARCHAR, 'null') AS key, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM d),
      p AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY key, role, text ORDER BY rn) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(role) OVER (PARTITION BY key ORDER BY rn) AS prior FROM o),
      f AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND cut AS truncated, CASE WHEN NOT blank AND NOT again AND cut THEN 5 ELSE 0 END AS more FROM p),
      g AS (SELECT key, max(rn) + 1 AS rn, {{'c': 0::BIGINT, 'e': ''}} AS b, {{'c': 10::BIGINT, 'e': 'II'}} AS s, {{'c': 5::BIGINT, 'e': 'I'}} AS u, {{'c': 0::BIGINT, 'e': ''}} AS a FROM f GROUP BY key
        UNION ALL SELECT key, rn, {inserted('d', 'i')} FROM (SELECT key, rn, d, {{{', '.join(f"'{q}': i.{q}" for q in states)}}} AS i FROM (SELECT key, rn, d, unnest([{{{', '.join(f"'{q}': list_sort([d.{q}, {option(c=f'5 + d.{after[q]}.c', e=f"'I' || d.{after[q]}.e")}])[1]" for q in states)}}}]) AS i
          FROM (SELECT key, rn, {{{', '.join(f"'{q}': {q}" for q in states)}}} AS d FROM (SELECT f.key, f.rn, {', '.join(columns)} FROM g JOIN f ON f.key = g.key AND f.rn = g.rn - 1))))),
      best AS (SELECT key, b.c AS cost, b.e AS audit FROM g WHERE rn = 1),
      edits AS (SELECT key, pos, audit[pos] AS edit FROM (SELECT key, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best)),
      placed AS (SELECT key, pos, edit, sum((edit <> 'I')::INT) OVER w AS rn, sum((edit <> 'D')::INT) OVER w AS nth FROM edits WINDOW w AS (PARTITION BY key ORDER BY pos)),
      rows_of AS (SELECT x.key, pos, edit, nth, CASE WHEN edit <> 'I' THEN role END AS role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text FROM placed x LEFT JOIN f ON f.key = x.key AND f.rn = x.rn WHERE edit <> 'D'),
      led AS (SELECT *, max((nth = 1 AND edit = 'K' AND left(role, 1) = 's')::INT) OVER (PARTITION BY key) AS s FROM rows_of),
      fixed AS (SELECT key, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos)) AS sha FROM led GROUP BY key),
      numbers AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (prior IS NOT NULL AND left(prior, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key)
      SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS key FROM conversations) LEFT JOIN numbers USING (key) LEFT JOIN best USING (key) LEFT JOIN fixed USING (key)"""


SQL = _sql()
