"""Repair of conversation structure by cheapest edits, read off a graph of tight arcs.

A conversation's rows are the layers of a graph whose nodes are the states of the pattern ``(s?(ua)+)?`` over role initials; an arc
keeps, reroles or deletes a row, or inserts an empty turn inside a layer. Minimum costs from the start (forward) and to the end
(backward) name all arcs that lie on a cheapest path: those where forward cost, arc and backward cost add up to the minimum. These
tight arcs form an acyclic graph, as no arc inside a layer is free. A set of nodes then walks it from the start, takes the least
letter that any of its tight arcs has, and moves to where that letter leads.

Conversations are dealt by id, and a task holds one of them at a time. Those with many rows or bytes (at least 1 / ``LARGE_GROUPS`` of
all, and ``LONG_ROWS`` or ``LONG_BYTES``) are cut into chunks by ranges of their order instead: chunks give min-plus matrices between
states, one small row a chunk is composed in order to the costs at its borders, and the chunks are walked side by side from every state
that a cheapest path can enter them in. Only a digest over all of such a conversation needs its text as one stream.

Defined cases: null roles and texts count as one space; rows of one turn (null turns first) stand by role, then by a hash of the
text; repeated rows are duplicates; a null ``conv_id`` is an id like any other; a role is legal by its first letter alone, an empty
one never; a conversation whose rows are all ``gone`` or deleted has no repaired rows; an empty table gives an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type

from .common import LARGE_GROUPS, bounded_batches, cut, table

LONG_ROWS, LONG_BYTES = 10_000, 1 << 24
CHUNK_ROWS, CHUNK_CHARS = 512, 1 << 18
FAR = 1 << 60
#: States: nothing yet, after a system row, after a user row, after an assistant row. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: What a new role must be in a state, and where it leads.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
FAULTS = ("blank", "duplicate", "truncated")
WHITE = " \t\n\x0b\x0c\r"
MEASURES = ("gaps", *FAULTS, "illegal", "cost")


def _of(**types) -> pa.Schema:
    return pa.schema(list(types.items()))


def _longs(*names) -> dict:
    return dict.fromkeys(names, pa.int64())


def _rows_of(**types) -> pa.DataType:
    return pa.list_(pa.struct(list(types.items())))


PLACE = _longs("conv_id", "part", "seq")
EDITS = _rows_of(edit=pa.string(), role=pa.string(), text=pa.string())
PIECE = _of(**_longs("conv_id", "piece"), edits=EDITS, **_longs(*MEASURES))
CHUNK = _of(**PLACE, rows=_rows_of(turn=pa.int64(), role=pa.string(), text=pa.string()))
MATRIX = _of(**PLACE, costs=pa.list_(pa.int64()), **_longs("low", "high", "distinct", "first_turn", "last_turn"), first=pa.string(), last=pa.string(), **_longs(*FAULTS, "illegal"))
BORDER = _of(**PLACE, last=pa.bool_(), ahead=pa.list_(pa.int64()), behind=pa.list_(pa.int64()), **_longs("total", *MEASURES))
WAYS = _of(**PLACE, ways=_rows_of(entry=pa.int32(), exit=pa.int32(), letters=pa.string(), states=pa.binary()))
WAY = _of(**_longs("part", "seq"), letters=pa.string(), states=pa.binary())
DIGEST = _of(**_longs("conv_id", *MEASURES), audit=pa.string(), repaired_sha256=pa.string())


def fault(role: str, text: str, first: bool) -> str:
    """The first fault of a row; ``first`` tells whether no earlier row has its role and text."""
    shown = text.rstrip(WHITE)
    return "blank" if not shown else "duplicate" if not first else "truncated" if shown[-1] not in ".!?" else ""


def row_arcs(initial: str, what: str):
    """For each state the arcs (letter, state, cost) that use up a row."""
    out = []
    short = CUT_SHORT if what == "truncated" else 0
    for state in STATES:
        arcs = [("D", state, DELETE)]
        if what not in ("blank", "duplicate"):
            if initial in KEEP[state]:
                arcs.append(("K", KEEP[state][initial], short))
            arcs.append(("R", NEXT[state], REROLE + short))
        out.append(arcs)
    return out


def _inserted_after(costs: list[int]) -> list[int]:
    """Costs of a layer's nodes once turns may be inserted on the way in: every insertion leads to USER, or from there to ASSISTANT."""
    user = min(costs[USER], min(costs[START], costs[SYSTEM], costs[ASSISTANT]) + INSERT)
    return [costs[START], costs[SYSTEM], user, min(costs[ASSISTANT], user + INSERT)]


def _inserted_before(costs: list[int]) -> list[int]:
    """The same for costs to the end."""
    user, assistant = min(costs[USER], costs[ASSISTANT] + INSERT), min(costs[ASSISTANT], costs[USER] + INSERT)
    return [min(costs[START], user + INSERT), min(costs[SYSTEM], user + INSERT), user, assistant]


END = _inserted_before([0, FAR, FAR, 0])


def forward(layers, start: list[int]) -> list[list[int]]:
    """Least costs of each layer's nodes, insertions included; the last entry is what arrives behind the last row, without them."""
    out, now = [], start
    for arcs in layers:
        now = _inserted_after(now)
        out.append(now)
        then = [FAR] * 4
        for state in STATES:
            for _, to, cost in arcs[state]:
                then[to] = min(then[to], now[state] + cost)
        now = then
    return [*out, now]


def backward(layers, end: list[int]) -> list[list[int]]:
    """Least costs to the end from each layer's nodes, insertions included; the last entry is ``end``."""
    out = [end]
    for arcs in reversed(layers):
        out.append(_inserted_before([min(cost + out[-1][to] for _, to, cost in arcs[state]) for state in STATES]))
    return out[::-1]


def least(ahead: list[int]) -> int:
    """The least cost of a conversation from what arrives behind its last row."""
    return min(a + b for a, b in zip(ahead, END, strict=True))


def walk(layers, ahead, behind, total: int, entry: int, last: bool) -> tuple[str, list[int], int]:
    """Letters and the state after each, along tight arcs from ``entry``, and the state at the end."""
    letters, states, frontier, at = [], [], {entry}, 0
    while at < len(layers) or last:
        before = ahead[at] if at < len(layers) else _inserted_after(ahead[at])
        if at == len(layers) and any(before[s] == total and s in (START, ASSISTANT) for s in frontier):
            break
        tight = {}
        for state in frontier:
            if before[state] + INSERT + behind[at][NEXT[state]] == total:
                tight.setdefault("I", set()).add(NEXT[state])
            for letter, to, cost in layers[at][state] if at < len(layers) else ():
                if before[state] + cost + behind[at + 1][to] == total:
                    tight.setdefault(letter, set()).add(to)
        letter = min(tight)
        frontier = tight[letter]
        at += letter != "I"
        letters.append(letter)
        # Every letter leads from one state to one other, so the set never has more than one.
        states.append(min(frontier))
    return "".join(letters), states, min(frontier)


def edits(rows: list[tuple[str, str]], letters: str, states: list[int]) -> list[dict]:
    """What each letter does, with the role and text that it leaves (those of a deleted row are what it had)."""
    out, given = [], iter(rows)
    for letter, state in zip(letters, states, strict=True):
        role, text = ("", "") if letter == "I" else next(given)
        out.append({"edit": letter, "role": ROLES[state] if letter in "IR" else role, "text": text})
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _whole(key, rows) -> dict:
    """The piece of a whole conversation; ``rows`` are its (turn, role, text) in order."""
    seen, whats = set(), []
    for _, role, text in rows:
        whats.append(fault(role, text, (role, text) not in seen))
        seen.add((role, text))
    layers = [row_arcs(role[:1], what) for (_, role, _), what in zip(rows, whats, strict=True)]
    ahead, behind = forward(layers, [0, FAR, FAR, FAR]), backward(layers, END)
    letters, states, _ = walk(layers, ahead, behind, least(ahead[-1]), START, True)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    out = {"conv_id": key, "piece": 0, "edits": edits([r[1:] for r in rows], letters, states), "gaps": gaps, "illegal": _illegal([r[:1] for _, r, _ in rows]), "cost": least(ahead[-1])}
    return out | {f: whats.count(f) for f in FAULTS}


def _mapped(df: DataFrame, batches, schema: pa.Schema) -> DataFrame:
    return df.mapInArrow(batches, from_arrow_schema(schema))


def _groups(batches, columns):
    """(key, rows) of a sorted stream, a key's rows together; for keys that a task may hold."""
    key, rows, none = None, [], True
    for batch in batches:
        for k, *row in zip(batch.column("conv_id").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if not none and k != key:
                yield key, rows
                rows = []
            key, none = k, False
            rows.append(row)
    if not none:
        yield key, rows


def _repair_whole(batches):
    out = []
    for key, rows in _groups(batches, ("gone", "turn", "role", "text")):
        out.append(_whole(key, [r[1:] for r in rows if not r[0]]))
        if len(out) == 256:
            yield pa.RecordBatch.from_pylist(out, PIECE)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, PIECE)


ORDER = ("conv_id", "turn", "role", "_tie")
def _chunks(rows: int, chars: int):
    """Rows of a range in order, cut into chunks of one conversation; the chunks of all ranges stand in order of (part, seq)."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, key, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            for k, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if held and (k != key or len(held) >= rows or size >= chars):
                    yield pa.RecordBatch.from_pylist([{"conv_id": key, "part": part, "seq": seq, "rows": held}], CHUNK)
                    seq, held, size = seq + 1, [], 0
                key = k
                held.append({"turn": turn, "role": role, "text": text})
                size += len(text)
        if held:
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "part": part, "seq": seq, "rows": held}], CHUNK)

    return run


def _layers(rows, firsts):
    first = set(firsts)
    whats = [fault(r["role"], r["text"], i in first) for i, r in enumerate(rows)]
    return [row_arcs(r["role"][:1], w) for r, w in zip(rows, whats, strict=True)], whats


def _matrices(batches):
    """Of each chunk the least cost from every state before it to every state behind it, and what its measures need."""
    for batch in batches:
        for c in batch.to_pylist():
            layers, whats = _layers(c["rows"], c["firsts"])
            costs = [x for s in STATES for x in forward(layers, [0 if s == k else FAR for k in STATES])[-1]]
            turns = [r["turn"] for r in c["rows"] if r["turn"] is not None]
            initials = [r["role"][:1] for r in c["rows"]]
            about = {"low": min(turns, default=None), "high": max(turns, default=None), "distinct": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None}
            yield pa.RecordBatch.from_pylist([{k: c[k] for k in ("conv_id", "part", "seq")} | about | {"costs": costs, "first": initials[0], "last": initials[-1], "illegal": _illegal(initials)} | {f: whats.count(f) for f in FAULTS}], MATRIX)


_COLUMNS = MATRIX.names[1:]


def _borders(batches):
    """The costs at the borders of a conversation's chunks, composed in order from their matrices; its measures go to the first chunk."""
    for key, rows in _groups(batches, _COLUMNS):
        chunks = [dict(zip(_COLUMNS, r, strict=True)) for r in rows]
        at = [[0, FAR, FAR, FAR]]
        for c in chunks:
            at.append([min(FAR, *(at[-1][x] + c["costs"][4 * x + y] for x in STATES)) for y in STATES])
        to = [END]
        for c in reversed(chunks):
            to.append([min(FAR, *(c["costs"][4 * x + y] + to[-1][y] for y in STATES)) for x in STATES])
        to.reverse()
        dated = [c for c in chunks if c["low"] is not None]
        again = sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
        gaps = dated[-1]["high"] - dated[0]["low"] + 1 - sum(c["distinct"] for c in dated) + again if dated else 0
        illegal = sum(c["illegal"] for c in chunks) + sum(_illegal([a["last"], b["first"]]) for a, b in zip(chunks, chunks[1:], strict=False))
        whole = {"gaps": gaps, "illegal": illegal, "cost": least(at[-1])} | {f: sum(c[f] for c in chunks) for f in FAULTS}
        for i, c in enumerate(chunks):
            measures = whole if i == 0 else dict.fromkeys(MEASURES, 0)
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "part": c["part"], "seq": c["seq"], "last": i == len(chunks) - 1, "ahead": at[i], "behind": to[i + 1], "total": least(at[-1])} | measures], BORDER)


def _ways(batches):
    """For each state that a cheapest path can enter a chunk in, the walk through it."""
    for batch in batches:
        for c in batch.to_pylist():
            layers, _ = _layers(c["rows"], c["firsts"])
            ahead, behind = forward(layers, c["ahead"]), backward(layers, c["behind"])
            ways = []
            for entry in STATES:
                if c["ahead"][entry] < FAR and c["ahead"][entry] + behind[0][entry] == c["total"]:
                    letters, states, left = walk(layers, ahead, behind, c["total"], entry, c["last"])
                    ways.append({"entry": entry, "exit": left, "letters": letters, "states": bytes(states)})
            yield pa.RecordBatch.from_pylist([{k: c[k] for k in ("conv_id", "part", "seq")} | {"ways": ways}], WAYS)


def _chosen(batches):
    """The walk of each chunk that goes on where the last one's ended."""
    key, state, none = None, START, True
    for batch in batches:
        out = []
        for c in batch.to_pylist():
            if none or c["conv_id"] != key:
                key, state, none = c["conv_id"], START, False
            way = next(w for w in c["ways"] if w["entry"] == state)
            state = way["exit"]
            out.append({"part": c["part"], "seq": c["seq"], "letters": way["letters"], "states": way["states"]})
        yield pa.RecordBatch.from_pylist(out, WAY)


def _edited(batches):
    for batch in batches:
        for c in batch.to_pylist():
            done = edits([(r["role"], r["text"]) for r in c["rows"]], c["letters"], list(c["states"]))
            yield pa.RecordBatch.from_pylist([{"conv_id": c["conv_id"], "piece": (c["part"] << 32) + c["seq"], "edits": done} | {m: c[m] for m in MEASURES}], PIECE)


def _repair_long(rows: DataFrame, chunk_rows: int, chunk_chars: int) -> DataFrame:
    """Pieces of long conversations, one a chunk."""
    spark = rows.sparkSession
    order = (*ORDER, "_uid")
    ranged = rows.where("NOT gone").withColumn("_uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = cut(_mapped(ranged.select("conv_id", "turn", "role", "text"), _chunks(chunk_rows, chunk_chars), CHUNK))
    # The first row of each role and text, by place; a chunk then knows which of its rows are firsts. Equal rows are added up before they meet.
    each = chunks.select("conv_id", "part", "seq", F.posexplode("rows").alias("pos", "row"))
    firsts = each.groupBy("conv_id", F.sha2(F.concat_ws("\n", "row.role", "row.text"), 256).alias("d"), F.length("row.role").alias("l")).agg(F.min(F.struct("part", "seq", "pos")).alias("at"))
    firsts = firsts.groupBy("at.part", "at.seq").agg(F.collect_list("at.pos").alias("firsts"))
    full = cut(chunks.join(firsts, ["part", "seq"], "left").withColumn("firsts", F.coalesce("firsts", F.array().cast("array<int>"))))
    # The spark of one chunk at a time: chunks are as large as a task should hold.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    place = ("conv_id", "part", "seq")
    matrices = cut(_mapped(full, _matrices, MATRIX))
    borders = cut(_mapped(matrices.repartition("conv_id").sortWithinPartitions(*place), _borders, BORDER))
    ways = cut(_mapped(full.join(borders.drop("conv_id", *MEASURES), ["part", "seq"]), _ways, WAYS))
    way = cut(_mapped(ways.repartition("conv_id").sortWithinPartitions(*place), _chosen, WAY))
    out = cut(_mapped(full.join(borders.select("part", "seq", *MEASURES), ["part", "seq"]).join(way, ["part", "seq"]), _edited, PIECE))
    bounded_batches(spark)
    # A conversation that lost all of its rows has no chunk.
    bare = rows.groupBy("conv_id").agg(F.bool_and("gone").alias("bare")).where("bare").select("conv_id", F.lit(0).cast("long").alias("piece"), F.array().cast(from_arrow_type(EDITS)).alias("edits"), *[F.lit(0).cast("long").alias(m) for m in MEASURES])
    return out.unionByName(bare)


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Edits of every conversation in ``rows (conv_id, turn, role, text, gone)``: pieces of conversations that are one piece, and pieces of long ones.

    Rows that are ``gone`` only tell that their conversation exists. A piece has its edits in order and the measures of its
    conversation, which are zero in all but the first piece.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone").withColumn("_tie", F.xxhash64("text"))
    sized = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    at_least = max(long_rows, -(-total.n // LARGE_GROUPS)), max(long_bytes, -(-(total.size or 0) // LARGE_GROUPS))
    # At most 2 * LARGE_GROUPS conversations hold so large a share of the rows or bytes.
    long = F.broadcast(cut(sized.where((F.col("n") >= at_least[0]) | (F.col("size") >= at_least[1])).select(F.col("conv_id").alias("_long"))))
    same = rows["conv_id"].eqNullSafe(long["_long"])
    few = rows.join(long, same, "left_anti").repartition("conv_id").sortWithinPartitions(*ORDER)
    short = _mapped(few.select("conv_id", "gone", "turn", "role", "text"), _repair_whole, PIECE)
    many = rows.join(long, same, "left_semi")
    return short, many.sparkSession.createDataFrame([], from_arrow_schema(PIECE)) if long.isEmpty() else _repair_long(many, chunk_rows, chunk_chars)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The rows of repaired conversations, numbered anew: conv_id, piece, step, role, text; in order of piece and step."""
    whole, long = repair(rows)
    return whole.unionByName(long).select("conv_id", "piece", F.posexplode("edits").alias("step", "e")).where("e.edit <> 'D'").select("conv_id", "piece", "step", "e.role", "e.text")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows (conv_id, turn, role, text)`` with the faults that a checksum of id and turn deals to them; dropped rows are ``gone``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("_kind", F.crc32(key) % 20)
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    out = rows.withColumns({"text": text, "role": F.when(kind == 4, "user").otherwise(F.col("role")), "gone": kind == 0})
    return out.select("conv_id", "turn", "role", "text", "gone", times.alias("_nth")).drop("_nth")


def _digests(batches):
    """One row per conversation of a stream of pieces in order; a piece is held at a time."""
    from hashlib import sha256

    none, now, audit, digest, begun, out = True, {}, [], sha256(), False, []

    def finished():
        return now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        for p in batch.to_pylist():
            if none or p["conv_id"] != now["conv_id"]:
                if not none:
                    out.append(finished())
                none, now, audit, digest, begun = False, {"conv_id": p["conv_id"]} | dict.fromkeys(MEASURES, 0), [], sha256(), False
            for m in MEASURES:
                now[m] += p[m]
            for e in p["edits"]:
                audit.append(e["edit"])
                if e["edit"] != "D":
                    digest.update(f"{chr(10) if begun else ''}{e['role']}:{e['text']}".encode())
                    begun = True
        if len(out) >= 256:
            yield pa.RecordBatch.from_pylist(out, DIGEST)
            out = []
    if not none:
        out.append(finished())
    if out:
        yield pa.RecordBatch.from_pylist(out, DIGEST)


def digests(whole: DataFrame, long: DataFrame) -> DataFrame:
    """Measures, audit and digest of every conversation; only the pieces of long ones are brought together, as a stream."""
    return _mapped(whole, _digests, DIGEST).unionByName(_mapped(long.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), _digests, DIGEST))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(*repair(damaged(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH bits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..')] AS b FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[x, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN b])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS kind FROM bits),
after_damage AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS nth FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS k, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown FROM after_damage),
judged AS (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(shown, '[.!?]$') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS initial,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
measures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY 1),
arcs AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(state, initial, next)),
moves AS (SELECT j.conv_id, j.k, a.state, 'K' AS letter, a.next, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cost, j.role || ':' || j.text AS line FROM judged j JOIN arcs a ON j.initial = a.initial WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, k, state, 'R', CASE WHEN state = 2 THEN 3 ELSE 2 END, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || text FROM judged, (SELECT unnest([0, 1, 2, 3]) AS state) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, k, state, 'D', state, 4, NULL FROM judged, (SELECT unnest([0, 1, 2, 3]) AS state)),
inserts AS (SELECT * FROM (VALUES (0, 0, '', []::VARCHAR[], 0), (1, 1, '', [], 0), (2, 2, '', [], 0), (3, 3, '', [], 0), (0, 2, 'I', ['user:'], 3), (0, 3, 'II', ['user:', 'assistant:'], 6), (1, 2, 'I', ['user:'], 3), (1, 3, 'II', ['user:', 'assistant:'], 6),
  (2, 3, 'I', ['assistant:'], 3), (3, 2, 'I', ['user:'], 3)) AS v(state, next, letters, lines, cost)),
steps AS (SELECT m.conv_id, m.k, i.state, m.next, i.letters || m.letter AS letters, CASE WHEN m.line IS NULL THEN i.lines ELSE list_append(i.lines, m.line) END AS lines, i.cost + m.cost AS cost FROM inserts i JOIN moves m ON m.state = i.next),
paths AS (WITH RECURSIVE p AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM measures
  UNION ALL SELECT b.conv_id, b.k, b.next, b.best.cost, b.best.audit, b.best.lines FROM (SELECT p.conv_id, s.k, s.next, min({'cost': p.cost + s.cost, 'audit': p.audit || s.letters, 'lines': p.lines || s.lines}) AS best FROM p JOIN steps s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND s.k = p.k + 1 AND s.state = p.state GROUP BY 1, 2, 3) b)
  SELECT * FROM p),
ends AS (SELECT p.conv_id, min({'cost': p.cost + i.cost, 'audit': p.audit || i.letters, 'lines': p.lines || i.lines}) AS best FROM paths p JOIN measures m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.k = m.n JOIN inserts i ON i.state = p.state WHERE i.next IN (0, 3) GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN measures m ON c.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
