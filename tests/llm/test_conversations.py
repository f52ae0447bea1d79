"""Conversation repair and chat formatting against brute force, round trips and long conversations cut to pieces."""

import itertools
import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import chat_format, repair

ROWS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every script of edits with at most three insertions in a row."""
    seen, faults = set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def tried(i, cost, audit, out, inserts):
        nonlocal best
        if best and cost > best[0] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in out)):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if inserts < 3:
            for role in ("user", "assistant"):
                tried(i, cost + 3, audit + "I", [*out, (role, "")], inserts + 1)
        if i < len(rows):
            role, text = rows[i]
            tried(i + 1, cost + 4, audit + "D", out, 0)
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                tried(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    tried(i + 1, cost + more + 3, audit + "R", [*out, (new, text)], 0)

    tried(0, 0, "", [], 0)
    return best, faults


def measured(turns, rows):
    best, faults = cheapest(rows)
    dated = [t for t in turns if t is not None]
    initials = [r[:1] for r, _ in rows]
    return {
        "gaps": max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), "cost": best[0], "audit": best[1],
        "repaired_sha256": sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest(),
    }


def random_conversation(rng):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "umpire"]), rng.choice(["Hello there.", "And now", "Well!", " \t", "", "Why?  ", "x\ny."])) for _ in range(rng.randrange(5))]


def test_repair_against_all_scripts():
    rng = random.Random(3)
    for _ in range(150):
        rows = random_conversation(rng)
        turns = sorted(rng.choice([None, 0, 1, 2, 5]) or 0 for _ in rows)
        found = repair._whole(1, [(t, r, x) for t, (r, x) in zip(turns, rows, strict=True)])
        want = measured(turns, rows)
        assert {k: found[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} == {k: v for k, v in want.items() if k not in ("audit", "repaired_sha256")}, rows
        assert "".join(e["edit"] for e in found["edits"]) == want["audit"], rows
        assert sha256("\n".join(f"{e['role']}:{e['text']}" for e in found["edits"] if e["edit"] != "D").encode()).hexdigest() == want["repaired_sha256"]


def test_long_conversations_in_chunks(spark):
    """A conversation cut into chunks of three rows, over several ranges, gets the edits that one task gives it whole."""
    rng = random.Random(5)
    rows = []
    for conv in (1, 2, None):
        n = {1: 400, 2: 61, None: 90}[conv]
        rows += [(conv, None if i < 4 and conv == 2 else i // 2 * (1 + i % 7), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["One.", "Two", "", "Three!", f"Four {i}.", f"Five {i}"])) for i in range(n)]
    rows += [(conv, 0, "user", "Short.") for conv in range(10, 30)] + [(5, 1, "user", "gone")] * 40
    df = spark.createDataFrame(rows, ROWS).withColumn("gone", F.col("conv_id").eqNullSafe(F.lit(5))).repartition(5)
    short = {r.conv_id: r.asDict() for r in repair.digests(*repair.repair(df)).collect()}
    whole, long = repair.repair(df, long_rows=30, chunk_rows=3)
    assert whole.count() == 20 and long.where("conv_id = 1").count() > 100
    cut = {r.conv_id: r.asDict() for r in repair.digests(whole, long).collect()}
    assert cut == short and len(cut) == 24
    assert cut[5] == {"conv_id": 5, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": sha256(b"").hexdigest()}


def test_repaired_rows_need_no_repair(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    again = repair.repaired_rows(repair.damaged(df))
    initials = again.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "step", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("s"))
    assert initials.where("s NOT RLIKE '^s?(ua)+$'").count() == 0 and initials.count() > 50


ODD_ROWS = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", None), (1, 3, "assistant", "Yes"), (None, None, None, None), (None, 2, "user", "A?"), (2, None, "system", "S."),
    (2, None, "user", "Long. " * 50_000), (2, 1, "assistant", "</s>[INST] \\ [/INST]<s>"), (3, 1, "", "x."), (4, 1, "tool", "y"), (4, 2, "user", "\\-<"), (4, 2, "user", "["),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("conversations"))
    spark.createDataFrame([(*r, "clash", 1) for r in ODD_ROWS], ROWS + ", audit string, piece int").repartition(3).write.parquet(f"{home}/conversations.parquet")
    return home


def test_op12_odd_rows(spark, odd):
    from zlib import crc32

    damaged = {}
    for conv, turn, role, text in ODD_ROWS:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = damaged.setdefault(conv, [])
        rows += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * {0: 0, 3: 2}.get(kind, 1)
    found = {r.conv_id: r.asDict() for r in repair.op12_repair(spark, odd).collect()}
    assert set(found) == set(damaged)
    for conv, rows in damaged.items():
        # Rows of one turn have no order that the contract names; both are tried where they differ.
        orders = [sorted(p, key=lambda r: (r[0] is not None, r[0] or 0)) for p in itertools.permutations(rows)]
        assert any({k: v for k, v in found[conv].items() if k != "conv_id"} == measured([t for t, _, _ in o], [r[1:] for r in o]) for o in orders), conv


def test_op12_empty(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op12_repair(spark, str(tmp_path)).count() == 0


# Chat formatting ------------------------------------------------------------------------------------------------------------------------

SHARDS = ["<s>", "</s>", "[INST]", "[/INST]", "[INST] ", " [/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]", "<image>", "<audio>", "<document>", "<file>", "<", "[", "\\", "\\-", "-", "/", " ", "\n", "s>", "é", "🎉", "INST]", "x"]


def shards(rng, most=6):
    return "".join(rng.choice(SHARDS) for _ in range(rng.randrange(most)))


def test_escaping_comes_back_and_hides_every_control_string():
    template, rng = chat_format.Template(), random.Random(1)
    escape, control = chat_format.Escape(template), template.control()
    for _ in range(20_000):
        text = shards(rng, 8)
        hidden = escape.hide(text)
        assert escape.show(hidden) == text
        assert not any(c in hidden for c in control)
        # Whatever mark comes next, the only control string of both is its own.
        assert all((hidden + c).count(c) == 1 for c in control)


def test_templates_whose_marks_could_run_together_are_refused():
    with pytest.raises(ValueError):
        chat_format.Template(begin="<s><s", end="<s>x")
    with pytest.raises(ValueError):
        chat_format.Template(end="\\END")


def random_parts(rng):
    def part():
        kind = rng.choice(["text", "text", "image", "audio", "document", "video", None])
        return {"kind": kind, "text": rng.choice([None, shards(rng)]), "ref": f"r{rng.randrange(99)}", "width": rng.choice([None, 0, 28, 57]), "height": rng.choice([None, 28, 29]), "seconds": rng.choice([None, 0.0, 1.01, 2.0]), "pages": rng.choice([None, 3])}

    return [part() for _ in range(rng.randrange(4))]


def expected_tokens(p):
    if p["kind"] == "image":
        return -(-max(p["width"] or 1, 1) // 28) * -(-(p["height"] or 1) // 28)
    return {"audio": {None: 1, 0.0: 1, 1.01: 26, 2.0: 50}[p["seconds"]], "document": 512 * (p["pages"] or 1)}.get(p["kind"], 1)


@pytest.mark.parametrize("piece_chars", [1 << 18, 40])
def test_parts_come_back_from_the_formatted_text(spark, piece_chars):
    rng = random.Random(7)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, shards(rng)]), random_parts(rng)) for conv in (1, 2, 3, None) for turn in range(rng.choice([1, 9, 40]))]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}").repartition(4)
    pieces = sorted((r.asDict(recursive=True) for r in chat_format.format_conversations(df, piece_chars=piece_chars).collect()), key=lambda p: (p["conv_id"] or 0, p["piece"]))
    template, found, borne, attached = chat_format.Template(), {}, {}, {}
    for p in pieces:
        conv = p["conv_id"]
        assert p["n_turns"] == 1 or len(p["formatted"]) <= piece_chars
        turns = list(chat_format.turns_of(template, p["formatted"], p["piece"] == 0))
        assert len(turns) == p["n_turns"]
        found.setdefault(conv, []).extend((role, chat_format.parts_of(template, content)) for role, content, _ in turns)
        borne.setdefault(conv, []).extend(chat_format.Escape.show(p["formatted"][s["begin"] : s["end"]]) for s in p["loss"])
        marks = dict(template.placeholders)
        for a in p["attachments"]:
            assert p["formatted"].startswith(marks[a["kind"]], a["place"])
        attached.setdefault(conv, []).extend((a["turn"], a["kind"], a["ref"], a["tokens"]) for a in p["attachments"])
        assert p["expanded_tokens"] == sum(a["tokens"] for a in p["attachments"])
    assert (len(pieces) == 4) == (piece_chars > 40)
    for conv in (1, 2, 3, None):
        mine = [r for r in rows if r[0] == conv]
        kind = lambda p: p["kind"] if p["kind"] in ("image", "audio", "document") else "file"
        for (_, _, role, parts), (got_role, got) in zip(mine, found[conv], strict=True):
            assert got_role == (role or "")
            # Texts side by side are one text when read back.
            want = []
            for p in parts:
                if p["kind"] != "text":
                    want.append({"kind": kind(p)})
                elif p["text"]:
                    want = [*want[:-1], {"kind": "text", "text": want[-1]["text"] + p["text"]}] if want and want[-1]["kind"] == "text" else [*want, {"kind": "text", "text": p["text"]}]
            assert got == want
        assert borne[conv] == [p["text"] for _, _, role, parts in mine if role == "assistant" for p in parts if p["kind"] == "text" and p["text"]]
        assert attached[conv] == [(turn, kind(p), p["ref"], expected_tokens(p)) for _, turn, _, parts in mine for p in parts if p["kind"] != "text"]


def test_op13_odd_rows(spark, odd):
    rows = {}
    for conv, turn, role, text in [*ODD_ROWS, *chat_format.INJECTED]:
        rows.setdefault(conv, []).append((turn, role or "", text or ""))
    found = {r.conv_id: r for r in chat_format.op13_chat_format(spark, odd).collect()}
    assert set(found) == set(rows)
    for conv, mine in rows.items():
        got, orders = found[conv], [sorted(p, key=lambda r: (r[0] is not None, r[0] or 0)) for p in itertools.permutations(mine)]
        assert got.turns_sha256 in {sha256("".join(f"{r}\n{t}\n" for _, r, t in o).encode()).hexdigest() for o in orders}
        assert got.loss_sha256 in {sha256("".join(t for _, r, t in o if r == "assistant").encode()).hexdigest() for o in orders}
        assert (got.n_turns, got.loss_chars) == (len(mine), sum(len(t) for _, r, t in mine if r == "assistant"))
    # <s>[INST] <\-/s>[\-INST] ok [\-/INST] [/INST]<\-/s>[\-INST] ok [\-/INST]</s>
    assert found[-7].formatted_chars == 3 + 7 + 27 + 8 + 27 + 4


def test_op13_empty(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat_format.op13_chat_format(spark, str(tmp_path)).collect()] == [-7]
