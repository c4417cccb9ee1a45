import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tabeval.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, letters, roles and rows) by trying every edit, no costs to go: rows are (initial, fault)."""
    onto = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        ways = []
        if i == len(rows):
            if last in ("", "a"):
                ways.append((0, "", ()))
        else:
            initial, fault = rows[i]

            def go(cost, letter, after, told):
                c, text, more = best(i + 1, after, 0)
                ways.append((cost + c, letter + text, told + more))

            go(4, "D", last, ())
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if initial == onto[last] or (initial == "s" and last == ""):
                    go(extra, "K", initial, (("K", i, initial),))
                go(3 + extra, "R", onto[last], (("R", i, onto[last]),))
        if inserted < 2:
            c, text, more = best(i, onto[last], inserted + 1)
            ways.append((3 + c, "I" + text, (("I", i, onto[last]),) + more))
        return min(ways, default=(10**9, "~", ()))

    return best(0, "", 0)


def test_walk_is_the_ascii_least_of_the_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice("suuaax "), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 14))]
        cost, letters, told = cheapest(tuple(rows))
        edits, state = repair.walk(rows, 0, repair.FINAL, True)
        assert "".join(e[0] for e in edits) == letters and state in (0, 3)
        assert [(e, i, " sua"[q]) for e, i, q in edits if e != "D"] == list(told)
        assert repair._before(repair.FINAL, rows)[0] == cost


def test_fragments_lead_to_the_same_edits():
    rng = random.Random(2)
    for _ in range(100):
        rows = [(rng.choice("suax"), rng.choice(["", "", "blank", "truncated"])) for _ in range(30)]
        whole, _ = repair.walk(rows, 0, repair.FINAL, True)
        cuts = [0, *sorted(rng.sample(range(1, 30), 3)), 30]
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        ends, end = [], repair.FINAL
        for part in reversed(parts):
            ends.append(end)
            told = repair.fragment_matrix(part)
            end = tuple(min(told[e][q] + end[e] for e in range(4)) for q in range(4))
        state, out = 0, []
        for k, (part, end) in enumerate(zip(parts, reversed(ends))):
            edits, state = repair.walk(part, state, end, k == 3)
            out += [(e, i + cuts[k], q) for e, i, q in edits]
        assert out == whole


SCHEMA = "conv_id long, turn long, role string, text string, present boolean, conv string, edit int, `print` long, whole string"


def rows_of(rng, n, conv):
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Fine.", "So it is!", "cut off", "", "  \n", None, "Why?", "é. ", "x" * 200]
    return [(conv, rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts) or (None if rng.random() < 0.5 else "")) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, True, "c", 1, 2, "w") for r in rows], SCHEMA)


def brute_force(rows):
    """Per conversation all columns of the report; ``rows`` as (conversation, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [(t is not None, t or 0, r if r is not None else " ", x if x is not None else " ", t) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (*r[:3], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, coded = set(), []
        for _, _, role, text, _ in own:
            solid = text.rstrip(SPACES)
            again = (role, text) in seen
            seen.add((role, text))
            coded.append((role[:1], "blank" if not solid else "duplicate" if again else "" if solid[-1] in ".!?" else "truncated"))
        cost, letters, told = cheapest(tuple(coded))
        lines = []
        for edit, i, initial in told:
            role = {"u": "user", "a": "assistant"}.get(initial)
            lines.append((own[i][2] if edit == "K" else role) + ":" + ("" if edit == "I" else own[i][3]))
        turns = [r[4] for r in own if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [f for _, f in coded]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(coded, coded[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [repair.BLOCK, 4])
def test_report_matches_brute_force(spark, block):
    """Missing and tied turns, missing conversations, roles and texts, repeated rows; with a small block
    conversations are cut into many fragments, one of them holding a third of all rows."""
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(12)]:
        rows += rows_of(rng, rng.randint(1, 9), conv)
    rows += rows_of(rng, 30, 99) + [(50, 1, "user", "Same.")] * 9 + [(51, None, "user", "Same.")]
    found = sorted((tuple(r) for r in repair.repair_report(table(spark, rows), block=block).collect()), key=repr)
    assert found == brute_force(rows)


def test_repaired_rows_are_legal_and_whole(spark):
    rng = random.Random(4)
    rows = [r for conv in range(8) for r in rows_of(rng, 12, conv)]
    edits = repair.repair(table(spark, rows), block=5).orderBy("conv_id", "fragment", "place").collect()
    report = {r.conv_id: r for r in repair.repair_report(table(spark, rows)).collect()}
    for conv in range(8):
        own = [e for e in edits if e.conv_id == conv]
        assert "".join(e.edit for e in own) == report[conv].audit
        assert sum(e.edit != "I" for e in own) == 12
        kept = [e for e in own if e.edit != "D"]
        text = "\n".join(f"{e.role}:{e.text}" for e in kept)
        assert hashlib.sha256(text.encode()).hexdigest() == report[conv].repaired_sha256
        roles = "".join(e.role[0] for e in kept)
        assert roles.lstrip("s").replace("ua", "") == "" and roles.count("s") <= 1


def test_damage_and_conversations_without_rows(spark):
    """Each kind of damage where its draw says so; a conversation whose rows are all dropped has zeros."""
    rows = [(c, t, "assistant", "One. Two! Three") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    df = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in df.collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    for c, t, role, text in rows:
        name = " " if c is None else c, " " if t is None else t
        draw = zlib.crc32(f"{name[0]}:{name[1]}".encode()) % 20
        role, text = role or " ", text or " "
        want = [(role, "" if draw == 1 else text.translate(str.maketrans("", "", ".!?")) if draw == 2 else text, draw != 0)]
        want = [("user", *want[0][1:])] if draw == 4 else want * 2 if draw == 3 else want
        assert got[c, t] == want
    gone = [c for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, 0, "user", "Hi.") for c in gone], "conv_id long, turn long, role string, text string")
    report = repair.repair_report(repair.damaged(df), present="present").collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in report) == [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c in gone]


def test_empty_table(spark):
    assert repair.repair_report(table(spark, [])).count() == 0 and repair.repair(table(spark, [])).count() == 0


def test_long_texts_and_other_key_types(spark):
    rows = [("a", 2.5, "user", "word " * 50_000), ("a", 1.0, "system", "Be.")]
    df = spark.createDataFrame(rows, "conv_id string, turn double, role string, text string")
    assert [r.edit for r in repair.repair(df).orderBy("place").collect()][0] in "KD"
