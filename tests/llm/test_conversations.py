import hashlib
import itertools
import random
import re
import zlib

import pytest

from galeframe.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, kind string, part int, row long, fault int, told string, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "t", 4) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """Of rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not own else "duplicate" if (role, text) in seen else "" if own[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def inserts(places, left):
    """What is inserted at each place, at most ``left`` turns in all."""
    if places == 0:
        yield ()
        return
    for n in range(left + 1):
        for own in itertools.product("ua", repeat=n):
            for rest in inserts(places - 1, left - n):
                yield (own, *rest)


def all_edits(rows, found):
    """(cost, audit, roles and texts) of every edit script that may be cheapest: three inserts cost more than to delete all of up to seven rows."""
    assert len(rows) <= 7
    for edits in itertools.product("KDua", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, found, strict=True)):
            continue
        base = sum({"K": 0, "D": 2}.get(e, 1) + 5 * (f == "truncated" and e != "D") for e, f in zip(edits, found, strict=True))
        for inserted in inserts(len(rows) + 1, 2):
            roles, audit, kept, cost = "", "", [], base
            for k in range(len(rows) + 1):
                for role in inserted[k]:
                    roles, audit, cost = roles + role, audit + "I", cost + 5
                    kept.append(({"u": "user", "a": "assistant"}[role], ""))
                if k < len(rows):
                    audit += edits[k] if edits[k] in "KD" else "R"
                    if edits[k] != "D":
                        role = rows[k][2] if edits[k] == "K" else {"u": "user", "a": "assistant"}[edits[k]]
                        roles += role[:1] or "-"
                        kept.append((role, rows[k][3]))
            if re.fullmatch("(s?(ua)+)?", roles):
                yield cost, audit, kept


def expected(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    found = faults(rows)
    cost, audit, kept = min(all_edits(rows, found))
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = ["".join((a[2][:1], b[2][:1])) for a, b in itertools.pairwise(rows)]
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


def invented(seed, n_conversations, most=4):
    r = random.Random(seed)
    return [
        (None if conv == 0 else conv, r.choice([None, *range(most)]) if r.random() < 0.2 else turn, r.choice(["system", "user", "assistant", "assistant", "tool", None, "", "User"]), r.choice(["Yes.", "No", "é!  ", None, "", "Why?\n", f"{seed} {r.randint(0, 9)}."]))
        for conv in range(n_conversations)
        for turn in range(r.randint(1, most))
    ]


def told(rows):
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0]))


@pytest.mark.parametrize("held", [c.HELD_BYTES, 0])
def test_equals_all_edit_scripts(spark, monkeypatch, held):
    """With nothing held, every conversation is put together from the parts of its tasks."""
    monkeypatch.setattr(c, "HELD_BYTES", held)
    monkeypatch.setattr(c, "CHUNK", 2)
    rows = invented(5, 60, 3)
    by_conv = {conv: [] for conv, *_ in rows}
    for r in damaged(rows):
        by_conv[r[0]].append(r)
    want = sorted((expected(conv, found) for conv, found in by_conv.items()), key=lambda r: (r[0] is not None, r[0]))
    assert told(c.report(c.damage(table(spark, rows)))) == want


def one_by_one(rows):
    """The same by a plain pass over turns, for long conversations."""
    best = {0: (0, "")}
    for r, f in zip(rows, faults(rows), strict=True):
        for _ in range(3):
            for i, role in itertools.product(list(best), "ua"):
                if i in c._NEXT[role]:
                    new = (best[i][0] + 5, best[i][1] + "I")
                    best[c._NEXT[role][i]] = min(best.get(c._NEXT[role][i], new), new)
        after = {i: (cost + 2, a + "D") for i, (cost, a) in best.items()}
        if f in ("", "truncated"):
            for i, (cost, a) in best.items():
                for role, letter, price in ((r[2][:1], "K", 0), ("u", "R", 1), ("a", "R", 1)):
                    j = c._NEXT.get(role, {}).get(i)
                    if j is not None:
                        new = (cost + price + 5 * (f == "truncated"), a + letter)
                        after[j] = min(after.get(j, new), new)
        best = after
    for _ in range(3):
        for i, role in itertools.product(list(best), "ua"):
            if i in c._NEXT[role]:
                new = (best[i][0] + 5, best[i][1] + "I")
                best[c._NEXT[role][i]] = min(best.get(c._NEXT[role][i], new), new)
    return min(best[i] for i in c._ENDS if i in best)


def test_long_conversations_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(c, "FAN_IN", 2)
    r = random.Random(9)
    turns = 3000
    rows = [(1, k, r.choice(["user", "assistant", "system", "tool"]), f"{r.randint(0, 2000)}{r.choice(['.', ''])}") for k in range(turns)] + [(2, k, ["user", "assistant"][k % 2], f"{k}!") for k in range(20)]
    want = one_by_one([x for x in rows if x[0] == 1])
    n = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions, coalesce in (("1", "true"), ("23", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            results.append(told(c.report(table(spark, rows))))
            fixed = c.repair(table(spark, rows)).orderBy("conv_id", "place").collect()
            for conv, *_, audit, digest in results[-1]:
                mine = [t for t in fixed if t.conv_id == conv]
                assert [t.place for t in mine] == list(range(len(mine))) and "".join(t.edit for t in mine) == audit.replace("D", "")
                assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == digest
                assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in mine))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1]
    assert results[0][0][6:8] == want and results[0][1][6:8] == (0, "K" * 20)


def test_very_long_texts_ties_and_nothing(spark):
    rows = [(1, 0, "user", "x" * 9_000_000 + "?"), (1, 1, "assistant", "y."), (1, 1, "assistant", "y."), (1, 1, "user", "b."), (2, 5, None, None), (3, None, "user", "a."), (3, None, "assistant", "b.")]
    got = {r[0]: r for r in told(c.report(table(spark, rows)))}
    assert got[1][1:8] == (0, 0, 1, 0, 1, 4, "KKDD") and got[2][1:8] == (0, 1, 0, 0, 0, 2, "D")
    assert got[2][8] == hashlib.sha256(b"").hexdigest()
    assert got[3][1:8] == (0, 0, 0, 0, 0, 2, "RR")  # ties by role: the assistant first
    assert c.report(table(spark, [])).count() == 0 and c.repair(table(spark, [])).count() == 0


def test_products_are_associative():
    r = random.Random(2)
    for _ in range(30):
        codes = "".join(r.choice("suaSUA-+x") for _ in range(r.randint(0, 12)))
        k, m = sorted((r.randint(0, len(codes)), r.randint(0, len(codes))))
        parts = [c.segment_matrix(p) for p in (codes[:k], codes[k:m], codes[m:])]
        assert c.product(c.product(parts[0], parts[1]), parts[2]) == c.product(parts[0], c.product(parts[1], parts[2])) == c.segment_matrix(codes)
