"""Repair of conversations against plain dynamic programming over strings."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from findrift.llm import repair as R

LEGAL = re.compile(r"(s?(ua)+)?")


def plain(kinds, start=0):
    """Cost and audit to each state, comparing whole strings."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def put(d, s, x):
        if s not in d or x < d[s]:
            d[s] = x

    def inserted(d):
        for _ in range(3):
            for s, (c, a) in list(d.items()):
                put(d, after[s], (c + 5, a + "I"))
        return d

    now = inserted({start: (0, "")})
    for k in kinds:
        then, extra = {}, 5 if k.isupper() else 0
        for s, (c, a) in now.items():
            put(then, s, (c + 2, a + "D"))
            if k != "x":
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(k.lower(), {}).get(s)
                if to is not None:
                    put(then, to, (c + extra, a + "K"))
                put(then, after[s], (c + 1 + extra, a + "R"))
        now = inserted(then)
    return [now.get(s) for s in range(4)]


def brute(rows, damaged=True):
    """The contract read row by row."""
    ids, convs = [], {}
    for conv, turn, role, text in rows:
        if conv not in ids:
            ids.append(conv)
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if k == 0:
            continue
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        convs.setdefault(conv, []).extend([(turn, role, text)] * (2 if k == 3 else 1))
    out = []
    for conv in ids if damaged else convs:
        rs = convs.get(conv, [])
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        n, seen, kinds = [0, 0, 0], set(), ""
        for _, role, text in rs:
            full = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            i = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not re.search(r"[^\x20\x09-\x0D]", text):
                n[0] += 1
                kinds += "x"
            elif (role, text) in seen:
                n[1] += 1
                kinds += "x"
            elif full[-1] not in ".!?":
                n[2] += 1
                kinds += i.upper()
            else:
                kinds += i
            if kinds[-1] != "x":
                seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        turns = [r[0] for r in rs if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        ends = plain(kinds)
        cost, audit = min(ends[s] for s in (0, 3) if ends[s])
        lines = "\n".join(R.rendered(audit, [r[1] for r in rs], [r[2] for r in rs]))
        assert LEGAL.fullmatch("".join(line[0] for line in lines.split("\n") if line)) or "\n" in "".join(r[2] for r in rs)
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, str(r[0]), r[1:])


@pytest.mark.parametrize("mod", [R.MOD, 5])
def test_edits_against_strings(mod):
    """With a modulus of 5 nearly all hashes collide."""
    for n in range(4):
        for kinds in product("xsuaoUA", repeat=n):
            for start in range(4):
                assert R.best_edits("".join(kinds), start, mod) == plain("".join(kinds), start)
    rng = random.Random(mod)
    for _ in range(150):
        kinds = "".join(rng.choices("xsuaoSUAO", k=rng.randrange(60)))
        start = rng.randrange(4)
        assert R.best_edits(kinds, start, mod) == plain(kinds, start)


def test_longest_common_prefix():
    rng, edits = random.Random(3), R.Edits(11)
    nodes = [0]
    for _ in range(600):
        nodes.append(edits.add(rng.choice(nodes[-40:]), rng.choice("DIKR")))
    for _ in range(4000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert edits.less(a, b) == (edits.spelled(a) < edits.spelled(b))


def rows_of(seed, convs=60):
    rng = random.Random(seed)
    texts = ["Hi.", "What?", "no end", " \t", "", None, "Yes! \n", "é.", "Hi", ".", "line\nbreak."]
    out = []
    for c in range(convs):
        for t in range(rng.randrange(1, 14)):
            if rng.random() < 0.9:
                turn = None if rng.random() < 0.03 else t
                out.append((c if c else None, turn, rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(texts)))
    for t in range(900):  # one conversation that holds a third of all rows, and many copies of a row
        out.append((7, t, "user" if t % 2 else "assistant", f"Text {t % 300}." if t % 7 else "cut"))
    out += [(7, 5, "user", "Again and again.")] * 300
    rng.shuffle(out)
    return out


SCHEMA = "conv_id bigint, turn int, role string, text string"


@pytest.mark.parametrize("piece", [R.PIECE_ROWS, 50])
@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, piece):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "'x' as conv", "2 as m", "3 as fault").repartition(6)
    got = sorted((tuple(r) for r in R.audit_damaged(df, piece).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    got = sorted((tuple(r) for r in R.repair(df, piece).collect()), key=key)
    assert got == sorted(brute(rows, damaged=False), key=key)


def test_supplied_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    got = sorted((tuple(r) for r in R.audit_damaged(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.repair(none).count() == 0 and R.audit_damaged(none).count() == 0
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", 1, "assistant", "x" * 100_000)]
    got = {r.conv_id: r for r in R.repair(spark.createDataFrame(rows, SCHEMA.replace("bigint", "string"))).collect()}
    assert (got["a"].audit, got["a"].cost, got["b"].audit, got["b"].truncated) == ("KK", 0, "D", 1)
