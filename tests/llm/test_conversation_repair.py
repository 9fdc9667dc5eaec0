import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fleetkit.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, pid int, audit string, copy string"
PATTERN = re.compile(r"(s?(ua)+)?")
ZERO = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def cheapest(signs):
    """Dijkstra by (cost, audit) over (row, state); states as regular-expression prefixes."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(signs) and state in ("", "a"):
            return cost, audit
        for initial in "ua":
            if initial in nexts[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, initial))
        if i < len(signs):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if signs[i] != "d":
                extra = 5 if signs[i].isupper() else 0
                for initial in "ua":
                    if initial in nexts[state]:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, initial))
                if signs[i].lower() in nexts[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, signs[i].lower()))
    raise AssertionError


def brute(rows):
    """conv_id -> result, the contract read row by row (rows of one turn are equal or differ in the role)."""
    out, convs = {}, {}
    nothing = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, [])
        kind = zlib.crc32(f"{nothing(conv)}:{nothing(turn)}".encode()) % 20
        role, text = nothing(role), nothing(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [] if kind == 0 else [(turn, role, text)] * (1 + (kind == 3))
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        if not found:
            out[conv] = ZERO
            continue
        faults, signs, seen = [0, 0, 0], "", set()
        for _, role, text in found:
            words = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            if not words:
                faults[0] += 1
                signs += "d"
            elif (role, text) in seen:
                faults[1] += 1
                signs += "d"
            else:
                bad = words[-1] not in ".!?"
                faults[2] += bad
                letter = role[0] if role[:1] in ("s", "u", "a") else "x"
                signs += letter.upper() if bad else letter
            seen.add((role, text))
        turns = {t for t, *_ in found if t is not None}
        initials = [r[:1] for _, r, _ in found]
        cost, audit = cheapest(signs)
        kept, k = [], 0
        for letter in audit:
            want = {"": "user", "s": "user", "u": "assistant", "a": "user"}[kept[-1][:1] if kept else ""]
            if letter == "I":
                kept.append(want + ":")
                continue
            if letter != "D":
                kept.append(f"{want if letter == 'R' else found[k][1]}:{found[k][2]}")
            k += 1
        assert PATTERN.fullmatch("".join(x[0] for x in kept))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults,
                     sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_search_against_dijkstra():
    rng = random.Random(1)
    for _ in range(1500):
        signs = "".join(rng.choices("uasxdUASX", [6, 6, 1, 1, 1, 1, 1, .3, .3], k=rng.randrange(0, 14)))
        want = cheapest(signs)
        assert C.search(signs) == want, signs
        state, audit = C.followed(signs, C.START, C.END)
        assert (C.to_come(signs, C.END)[0][C.START], audit + C.CLOSING[state]) == want, signs
        assert C.bounds(signs)[0] <= want[0]
    for n in (130, 400):
        signs = "".join(rng.choices("uadUA", [6, 6, 1, 1, 1], k=n))
        assert C.repair(signs) == cheapest(signs)
        assert C.search(signs[:128]) == cheapest(signs[:128])


def test_search_is_admissible_for_many_bad_pairs():
    for signs in ("u" * 20, "a" * 15, "uuaauuaa", "sss", "s", "x" * 9, "aUuAa", "uaS", "sd", "UUUU"):
        assert C.search(signs) == cheapest(signs)


def conversations(rng, n):
    texts = ["Yes.", "no", "What?", " ", "", "Go!\n", None, "cut off", "End.\u0085", "x. ", "é "]
    rows = []
    for conv in [None, *range(n)]:
        for k in range(rng.randrange(1, 9)):
            turn = rng.choice([k, k, k, k + rng.randrange(0, 3), None])
            role = rng.choice(["user", "assistant"]) if rng.random() < .4 else ["user", "assistant"][k % 2]
            role = rng.choice([None, "system", "tool", "", "Sys"]) if rng.random() < .1 else role
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < .3 else f"{k} text {rng.random()}.", 7, "x", "y"))
    return rows


def test_random_conversations_and_edges(spark):
    rows = conversations(random.Random(2), 300)
    rows += rows[::17] + [(900, t, "user", "a.", 1, "", "") for t in range(30)] + [(901, None, None, None, 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert as_dict(C.repaired(C.damaged(df))) == want
    assert any(v == ZERO for v in want.values())
    assert C.repaired(C.damaged(df.limit(0))).count() == 0


@pytest.mark.parametrize("rows_kept", [C.KEEP_ROWS, 5])
def test_hot_conversation_over_many_tasks(spark, rows_kept):
    rng = random.Random(3)
    roles = ["user", "assistant"]
    rows = [(5, t, roles[t % 2] if rng.random() < .9 else rng.choice(["system", "user"]),
             rng.choice(["Same.", f"{t}.", f"{t}.", f"{t}.", "cut"]), 1, "", "") for t in range(3000)]
    rows += conversations(rng, 60) + [(5, None, "system", "Hot.", 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_dict(C.repaired(C.damaged(df), rows_kept)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_tables(spark):
    path = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C.op12_conversation_repair(spark, path)
    assert as_dict(got) == brute(given)
    assert got.where(F.col("audit").rlike("[^DIKR]")).count() == 0
