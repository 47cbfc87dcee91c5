import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korpora.llm import conversation_repair as C

FIT = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """Least cost, then least audit, by searching edits in that order: turns are None (must go) or (initial, truncated). Gives the roles of what stays too."""
    queue, done = [(0, "", 0, "")], set()
    most = 2 * len(turns) + 2
    while queue:
        cost, audit, at, roles = heapq.heappop(queue)
        if at == len(turns) and FIT.fullmatch(roles):
            return cost, audit
        state = (at, roles[-1:] or "-", "s" in roles, len(roles) > 1)
        if (cost, audit, state) in done or len(roles) > most or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        done.add((cost, audit, state))
        for r in "ua":
            heapq.heappush(queue, (cost + 5, audit + "I", at, roles + r))
        if at < len(turns):
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, roles))
            if turns[at] is not None:
                initial, cut = turns[at]
                heapq.heappush(queue, (cost + 5 * cut, audit + "K", at + 1, roles + initial if initial else roles + "?"))
                for r in "ua":
                    heapq.heappush(queue, (cost + 1 + 5 * cut, audit + "R", at + 1, roles + r))
    raise AssertionError


def brute(rows, damage=True):
    convs = defaultdict(list)
    for r in rows:
        role, text = (" " if x is None else x for x in (r.role, r.text))
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        k = zlib.crc32(key.encode()) % 20 if damage else 19
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[r.conv_id] += [(r.turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(C.SPACES)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = cheapest([None if f in (1, 2) else (o[1][:1], f == 3) for o, f in zip(own, faults, strict=True)])
        lines, i = [], 0
        for a in audit:
            expected = "user" if not lines or lines[-1][:1] in "sa" else "assistant"
            if a == "I":
                lines.append(f"{expected}:")
            else:
                _, role, text = own[i]
                i += 1
                if a != "D":
                    lines.append(f"{role if a == 'K' else expected}:{text}")
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def same(df, damage=True):
    got = C.figures(C.repaired(C.damaged(df) if damage else C.sound(df)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(df.collect(), damage)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")


def test_as_brute_force(talks, spark):
    same(talks)
    same(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").filter("conv_id % 3 = 0"))
    same(talks, damage=False)
    assert C.repaired(C.damaged(talks.limit(0))).count() == 0


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "a."), (None, None, None, None), (None, 1, "assistant", "b!"), (1, None, "user", "x."), (1, None, "user", "x."), (1, 2, "", "y."), (2, 5, "assistant", " \t\n"), (2, 5, "assistant", "b"), (2, 9, "user", "b?\x0b\n"),
        (3, 0, "system", "s."), (4, 0, "system", "s."), (4, 1, "System", "s."), (4, 2, "user", "é…"), (5, 1, "user", "same."), (5, 1, "assistant", "same."), (5, 1, "user", "other."), (6, -3, "assistant", "a" * 100_000), (6, 2**40, "user", "b."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS fault", "2 AS copies", "'x' AS audit")
    same(df)
    same(df, damage=False)


def test_long_conversations_come_in_pieces(spark):
    """One conversation holds most rows, with turns without number and equal rows by the hundred; it is cut wherever a partition ends."""
    talk = spark.range(3000).selectExpr("if(id % 7 < 5, 1L, id) AS conv_id", "if(id % 11 = 0, NULL, id) AS turn", "element_at(array('user', 'assistant', 'system', 'user', 'tool'), int(hash(id) % 5 + 5) % 5 + 1) AS role", "if(id % 5 = 0, 'the same.', concat('text ', id % 400, if(id % 3 = 0, '', '.'))) AS text").repartition(6)
    got = C.figures(C.repaired(C.damaged(talk)))
    few = [r for r in talk.collect() if r.conv_id != 1]
    assert sorted((tuple(r) for r in got.collect() if r.conv_id != 1), key=str) == brute(few)
    hot = [r for r in talk.collect() if r.conv_id == 1]
    parts = C.repaired(C.damaged(talk)).filter("conv_id = 1").orderBy("block").collect()
    assert len(parts) > 2
    rows = damaged_rows(hot)
    out = []
    C.whole(out, 1, rows)
    want = out[0]
    assert "\n".join(p.repaired for p in parts if p.repaired) == want["repaired"]
    assert {k: parts[-1][k] for k in (*C.FIGURES, "audit", "repaired_sha256")} == {k: want[k] for k in (*C.FIGURES, "audit", "repaired_sha256")}


def damaged_rows(rows):
    out = []
    for r in rows:
        k = zlib.crc32(f"{r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", r.text) if k == 2 else r.text
        bare = text.rstrip(C.SPACES)
        out += [(r.turn, "user" if k == 4 else r.role, text, 1 if not bare else 0 if bare[-1] in ".!?" else 3)] * {0: 0, 3: 2}.get(k, 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


turn = st.one_of(st.none(), st.tuples(st.sampled_from("suax"), st.booleans()))


@settings(max_examples=400, deadline=None)
@given(st.lists(turn, max_size=7))
def test_layers_give_the_cheapest_audit(turns):
    cost, audit = cheapest(turns)
    assert C.to_costs(*C.layers(turns, C.ACCEPTED)[0])[C.START] == cost
    assert C.traced(turns, C.ACCEPTED, C.START, True)[0] == audit


@settings(max_examples=200, deadline=None)
@given(st.lists(turn, max_size=40), st.lists(st.integers(0, 40), max_size=4))
def test_pieces_give_the_audit_of_the_whole(turns, cuts):
    cuts = sorted({0, len(turns), *[c for c in cuts if c < len(turns)]})
    pieces = [turns[a:b] for a, b in zip(cuts, cuts[1:])] or [[]]
    ends = [C.ACCEPTED]
    for p in reversed(pieces[1:]):
        to = [C.to_costs(*C.layers(p, [0 if s == e else C.FAR for s in range(4)])[0]) for e in range(4)]
        ends.append([min(to[e][s] + ends[-1][e] for e in range(4)) for s in range(4)])
    audit, state = "", C.START
    for p, end in zip(pieces, reversed(ends), strict=True):
        part, state = C.traced(p, end, state, end is C.ACCEPTED)
        audit += part
    assert audit == C.traced(turns, C.ACCEPTED, C.START, True)[0]
