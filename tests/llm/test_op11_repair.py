"""Edits against an enumeration of all, digests against a plain recomputation."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from claimhound.llm import turn_repair as t
from claimhound.llm.survivors import NOTHING, Repair
from claimhound.llm.turn_repair import op11_survivors, repair_edits, repaired

GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """Least (cost, letters) over edits, by best-first search. turns: (initial, forced, truncated)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, roles = heapq.heappop(heap)
        state = (i, roles[-1:], letters)
        if state in seen:
            continue
        seen.add(state)
        if i == len(turns) and GOOD.fullmatch(roles):
            return cost, letters, roles

        def go(more, letter, j, role):
            new = roles + role
            if GOOD.fullmatch(new) or GOOD.fullmatch(new + "a") or GOOD.fullmatch(new + "ua"):
                heapq.heappush(heap, (cost + more, letters + letter, j, new))

        for role in "ua":
            go(5, "I", i, role)
        if i < len(turns):
            initial, forced, truncated = turns[i]
            go(2, "D", i + 1, "")
            if not forced:
                go(5 * truncated, "K", i + 1, initial or "?")
                for role in "ua":
                    go(1 + 5 * truncated, "R", i + 1, role)


def streamed(turns):
    repair, out = Repair(), []
    for i, (initial, forced, truncated) in enumerate(turns):
        out += repair.add(initial, forced, truncated, f"{initial}x", i)
    out += repair.finish()
    return repair, out


@pytest.mark.parametrize("seed", range(6))
def test_edits_are_the_least_of_all(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n = rng.randrange(9)
        turns = [
            (rng.choice(["s", "u", "a", "u", "a", " ", "t", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)
        ]
        turns = [(x, f, tr and not f) for x, f, tr in turns]
        cost, letters, roles = cheapest(turns)
        repair, out = streamed(turns)
        assert (repair.cost, "".join(e[0] for e in out)) == (cost, letters), turns
        assert "".join(e[1][0] for e in out if e[1]) == roles
        assert [e[2] for e in out if e[0] != "I"] == list(range(n))


def plain_dp(turns):
    """The same by a table that keeps whole letters, for sequences too long to enumerate."""
    nxt, kept = "uuau", [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    to = {"u": 2, "a": 3}
    best = {0: (0, "")}

    def inserts(best):
        for _ in range(4):
            for q, (c, w) in list(best.items()):
                best[to[nxt[q]]] = min(best.get(to[nxt[q]], (c + 6, "")), (c + 5, w + "I"))
        return best

    best = inserts(best)
    for initial, forced, truncated in turns:
        new = {}
        for q, (c, w) in best.items():
            new[q] = min(new.get(q, (c + 99, "")), (c + 2, w + "D"))
            if not forced:
                if initial in kept[q]:
                    k = kept[q][initial]
                    new[k] = min(new.get(k, (c + 99, "")), (c + 5 * truncated, w + "K"))
                r = to[nxt[q]]
                new[r] = min(new.get(r, (c + 99, "")), (c + 1 + 5 * truncated, w + "R"))
        best = inserts(new)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("kinds", ["sua", "u", "a", " ", "ua ", "u u", "sss"])
def test_long_conversations(kinds):
    rng = random.Random(len(kinds))
    turns = [(rng.choice(kinds), rng.random() < 0.1, False) for _ in range(400)]
    repair, out = streamed(turns)
    assert (repair.cost, "".join(e[0] for e in out)) == plain_dp(turns)


def test_memory_is_that_of_the_unresolved_turns():
    rng = random.Random(1)
    turns = [("ua"[i % 2] if rng.random() < 0.9 else rng.choice("us "), rng.random() < 0.1, rng.random() < 0.1) for i in range(20_000)]
    repair, out = streamed([(x, f, tr and not f) for x, f, tr in turns])
    assert repair.most_held < 60 and len(out) >= 20_000
    for before in ([], [("u", False, False)]):
        nodes, repair, out = 0, Repair(), []
        for i, turn in enumerate([*before, *[(" ", True, False)] * 5000]):
            out += repair.add(*turn, " ", i)
            for _, node in repair.heads.values():  # deletions that survivors share are runs
                n = 0
                while node is not None:
                    n, node = n + 1, node.parent
                nodes = max(nodes, n)
        assert nodes <= 5
        out += repair.finish()
        assert "".join(e[0] for e in out) == "D" * (5000 + len(before)) and repair.cost == len(out) * 2
    assert NOTHING in repair.heads


def solid(text):
    return re.sub(r"[\x20\x09-\x0D]+\Z", "", text)


def plain_digest(rows):
    """conv_id to its digest row. rows: (conv_id, turn, role, text)."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        conv_rows = by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        conv_rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, counts, seq = set(), Counter(), []
        for _, role, text in turns:
            s = solid(text)
            fault = "blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            seq.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        known = [x[0] for x in turns if x[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(seq, seq[1:]))
        if len(seq) <= 8:
            cost, letters, _ = cheapest(seq)
        else:
            cost, letters = plain_dp(seq)
        lines, i, last = [], 0, ""
        for c in letters:
            row = None
            if c != "I":
                row, i = turns[i], i + 1
            if c != "D":
                role = row[1] if c == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{row[2] if row else ''}")
                last = role[:1]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, digest)
    return out


def digests(df):
    names = [c.split()[0] for c in t.DIGESTS.split(",")]
    rows = df.select(names).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_query_equals_plain_digests(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digests(op11_survivors(spark, sf_dir)) == plain_digest(rows)


def test_odd_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \t\x0b", "Yes.", "No", "Why?  \n", "\xa0", "é!", "a" * 30_000, "Yes."]
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "User"]
    rows = [(c, None if rng.random() < 0.05 else rng.randrange(12), rng.choice(roles), rng.choice(texts)) for c in [*range(150), None] for _ in range(rng.randrange(1, 12))]
    rows += [(999, i, "ua"[i % 2] == "u" and "user" or "assistant", f"Turn {i}.") for i in range(3000)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, fault int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(t, "ROWS_A_BATCH", 7)
    assert digests(op11_survivors(spark, str(tmp_path))) == plain_digest(rows)
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert op11_survivors(spark, str(tmp_path / "none")).count() == 0


def test_repaired_conversations_are_whole(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "So."), (3, 5, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = sorted(tuple(r) for r in repaired(df).collect())
    assert found == [(1, 0, "user", "There?"), (1, 1, "assistant", "Yes.")]  # DKK comes before KDK
    edits = {}
    for r in sorted(repair_edits(df).collect(), key=lambda r: (r.conv_id, r.step)):
        edits.setdefault(r.conv_id, []).append(r.edit)
    assert {k: "".join(v) for k, v in edits.items()} == {1: "DKK", 2: "D", 3: "D"}
