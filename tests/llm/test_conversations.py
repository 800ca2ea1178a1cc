"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from maskloom.llm.conversations import damaged, repair, repaired

ALPHABET = "suaSUAxX-uaua"


def cheapest(codes):
    """Least (cost, letters), by trying edits in order of cost and letters."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, given = heapq.heappop(heap)
        if i == len(codes) and given in ("", "a"):
            return cost, letters
        if (i, given) in seen:
            continue
        seen.add((i, given))
        following = "a" if given == "u" else "u"
        heapq.heappush(heap, (cost + 3, letters + "I", i, following))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, given))
            more = 3 if c.isupper() else 0
            if c != "-":
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, following))
                if c.lower() == following or (c.lower() == "s" and given == ""):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, c.lower()))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 15, 16, 17, 33, 60])
def test_cheapest_edits(n):
    rng = random.Random(n)
    for _ in range(60):
        codes = "".join(rng.choice(ALPHABET) for _ in range(n))
        assert repair(codes) == cheapest(codes)


def test_long_conversation_in_linear_time():
    cost, letters = repair("ua" * 1500 + "u")
    assert (cost, len(letters)) == (3, 3002) and letters.startswith("K" * 3000)


def plain(rows):
    """The whole operator on (conv_id, turn, role, text) in plain Python."""
    space = " \t\n\v\f\r"
    groups = {}
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept.extend([(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    out = {}
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, codes, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in kept:
            said = text.strip(space)
            code = role[:1] if role[:1] and role[:1] in "sua" else "x"
            if not said:
                n["blank"] += 1
                codes += "-"
            elif (role, text) in seen:
                n["duplicate"] += 1
                codes += "-"
            elif said[-1] not in ".!?":
                n["truncated"] += 1
                codes += code.upper()
            else:
                codes += code
            seen.add((role, text))
        cost, letters = cheapest(codes)
        given, state, rest = [], "", iter(kept)
        for letter in letters:
            row = next(rest) if letter != "I" else None
            if letter == "K":
                state = row[1][:1]
                given.append(f"{row[1]}:{row[2]}")
            elif letter != "D":
                state = "a" if state == "u" else "u"
                given.append(("user:" if state == "u" else "assistant:") + (row[2] if row else ""))
        turns = {r[0] for r in kept} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *n.values(), illegal, cost, letters, hashlib.sha256("\n".join(given).encode()).hexdigest())
    return out


def stories(rng, n):
    texts = ["Yes.", "No", "Why?", "", " \n", "Été!  ", "ok.\nthen", "a\tb", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None, 40]), rng.choice(roles), rng.choice(texts)))
    rows += [(n + k, 0, "user", "Only.") for k in range(60)]  # some of them lose their one row
    rows += [(n + 99, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]
    return rows


def test_whole_operator(spark):
    rows = stories(random.Random(8), 120)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, copy string").repartition(5)
    found = {r.conv_id: tuple(r)[1:] for r in repaired(damaged(df)).collect()}
    want = plain(rows)
    assert found == want
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert empty in want.values() and None in want


def test_empty_table(spark):
    assert repaired(damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
