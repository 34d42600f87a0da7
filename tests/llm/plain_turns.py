"""Conversation repair stated plainly: explicit strings of edits, whole conversations in memory."""

import hashlib
import re
import zlib
from collections import defaultdict

INSERTS = {"": ("u", "U"), "s": ("u", "U"), "U": ("a", "A"), "A": ("u", "U")}
NEXT = {("", "s"): "s", ("", "u"): "U", ("s", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def cheapest(turns):
    """(cost, edits) for turns (initial, doomed, truncated): all ways by state, the least of (cost, edits) each."""
    ways = {"": (0, "")}

    def inserted(ways):
        while True:
            new = dict(ways)
            for state, (cost, edits) in ways.items():
                after = INSERTS[state][1]
                new[after] = min(new.get(after, (10**9, "")), (cost + 5, edits + "I"))
            if new == ways:
                return ways
            ways = new

    # two ways of one cost may be ordered by edits only where neither begins the other: keep all ways ahead of inserts
    for initial, doomed, truncated in turns:
        found = {}

        def offer(state, cost, edits):
            found[state] = min(found.get(state, (10**9, "")), (cost, edits))

        for start, (cost, edits) in ways.items():
            state, extra, ahead = start, 0, ""
            for _ in range(4):
                base = cost + extra
                offer(state, base + 2, edits + ahead + "D")
                if not doomed:
                    late = 5 if truncated else 0
                    if (state, initial) in NEXT:
                        offer(NEXT[state, initial], base + late, edits + ahead + "K")
                    offer(INSERTS[state][1], base + 1 + late, edits + ahead + "R")
                state, extra, ahead = INSERTS[state][1], extra + 5, ahead + "I"
        ways = found
    final = inserted(ways)
    return min(final[s] for s in ("", "A") if s in final)


def brute(turns):
    """The same by trying every string of edits with at most three inserted turns in a row."""
    best = None

    def walk(i, state, cost, edits, ahead):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(turns):
            if state in ("", "A"):
                best = min(best or (10**9, ""), (cost, edits))
        else:
            initial, doomed, truncated = turns[i]
            walk(i + 1, state, cost + 2, edits + "D", 0)
            if not doomed:
                late = 5 if truncated else 0
                if (state, initial) in NEXT:
                    walk(i + 1, NEXT[state, initial], cost + late, edits + "K", 0)
                walk(i + 1, INSERTS[state][1], cost + 1 + late, edits + "R", 0)
        if ahead < 3:
            walk(i, INSERTS[state][1], cost + 5, edits + "I", ahead + 1)

    walk(0, "", 0, "", 0)
    return best


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def said(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def report(rows, conversations):
    """rows: (conv, turn, role, text) after damage."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        groups[conv].append((turn is not None, turn or 0, role.encode(), said(role, text), turn, role, text))
    out = []
    for conv in conversations:
        own = sorted(groups[conv])
        numbers = [r[4] for r in own if r[4] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, turns, faults = set(), [], [0, 0, 0]
        for *_, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            blank = not body
            double = not blank and (role, text) in seen
            cut = not blank and not double and body[-1] not in ".!?"
            seen.add((role, text))
            for i, x in enumerate((blank, double, cut)):
                faults[i] += x
            turns.append((role[:1], blank or double, cut))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, edits = cheapest(turns)
        lines, state, left = [], "", iter(own)
        for letter in edits:
            if letter == "I":
                role, state = INSERTS[state]
                lines.append({"u": "user", "a": "assistant"}[role] + ":")
                continue
            *_, role, text = next(left)
            if letter == "K":
                state = NEXT[state, role[:1]]
                lines.append(f"{role}:{text}")
            elif letter == "R":
                initial, state = INSERTS[state]
                lines.append({"u": "user", "a": "assistant"}[initial] + ":" + text)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *faults, illegal, cost, edits, sha))
    return out
