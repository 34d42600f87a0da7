"""Cheapest edits of a sequence of turns, found from left to right.

A state is the last role kept so far. For each state the cheapest way of reaching it
survives; among equally cheap ways the one whose edits come first in ASCII order. The ways are
leaves of a tree of back pointers. A node counts the nodes and survivors that stand on it
and goes when none does; what all survivors have in common is handed out and forgotten, so
only the unresolved ends are kept. Ends are compared as wholes: two ways of reaching different
states differ at some edit, and the order of their complete unresolved ends is carried as a
rank, so the order of two longer ends is that of the ends they grew from, or of their last
edits if they grew from the same one. Inserted turns go with the edit of the turn that
follows, so all ends of a moment cover the same turns and none begins another.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
KEEP_LETTER, REROLE_LETTER, DELETE_LETTER, INSERT_LETTER = "K", "R", "D", "I"
#: What may follow a state: role initial -> state. A sequence ends in START or ASSISTANT.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
INSERTED = {"u": "user", "a": "assistant"}


@cache
def steps(initial: str, doomed: bool, truncated: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, edits) of one turn, with any turns inserted ahead of it.

    ``doomed`` turns must be deleted. Inserting round a full circle is never cheapest.
    """
    out = []
    for before in range(STATES):
        state, ahead = before, 0
        for _ in range(STATES):
            letters, cost = INSERT_LETTER * ahead, INSERT * ahead
            out.append((before, state, cost + DELETE, letters + DELETE_LETTER))
            if not doomed:
                extra = TRUNCATED if truncated else 0
                for role, after in FOLLOWS[state].items():
                    if role == initial:
                        out.append((before, after, cost + extra, letters + KEEP_LETTER))
                    if role in INSERTED:
                        out.append((before, after, cost + REROLE + extra, letters + REROLE_LETTER))
            state, ahead = next(s for r, s in FOLLOWS[state].items() if r in INSERTED), ahead + 1
    best: dict[tuple[int, int, str], int] = {}
    for before, after, cost, letters in out:
        key = before, after, letters
        best[key] = min(best.get(key, cost), cost)
    return tuple((b, a, c, l) for (b, a, l), c in sorted(best.items(), key=str))


@cache
def endings() -> dict[int, tuple[int, str]]:
    """State -> (cost, edits) of the turns inserted after the last one."""
    out = {}
    for before in range(STATES):
        state, ahead = before, 0
        while state not in FINAL:
            state, ahead = next(s for r, s in FOLLOWS[state].items() if r in INSERTED), ahead + 1
        out[before] = INSERT * ahead, INSERT_LETTER * ahead
    return out


class Node:
    __slots__ = ("back", "edits", "ends")

    def __init__(self, back: Node | None, edits):
        self.back, self.edits, self.ends = back, edits, set()


class Survivors:
    """The survivors of one sequence that begins in ``state``; ``done`` holds what is certain of the edits."""

    def __init__(self, state: int = START):
        self.root = Node(None, None)
        self.cost = {state: 0}
        self.rank = {state: 0}
        self.node = {state: self.root}
        self.done: list = []

    def extend(self, ways: Iterable[tuple[int, int, int, object, object]]) -> None:
        """One step. ``ways``: (state before, state after, cost, edits, order of the edits among ways from the same state)."""
        best: dict[int, tuple] = {}
        for before, after, cost, edits, order in ways:
            if before in self.cost:
                way = self.cost[before] + cost, self.rank[before], order, before, edits
                if after not in best or way[:3] < best[after][:3]:
                    best[after] = way
        old, self.node = self.node, {}
        for state, (_, _, _, before, edits) in best.items():
            node = Node(old[before], edits)
            old[before].ends.add(node)
            self.node[state] = node
        for node in old.values():
            self._forget(node)
        self.cost = {state: way[0] for state, way in best.items()}
        order = sorted(best, key=lambda state: best[state][1:3])
        self.rank = {state: place for place, state in enumerate(order)}
        self._resolve()

    def turn(self, initial: str, doomed: bool, truncated: bool) -> None:
        self.extend((b, a, c, edits, edits) for b, a, c, edits in steps(initial, doomed, truncated))

    def _forget(self, node: Node) -> None:
        while not node.ends and node.back is not None:
            back, node.back = node.back, None
            back.ends.discard(node)
            node = back

    def _resolve(self) -> None:
        held = set(self.node.values())
        while len(self.root.ends) == 1 and self.root not in held:
            (self.root,) = self.root.ends
            self.root.back = None
            self.done.append(self.root.edits)

    def edits_to(self, state: int) -> list:
        """The edits not handed out yet, up to a survivor."""
        out, node = [], self.node[state]
        while node is not self.root:
            out.append(node.edits)
            node = node.back
        return out[::-1]

    def finish(self) -> tuple[int, list, str]:
        """(cost, all edits not taken yet, turns inserted in the end) of the best sequence."""
        def whole(state: int):
            cost, letters = endings()[state]
            return self.cost[state] + cost, self.rank[state], letters

        best = min(self.cost, key=whole)
        cost, _, letters = whole(best)
        return cost, self.done + self.edits_to(best), letters
