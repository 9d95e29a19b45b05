"""Viterbi over edits of one sequence of turns, with survivors that coalesce.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its automaton has
four states: nothing yet, after the system turn, after a user turn, after an
assistant turn; it accepts in the first and the last. In every state just one of
user and assistant may follow, so the letters of the edits tell the roles.

The cheapest path to each state survives a turn; of equal cost, the one whose
letters are ASCII-least, told by comparing the two paths' whole unresolved
letters. Paths are nodes with back pointers, each holding a run of one letter
and the number of its children and survivors. A node that loses its last
reference goes, and its parent loses one. Once the oldest node has a single
child, every survivor shares that child: its edits are settled and handed out.

Two states need not survive once they cost too much: whatever follows a system
turn may also follow an assistant turn, and what may follow nothing may follow
an assistant turn if a kept system turn is deleted for 2 instead.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: After each state: the state that a user or assistant turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: Kept turns: the state that an initial leads to from each state.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {USER: "user", ASSISTANT: "assistant"}


class _Node:
    """A run of ``count`` equal letters after those of ``parent``."""

    __slots__ = ("parent", "letter", "count", "refs")

    def __init__(self, parent: _Node | None, letter: str, count: int = 1):
        self.parent, self.letter, self.count, self.refs = parent, letter, count, 0
        if parent is not None:
            parent.refs += 1


def _release(node: _Node | None) -> None:
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


def _runs(node: _Node, letters: str) -> list[list]:
    """The letters after the root up to ``node`` and then ``letters``, as runs."""
    up = []
    while node.parent is not None:
        up.append([node.letter, node.count])
        node = node.parent
    out: list[list] = []
    for letter, count in [*reversed(up), *([c, 1] for c in letters)]:
        if out and out[-1][0] == letter:
            out[-1][1] += count
        else:
            out.append([letter, count])
    return out


def _less(a: tuple[_Node, str], b: tuple[_Node, str]) -> bool:
    """Whether the letters of path ``a`` are ASCII-less than those of ``b``."""
    x, y = _runs(*a), _runs(*b)
    i = 0
    while i < len(x) and i < len(y):
        (c, n), (d, m) = x[i], y[i]
        if c != d:
            return c < d
        if n != m:  # the shorter run is followed by another letter, or ends
            short, longer = (x, c) if n < m else (y, c)
            after = short[i + 1][0] if i + 1 < len(short) else ""
            return (after < longer) == (short is x)
        i += 1
    return len(x) < len(y)


class Repair:
    """Edits of one conversation: ``add`` turns in order, then ``finish``.

    Both give settled edits (letter, role, payload): role is the repaired one
    (None where the turn goes), payload what ``add`` was given (None for inserts).
    """

    def __init__(self) -> None:
        self.root = _Node(None, "")
        self.heads: dict[int, tuple[int, _Node]] = {NOTHING: (0, self.root)}
        self.root.refs = 1
        self.rows: deque = deque()
        self.state = NOTHING  # after the last edit handed out
        self.cost: int | None = None
        self.most_held = 0
        self._step({NOTHING: (0, self.root, "")})

    def add(self, initial: str, forced: bool, truncated: bool, role: str, payload) -> Iterator[tuple]:
        """``forced``: the turn has to go. ``truncated``: unless it goes, it costs more."""
        self.rows.append((initial, role, payload))
        self.most_held = max(self.most_held, len(self.rows))
        found: dict[int, tuple[int, _Node, str]] = {}
        for state, (cost, node) in self.heads.items():
            self._offer(found, state, cost + DELETE_COST, node, DELETE)
            if forced:
                continue
            stays = cost + TRUNCATED_COST * truncated
            kept = KEPT[state].get(initial)
            if kept is not None:
                self._offer(found, kept, stays, node, KEEP)
            if kept != NEXT[state]:
                self._offer(found, NEXT[state], stays + REROLE_COST, node, REROLE)
        self._step(found)
        return self._settled()

    def finish(self) -> Iterator[tuple]:
        ends = {q: (*self.heads[q], "") for q in (NOTHING, ASSISTANT) if q in self.heads}
        best: dict[int, tuple[int, _Node, str]] = {}
        for cost, node, _ in ends.values():
            self._offer(best, ASSISTANT, cost, node, "")
        self.cost, last, _ = best[ASSISTANT]
        for q in [q for q, (_, node) in self.heads.items() if node is not last]:
            _release(self.heads.pop(q)[1])
        return self._settled(last)

    @staticmethod
    def _offer(found: dict, state: int, cost: int, node: _Node, letters: str) -> bool:
        have = found.get(state)
        if have is not None and (cost > have[0] or (cost == have[0] and not _less((node, letters), have[1:]))):
            return False
        found[state] = (cost, node, letters)
        return True

    def _step(self, found: dict[int, tuple[int, _Node, str]]) -> None:
        """Insert turns where that is cheaper, prune, and make the survivors' nodes."""
        changed = True
        while changed:
            changed = False
            for q in (NOTHING, SYSTEM, USER, ASSISTANT):
                if q in found:
                    cost, node, letters = found[q]
                    changed |= self._offer(found, NEXT[q], cost + INSERT_COST, node, letters + INSERT)
        cost = found[ASSISTANT][0]
        if NOTHING in found and found[NOTHING][0] > cost + DELETE_COST:
            del found[NOTHING]
        if SYSTEM in found and found[SYSTEM][0] > cost:
            del found[SYSTEM]
        users: dict[int, list[int]] = {}
        for q, (_, node, _) in found.items():
            users.setdefault(id(node), []).append(q)
            node.refs += 1
        for _, node in self.heads.values():
            _release(node)
        self.heads, grown, made = {}, set(), {}
        for states in users.values():
            node = found[states[0]][1]
            firsts = {found[q][2][:1] for q in states}
            if node.parent is not None and node.refs == len(states) and firsts == {node.letter}:
                node.count += 1  # nothing else holds it, and all go on with its own letter
                grown.add(id(node))
        for q, (cost, node, letters) in found.items():
            for c in letters[1:] if id(node) in grown else letters:
                if (id(node), c) not in made:
                    made[id(node), c] = _Node(node, c)
                node = made[id(node), c]
            node.refs += 1
            self.heads[q] = (cost, node)
        for _, node, _ in found.values():
            node.refs -= 1

    def _settled(self, last: _Node | None = None) -> Iterator[tuple]:
        """Hand out the runs that all survivors share, or all up to ``last``."""
        if last is None and self.root.refs > 1:
            return
        node = last or next(iter(self.heads.values()))[1]
        chain = []
        while node is not self.root:
            chain.append(node)
            node = node.parent
        while chain and self.root.refs == 1:
            node = chain.pop()
            for _ in range(node.count):
                yield self._edit(node.letter)
            node.parent, self.root = None, node

    def _edit(self, letter: str) -> tuple:
        if letter == INSERT:
            self.state = NEXT[self.state]
            return letter, ROLE[self.state], None
        initial, role, payload = self.rows.popleft()
        if letter == DELETE:
            return letter, None, payload
        if letter == KEEP:
            self.state = KEPT[self.state][initial]
            return letter, role, payload
        self.state = NEXT[self.state]
        return letter, ROLE[self.state], payload
