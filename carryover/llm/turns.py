"""The cheapest repair of one conversation's sequence of turns.

A turn is a symbol: the initial of its role (s, u, a or another) and its fault.  Edits
keep, rerole or delete a turn or insert an empty one, and the roles that are left must
read ``(s?(ua)+)?``.  That language has four states, so a turn is a 4 x 4 matrix of
least costs (from state, to state) and a sequence of turns is the min-plus product of
its matrices.  Equal consecutive symbols are one run; a run of n turns is advanced with
the powers of its matrix for the binary digits of n, which are computed once a process.
The choices are then unrolled from the front, halving blocks of two to the k turns; a
block met before from the same state with the same costs behind it is not unrolled
again.  Of equally cheap audits the least in ASCII order is taken.
"""

from __future__ import annotations

from functools import cache
from itertools import groupby

#: Initials with a meaning of their own, in the order of their symbols; any other is the last.
INITIALS = "sua"
#: Faults of a turn, first one counts; the first two must be deleted.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Pairs of adjacent initials that are legal.
LEGAL = {(0, 1), (1, 2), (2, 1)}

NEVER = 1 << 60
STATES = range(4)
#: Nothing yet, after the system turn, after a user turn, after an assistant turn; the first and last may end.
START, SYSTEM, USER, ASSISTANT = STATES
#: The state after an inserted or reroled turn: user and assistant alternate.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after keeping each initial; absent where that is not allowed.
AFTER = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def symbol(role: str, fault: int) -> int:
    """One byte for a turn: four times the class of its role's initial, and its fault."""
    at = INITIALS.find(role[:1]) if role else -1
    return 4 * (len(INITIALS) if at < 0 else at) + fault


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(row[k] + b[k][j] for k in STATES) for j in STATES) for row in a)


def before(a: Matrix, costs: Vector) -> Vector:
    """Least costs in front of ``a``, given the least costs behind it."""
    return tuple(min(row[k] + costs[k] for k in STATES) for row in a)


def _inserts() -> Matrix:
    """Any number of inserted turns; two lead everywhere a turn can lead."""
    once = tuple(tuple(0 if i == j else INSERT_COST if NEXT[i] == j else NEVER for j in STATES) for i in STATES)
    return times(once, once)


@cache
def step(sym: int) -> Matrix:
    """Inserted turns, then the turn itself: deleted, kept or reroled."""
    initial, fault = divmod(sym, 4)
    costs = [[NEVER] * 4 for _ in STATES]
    for i in STATES:
        costs[i][i] = DELETE_COST
        if fault in (FINE, TRUNCATED):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            costs[i][NEXT[i]] = min(costs[i][NEXT[i]], REROLE_COST + extra)
            if (i, initial) in AFTER:
                j = AFTER[i, initial]
                costs[i][j] = min(costs[i][j], extra)
    return times(_inserts(), tuple(map(tuple, costs)))


@cache
def power(sym: int, k: int) -> Matrix:
    """The matrix of 2 ** k equal turns."""
    if k == 0:
        return step(sym)
    half = power(sym, k - 1)
    return times(half, half)


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of each run of equal consecutive symbols."""
    return [(sym, sum(1 for _ in same)) for sym, same in groupby(symbols)]


def illegal(runs_: list[tuple[int, int]]) -> int:
    """Adjacent turns whose initials may not follow each other; equal initials never may."""
    within = sum(n - 1 for _, n in runs_)
    return within + sum((a // 4, b // 4) not in LEGAL for (a, _), (b, _) in zip(runs_, runs_[1:]))


#: Least costs when no turn is left: nothing, or the turns that complete a pair.
END: Vector = before(_inserts(), (0, NEVER, NEVER, 0))


def advance(sym: int, n: int, costs: Vector) -> Vector:
    """Least costs in front of a run of ``n`` turns, given those behind it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            costs = before(power(sym, k), costs)
    return costs


def _level(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(c - least for c in costs)


@cache
def _one(sym: int, state: int, behind: Vector) -> tuple[str, int]:
    """The edits of one turn from ``state``, and the state after it."""
    initial, fault = divmod(sym, 4)
    here = before(step(sym), behind)
    free = fault in (FINE, TRUNCATED)
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    out = []
    while True:
        if DELETE_COST + behind[state] == here[state]:
            return "".join(out) + DELETE, state
        if INSERT_COST + here[NEXT[state]] == here[state]:
            out.append(INSERT)
            state = NEXT[state]
        elif free and (state, initial) in AFTER and extra + behind[AFTER[state, initial]] == here[state]:
            return "".join(out) + KEEP, AFTER[state, initial]
        else:
            return "".join(out) + REROLE, NEXT[state]


@cache
def _block(sym: int, k: int, state: int, behind: Vector) -> tuple[str, int]:
    """The edits of 2 ** k equal turns from ``state``; ``behind`` is levelled to a least cost of 0."""
    if k == 0:
        return _one(sym, state, behind)
    first, state = _block(sym, k - 1, state, _level(before(power(sym, k - 1), behind)))
    second, state = _block(sym, k - 1, state, behind)
    return first + second, state


#: Blocks longer than this are not remembered whole, so that what is remembered stays small.
LARGEST_BLOCK = 10


def unroll(sym: int, n: int, state: int, behind: Vector) -> tuple[list[str], int]:
    """The edits of a run of ``n`` turns from ``state``, as pieces, and the state after it."""
    pieces = []
    left = n
    while left:
        k = min(LARGEST_BLOCK, left.bit_length() - 1)
        left -= 1 << k
        piece, state = _block(sym, k, state, _level(advance(sym, left, behind)))
        pieces.append(piece)
    return pieces, state


def repair(symbols: bytes) -> tuple[int, str]:
    """(least cost, its audit) of a sequence of turns; of no turns (0, "")."""
    if not symbols:
        return 0, ""
    runs_ = runs(symbols)
    behind = [END]
    for sym, n in reversed(runs_):
        behind.append(advance(sym, n, behind[-1]))
    behind.reverse()
    pieces, state = [], START
    for (sym, n), costs in zip(runs_, behind[1:]):
        some, state = unroll(sym, n, state, costs)
        pieces += some
    while state not in (START, ASSISTANT):
        pieces.append(INSERT)
        state = NEXT[state]
    return behind[0][START], "".join(pieces)


def split(audit: str, sizes: list[int]) -> list[str]:
    """``audit`` cut after the edits of so many turns each; inserted turns go with the turn behind them, the last with the last part."""
    out, at = [], 0
    for size in sizes:
        begin = at
        while size:
            size -= audit[at] != INSERT
            at += 1
        out.append(audit[begin:at])
    if out:
        out[-1] += audit[at:]
    return out


def after(edits: str, state: int, symbols: bytes) -> int:
    """The state that ``edits`` of ``symbols`` lead to from ``state``."""
    at = 0
    for edit in edits:
        if edit == INSERT:
            state = NEXT[state]
            continue
        if edit != DELETE:
            state = AFTER[state, symbols[at] // 4] if edit == KEEP else NEXT[state]
        at += 1
    return state


def edited(edits: str, state: int, turns: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """What ``edits`` make of ``turns`` (role, text) from ``state``, and the state after them."""
    out, at = [], 0
    for edit in edits:
        if edit == INSERT:
            state = NEXT[state]
            out.append((ROLE[state], ""))
            continue
        role, text = turns[at]
        at += 1
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = AFTER[state, symbol(role, FINE) // 4]
        else:
            state = NEXT[state]
            role = ROLE[state]
        out.append((role, text))
    return out, state
