"""The cheapest edits of a conversation, as arrays: cost DP over segments, then prefix-doubling path ranking.

A state says what the repaired rows so far end with: nothing, system, user, or assistant. Before
each row a turn may be inserted; the row itself is deleted, kept or given another role. ``Segment``
rows are at most a few hundred; many segments are worked on side by side.
"""

from __future__ import annotations

import numpy as np

NONE, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3
#: The role a turn must have next, as the state that follows; inserted and changed turns take it.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: State after a row that is kept, by the class of its role (s, u, a, other) and the state; 4: not allowed.
KEPT = np.array([[SYSTEM, 4, 4, 4], [USER, USER, 4, USER], [4, 4, ASSISTANT, 4], [4, 4, 4, 4]])
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FAR = 1 << 50
#: Cost from each state to a proper end when no row is left.
END = (0, 2 * INSERT, INSERT, 0)
#: Faults in a code: ``class + 4 * fault``.
BLANK, DUPLICATE, CUT = 1, 2, 3
LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)
#: Rows worked on at a time.
BLOCK_ROWS = 32_768


def _options(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and changing rows, given the cost ``after`` (rows, states, ends) behind them."""
    rows, fault = len(codes), codes >> 2
    padded = np.concatenate([after, np.full((rows, 1, after.shape[2]), FAR)], axis=1)
    extra = np.where(fault == CUT, TRUNCATED, 0)[:, None, None]
    extra = np.where(((fault == BLANK) | (fault == DUPLICATE))[:, None, None], FAR, extra)
    keep = np.take_along_axis(padded, KEPT[codes & 3][:, :, None], axis=1) + extra
    return after + DELETE, keep, after[:, NEXT] + REROLE + extra


def costs(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost-to-go by position and state: ``ends`` (segments, states, k) is what follows each segment.

    Segment ``s`` has ``lengths[s]`` + 1 positions, the last one behind its rows. All segments step
    backward together, the longer ones first.
    """
    first_row = np.cumsum(lengths) - lengths
    first = first_row + np.arange(len(lengths))
    found = np.empty((len(codes) + len(lengths), 4, ends.shape[2]), dtype=np.int64)
    found[first + lengths] = ends
    by_length = np.argsort(-lengths, kind="stable")
    sizes = -lengths[by_length]
    for back in range(1, int(lengths.max(initial=0)) + 1):
        here = by_length[: np.searchsorted(sizes, -back, "right")]
        at = lengths[here] - back
        delete, keep, change = _options(codes[first_row[here] + at], found[first[here] + at + 1])
        best = np.minimum(np.minimum(delete, keep), change)
        user = np.minimum(best[:, USER], best[:, ASSISTANT] + INSERT)
        assistant = np.minimum(best[:, ASSISTANT], best[:, USER] + INSERT)
        best = np.stack([np.minimum(best[:, NONE], user + INSERT), np.minimum(best[:, SYSTEM], user + INSERT), user, assistant], axis=1)
        found[first[here] + at] = np.minimum(best, FAR)
    return found


def transfers(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Cost of crossing each segment from state to state, (segments, 4, 4)."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    found = costs(codes, lengths, np.broadcast_to(unit, (len(lengths), 4, 4)))
    return found[np.cumsum(lengths + 1) - lengths - 1]


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cost of crossing ``a`` and then ``b``."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def paths(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Audit (bytes) and exit state of the least cheapest path through each segment, from each state: (segments, 4).

    Nodes are (position, state); arcs are optimal where they lie on a cheapest path. Nodes are ranked by the
    first letter of their least audit, then by its first 2, 4, 8 ... letters: the rank of twice as many is
    that of the pair (own rank, rank of the node that the pointer, doubled each time, leads to). Each node
    then follows its optimal arc of least letter and rank behind it, and the path from an entry is read
    off by doubling these pointers. A ``last`` segment ends its conversation, the others end anywhere.
    """
    positions = len(codes) + len(lengths)
    first = np.cumsum(lengths + 1) - lengths - 1
    final = first + lengths
    is_row = np.ones(positions, dtype=bool)
    is_row[final] = False
    rows = np.flatnonzero(is_row)
    cost = costs(codes, lengths, ends[:, :, None])[:, :, 0]

    # Per node, in the order of their letters, the arcs on a cheapest path and where they lead.
    delete, keep, change = (x[:, :, 0] for x in _options(codes, cost[rows + 1][:, :, None]))
    at = 4 * np.arange(positions)[:, None]
    own = at + np.arange(4)
    target = np.repeat(own[None], 5, axis=0)
    optimal = np.zeros((5, positions, 4), dtype=bool)
    optimal[0, final] = True
    optimal[0, final[last]] = cost[final[last]] == 0
    target[1, rows], optimal[1, rows] = own[rows] + 4, delete == cost[rows]
    target[2], optimal[2] = at + NEXT, cost[:, NEXT] + INSERT == cost
    optimal[2, final[~last]] = False
    goal = KEPT[codes & 3]
    target[3, rows], optimal[3, rows] = at[rows] + 4 + np.minimum(goal, 3), (keep == cost[rows]) & (goal < 4)
    target[4, rows], optimal[4, rows] = at[rows] + 4 + NEXT, change == cost[rows]
    letter = optimal.argmax(axis=0).ravel()
    pointer = np.take_along_axis(target, letter.reshape(1, positions, 4), axis=0).ravel()

    rank, jump, levels = letter, pointer, 1
    while letter[jump].any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]
        jump, levels = jump[jump], levels + 1
    keys = np.where(optimal, np.arange(5)[:, None, None] * (int(rank.max()) + 1) + rank[target], np.iinfo(np.int64).max)
    letter = keys.argmin(axis=0).ravel()
    jump = np.take_along_axis(target, letter.reshape(1, positions, 4), axis=0).ravel()
    walk = own[first].reshape(-1, 1)
    for _ in range(levels):
        walk = np.concatenate([walk, jump[walk]], axis=1)
        jump = jump[jump]
    audits = np.ascontiguousarray(LETTERS[letter[walk]]).view(f"S{walk.shape[1]}")
    return audits.reshape(-1, 4), (walk[:, -1] % 4).reshape(-1, 4)


def rows_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the rows of segments that start at ``starts``, one segment after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def blocks(lengths: np.ndarray) -> list[np.ndarray]:
    """Segments of like lengths, together BLOCK_ROWS rows at most (or one segment)."""
    order = np.argsort(lengths, kind="stable")
    found, now, rows, width = [], [], 0, -1
    for s in order:
        size = int(lengths[s])
        if now and (rows + size > BLOCK_ROWS or size.bit_length() != width):
            found.append(np.array(now))
            now, rows = [], 0
        now.append(s)
        rows, width = rows + size + 1, size.bit_length()
    return [*found, np.array(now)] if now else found
