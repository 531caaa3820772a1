"""Burrows-Wheeler order and common prefixes of a collection, built column by column.

After Bauer, Cox and Rosone (2013): every round inserts one symbol of every string, from the
last to the first, and the place of the new suffix follows from the place of the suffix it
extends by rank counts over the transform.  New columns are kept in a small sorted side file;
after ``COLUMNS`` rounds it is merged into the main file in one sequential pass, which also
updates the common prefixes around the merged suffixes.
"""

from __future__ import annotations

import numpy as np

COLUMNS = 6
BLOCK_BITS = 5
ROOM_BITS = 8  # ids are string << 8 | suffix length, so strings are shorter than 256 bytes
ROOM = 1 << ROOM_BITS

_U = np.uint64
_STEPS = [_U(1) << _U(8 * k) for k in range(7, 0, -1)]


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, first byte highest."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(n + ROOM, np.uint64)
    for k in range(8):
        out[:n] = (out[:n] << _U(8)) | padded[k:k + n]
    return out


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of the bytes from positions a and b on, at most ``limit``."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    off = 0
    while len(open_) and off < limit:
        x = words[a[open_] + off] ^ words[b[open_] + off]
        same = (x == 0).astype(np.int64)
        for s in _STEPS:
            same += x < s
        out[open_] += same
        open_ = open_[x == 0]
        off += 8
    return np.minimum(out, limit)


def _insert(old: np.ndarray, at: np.ndarray, stay: np.ndarray, values) -> np.ndarray:
    out = np.empty(len(stay), old.dtype)
    out[stay] = old
    out[at] = values
    return out


def collection_order(data: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, prefix): all suffixes of the strings in sorted order as string * ROOM + suffix
    length, and for suffixes of at least ``depth`` bytes the common prefix with the one
    before, counted up to ``depth`` (0 where either is shorter than that).

    ``data`` holds the bytes, ``start`` and ``length`` the strings (1 to ROOM - 1 bytes)."""
    count, end = len(start), start + length
    if count << ROOM_BITS >= 1 << 31:
        raise ValueError("too many strings for one collection")
    used = np.unique(data)
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)  # 0: no symbol before a string
    sym = code[data]
    sigma = len(used) + 1
    words = _words(data)
    # main file: the empty suffixes first, in string order
    main_id = np.arange(count, dtype=np.int32) << ROOM_BITS
    main_sym = sym[end - 1].copy()
    prefix = np.zeros(count, np.uint8)
    front = np.arange(count, dtype=np.int32)  # places of the suffixes to be extended
    done, rounds = 0, int(length.max()) if count else 0
    while done < rounds:
        # rank counts over suffixes whose extension is in the main file already
        rest = main_sym.copy()
        rest[front] = 0
        n = len(rest)
        blocks = (n >> BLOCK_BITS) + 1
        tally = np.bincount((np.arange(n) >> BLOCK_BITS) * sigma + rest, minlength=blocks * sigma)
        before = np.zeros((blocks + 1, sigma), np.int32)  # symbols before each block
        np.cumsum(tally.reshape(blocks, sigma), axis=0, out=before[1:])
        total = before[-1].astype(np.int64)
        total[0] = 0
        smaller = count + np.cumsum(total) - total
        front_sym = main_sym[front]
        keep = front_sym != 0
        front, front_sym, front_id = front[keep], front_sym[keep], main_id[front[keep]]
        # side entries: main entries before each << 32 | id, and the symbol before each
        side = np.zeros(0, np.int64)
        side_sym = np.zeros(0, np.uint8)
        newest = np.zeros(0, np.int64)  # places in the side file of the last round's suffixes
        for r in range(min(COLUMNS, rounds - done)):
            # all suffixes whose extension belongs to the side file, in order; of these only
            # the last round's get a new extension
            if r == 0:
                by_symbol = np.argsort(front_sym, kind="stable")
                fresh = np.ones(len(front), bool)
                q_at, q_id, c = front[by_symbol].astype(np.int64), front_id[by_symbol], front_sym[by_symbol]
            else:
                place = np.arange(len(side)) + np.searchsorted(front, side >> 32, side="left")
                q_sym = np.empty(len(front) + len(side), np.uint8)
                is_front = np.ones(len(q_sym), bool)
                is_front[place] = False
                q_sym[place] = side_sym
                q_sym[is_front] = front_sym
                own = np.full(len(q_sym), -1, np.int32)
                own[place[newest]] = newest
                by_symbol = np.argsort(q_sym, kind="stable")[len(q_sym) - np.count_nonzero(q_sym):]
                own = own[by_symbol]
                fresh = own >= 0
                src = own[fresh]
                q_at, q_id, c = side[src] >> 32, side[src] & 0xFFFFFFFF, side_sym[src]
            block = q_at >> BLOCK_BITS
            tail = q_at & ((1 << BLOCK_BITS) - 1)
            ahead = np.cumsum(tail)
            near = np.arange(int(ahead[-1]) if len(ahead) else 0) + np.repeat((block << BLOCK_BITS) - ahead + tail, tail)
            hits = np.concatenate([[0], np.cumsum(rest[near] == np.repeat(c, tail), dtype=np.int32)])
            rank = before[block, c] + hits[ahead] - hits[ahead - tail]
            new_id = q_id.astype(np.int64) + 1
            s, j = new_id >> ROOM_BITS, new_id & (ROOM - 1)
            newest = np.flatnonzero(fresh)
            stay = ~fresh
            side = _insert(side, newest, stay, ((smaller[c] + rank) << 32) | new_id)
            side_sym = _insert(side_sym, newest, stay, np.where(length[s] > j, sym[np.maximum(end[s] - j - 1, 0)], 0))
        done += min(COLUMNS, rounds - done)
        # one sequential merge of the side file into the main file
        at = (side >> 32) + np.arange(len(side))
        stay = np.ones(n + len(at), bool)
        stay[at] = False
        main_id = _insert(main_id, at, stay, side & 0xFFFFFFFF)
        main_sym = _insert(main_sym, at, stay, side_sym)
        prefix = _insert(prefix, at, stay, 0)
        near_new = ~stay
        near_new[1:] |= ~stay[:-1]
        changed = np.flatnonzero(near_new)
        a, b = main_id[changed - 1], main_id[changed]
        deep = ((a & (ROOM - 1)) >= depth) & ((b & (ROOM - 1)) >= depth)
        changed, a, b = changed[deep], a[deep], b[deep]
        if len(changed):
            prefix[changed] = _common(words, end[a >> ROOM_BITS] - (a & (ROOM - 1)), end[b >> ROOM_BITS] - (b & (ROOM - 1)), depth)
        front = at[newest].astype(np.int32)
    return main_id[count:].astype(np.int64), prefix[count:]
