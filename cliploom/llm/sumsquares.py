"""Sum-of-squares packing of pieces into sequences.

Every open sequence has a gap, its room that is left. A piece goes where the sum,
over all gaps, of the squared number of open sequences with that gap becomes
smallest; of equal sums the smallest gap afterwards. A sequence without gap is
closed and counts no more. Pieces are placed by falling length, and a new sequence
is opened where no open one has room: the rule chooses among the open ones. (With
an empty sequence as one more choice of the rule, at 20,225 pieces of documents
that is 5,446 partly filled sequences against 5,424, which is the least possible.)

Pieces are dealt by a hash of their number into shards, each packed in a task of its
own (packing.place); a shard leaves about one sequence partly empty.
"""

from __future__ import annotations

import numpy as np

NEVER = 1 << 40


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, in the order given; lengths are from 1 to capacity."""
    members: list[list[int]] = [[] for _ in range(capacity)]  # open sequences by gap
    # with c sequences of a gap, one less changes the sum by 1 - 2c, and one more by 1 + 2c; closed ones (gap 0) don't count
    less = np.full(capacity, NEVER, np.int64)
    more = np.ones(capacity, np.int64)
    more[0] = 0
    sequences, offsets, n = [], [], 0

    def count(gap: int) -> None:
        c = len(members[gap])
        less[gap], more[gap] = 1 - 2 * c if c else NEVER, 1 + 2 * c

    for length in lengths:
        gap, sequence = capacity, n
        if length < capacity:
            change = less[length:] + more[: capacity - length]
            best = int(change.argmin())
            if change[best] < NEVER // 2:
                gap = best + length
                sequence = members[gap].pop()
                count(gap)
        n += gap == capacity
        sequences.append(sequence)
        offsets.append(capacity - gap)
        if gap > length:
            members[gap - length].append(sequence)
            count(gap - length)
    return sequences, offsets
