from __future__ import annotations

from leafmark.llm.simhash import fingerprint


def reference_groups(rows):
    """doc_id to the smallest doc_id of its component, by comparing all pairs."""
    prints = [(i, fingerprint(t.encode())) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}
