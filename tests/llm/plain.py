"""Plain versions of operators."""

import hashlib
from collections.abc import Iterable

N = 10


def brute_force(docs: Iterable[tuple], items: Iterable[tuple], n: int = N) -> dict:
    """What the query must return, by plain search."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(k) for k in wins}:
            for k in range(len(w) - m + 1):
                if (key := tuple(w[k : k + m])) in wins:
                    hit.update(range(k, k + m))
                    found |= wins[key]
        names = sorted({str(x) for x in found if x is not None})
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out
