"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_shouts": text.count("!!"),
    }


def rejected(text):
    q = quality(text)
    n = q["n_words"]
    return (
        n < 50
        or 100 * q["n_repeat_words"] > 50 * n
        or 100 * q["n_symbols"] > 30 * n
        or 100 * q["n_dup_lines"] > 50 * q["n_lines"]
        or q["word_chars"] > 15 * n
        or 100 * q["n_shouts"] > 30 * n
    )


def simhash(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    """Lists of positions that belong together."""
    f = np.array(prints, np.uint64)
    group = list(range(len(f)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(f)):
        for j in np.nonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius)[0] + i + 1:
            a, b = find(i), find(int(j))
            group[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(f)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())
