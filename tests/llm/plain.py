"""Plain versions of what operators compute, to compare with."""

import hashlib
import re

from quillspark.llm.mixing import MOST, WEIGHTS


def exact_targets(sizes: dict) -> dict:
    """Targets by the contract's own loop."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    left, target, full = float(sum(sizes.values())), {}, set()
    while len(full) < len(names):
        open_ = [s for s in names if s not in full]
        share = (left - sum(MOST * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > MOST * sizes[s]}
        target = {s: MOST * sizes[s] if s in full else share * weight[s] for s in names}
        if not over:
            break
        full |= over
    return {s: float(MOST * sizes[s]) if s in full else target[s] for s in names}


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = 10) -> list[tuple]:
    """The contract's digest by plain comparison."""
    lists = [(str(i), words_of(t or "")) for i, t in items]
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text or ""), set(), set()
        for item, own in lists:
            n = min(window, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(item)
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def words_of(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def brute_length(word: str, initial: set[str], continuation: set[str], by_bytes: bool = False) -> int:
    """Greedy longest match by trying every end, for tests."""
    at = n = 0
    while at < len(word):
        pieces, least = (continuation, at) if n else (initial, -1)
        end = next((e for e in range(len(word), least, -1) if word[at:e] in pieces), None)
        if end is None and n and by_bytes:
            at, n = at + 1, n + len(word[at].encode())
            continue
        if end is None:
            return 0
        at, n = end, n + 1
    return n
