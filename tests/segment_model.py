"""The segmenter's rules in plain Python, to compare columns with."""

from __future__ import annotations

from lineweave.operators.segment import CUT_COST, LEAST_CHARS, OVER_COST, OVER_S


class Cue:
    """Word lengths and times of a cue, with sizes and durations of any piece."""

    def __init__(self, letters, start, end):
        self.n, self.start, self.end, self.chars = len(letters), list(start), list(end), [0]
        for n in letters:
            self.chars.append(self.chars[-1] + int(n))

    def size(self, a: int, b: int) -> int:
        return self.chars[b] - self.chars[a]

    def seconds(self, a: int, b: int) -> float:
        return (self.end[b - 1] - self.start[a]) / 1000.0


def feasible(cue: Cue, cuts, max_chars: int) -> bool:
    """Some choice of cuts gives pieces of 2 to ``max_chars`` letters."""
    reached = {0}
    for b in [*sorted(k for k in set(cuts) if 0 < k < cue.n), cue.n]:
        if any(LEAST_CHARS <= cue.size(a, b) <= max_chars for a in reached):
            reached.add(b)
    return cue.n in reached


def best_cuts(cue: Cue, cuts, max_seconds: float, max_chars: int) -> list[int]:
    """Cuts of least cost: 1000 a piece and 1000 a second beyond the limit and its tolerance."""
    if cue.n < 2 or not cuts:
        return []
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for b in [*sorted(k for k in set(cuts) if 0 < k < cue.n), cue.n]:
        for a in sorted(best):
            if LEAST_CHARS <= cue.size(a, b) <= max_chars:
                price = best[a][0] + OVER_COST * max(0.0, cue.seconds(a, b) - max_seconds - OVER_S) + CUT_COST
                if b not in best or price < best[b][0]:
                    best[b] = (price, [*best[a][1], b])
    return best.get(cue.n, (0.0, []))[1][:-1]


def cut_errors(cue: Cue, proposed, legal, max_chars: int) -> list[str]:
    """Why proposed cuts cannot be used; empty if they can."""
    ks = sorted({int(k) for k in proposed})
    if not ks:
        return ["empty"]
    errors = [f"out_of_range:{k}" if not 0 < k < cue.n else f"illegal:{k}" for k in ks if not 0 < k < cue.n or k not in legal]
    if errors:
        return errors
    for a, b in zip([0, *ks], [*ks, cue.n], strict=True):
        if cue.size(a, b) > max_chars:
            errors.append(f"too_long:{a}-{b}")
        if cue.size(a, b) < LEAST_CHARS:
            errors.append(f"too_short:{a}-{b}")
    return errors


def without_redundant(cue: Cue, cuts, max_seconds: float, max_chars: int) -> list[int]:
    """Drop, earliest first and again from the start, cuts that the limits do not need."""
    ks = sorted({int(k) for k in cuts})

    def within(trial: list[int]) -> bool:
        return all(cue.seconds(a, b) <= max_seconds + 0.05 and LEAST_CHARS <= cue.size(a, b) <= max_chars for a, b in zip([0, *trial], [*trial, cue.n], strict=True))

    while (k := next((k for k in ks if within([x for x in ks if x != k])), None)) is not None:
        ks.remove(k)
    return ks


def plan(words, legal, weak, gap, proposed, max_seconds, max_chars):
    """(cuts, how, errors)."""
    cue, allowed = Cue([len("".join((w["word"] or "").split())) for w in words], [w["start"] for w in words], [w["end"] for w in words]), set()
    for more in (legal, weak, gap):
        allowed |= set(more or ())
        if cue.size(0, cue.n) <= max_chars or feasible(cue, allowed, max_chars):
            break
    errors = cut_errors(cue, proposed, allowed, max_chars) if proposed is not None else ["none_proposed"]
    if not errors:
        cuts, how = list(proposed), "proposed"
    else:
        cuts = best_cuts(cue, allowed, max_seconds, max_chars)
        how = "searched" if cuts else "rejected" if cue.size(0, cue.n) > max_chars else "kept"
    return without_redundant(cue, cuts, max_seconds, max_chars) if cuts else [], how, errors
