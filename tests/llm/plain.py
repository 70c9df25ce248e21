"""Quality and secrets once more, in plain Python, from what their contracts and docstrings say."""

from __future__ import annotations

import math
import re
from collections import Counter

#: (bad below, good from, good to, bad above) of the ratios in the order of ``ratios``.
LIMITS = (
    (50, 80, math.inf, math.inf), (2, 3, 10, 14), (0, 0, 0.1, 0.3), (0, 0, 0.03, 0.08), (0, 0, 0.1, 0.3), (0, 0, 0.2, 0.4), (0.1, 0.25, math.inf, math.inf), (0, 0, 0.2, 0.5),
    (0, 0, 0.1, 0.3),
)


def counts(text: str | None) -> dict[str, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "lines": len(lines), "distinct": len(set(words)), "upper": len(re.findall("[A-Z]", text)), "marks": text.count("!"),
    }


def votes(c: dict[str, int]) -> tuple[str, ...]:
    n, chars = max(c["n_words"], 1), max(c["word_chars"], 1)
    ratios = (
        c["n_words"], c["word_chars"] / n, c["n_symbols"] / n, c["n_symbols"] / chars, c["n_dup_lines"] / max(c["lines"], 1), c["n_repeat_words"] / n,
        c["distinct"] / max(min(c["n_words"], 400), 1), c["upper"] / chars, c["marks"] / n,
    )
    return tuple("bad" if x < a or x > d else "good" if b <= x <= e else "none" for x, (a, b, e, d) in zip(ratios, LIMITS, strict=True))


def base_failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def good_probability(ballots: Counter) -> dict[tuple[str, ...], float]:
    """Expectation-maximisation over documents' votes: one good class, and a bad one for each rule."""
    n = len(LIMITS)
    share = [0.8] + [0.2 / n] * n
    right = [0.98] * n
    seen = [[0.9 if i == j else 0.3 for j in range(n)] for i in range(n)]
    total = sum(ballots.values())
    while True:
        of = {}
        for ballot in ballots:
            logs = [math.log(share[0]) + sum(math.log(right[j] if v == "good" else 1 - right[j]) for j, v in enumerate(ballot) if v != "none")]
            logs += [math.log(share[i + 1]) + sum(math.log(seen[i][j] if v == "bad" else 1 - seen[i][j]) for j, v in enumerate(ballot) if v != "none") for i in range(n)]
            parts = [math.exp(x - max(logs)) for x in logs]
            of[ballot] = [x / sum(parts) for x in parts]
        weight = lambda c, j, *kinds: sum(of[b][c] * k for b, k in ballots.items() if b[j] in kinds)  # noqa: B023, E731
        new_share = [(sum(of[b][c] * k for b, k in ballots.items()) + 1) / (total + n + 1) for c in range(n + 1)]
        new_right = [min(max((weight(0, j, "good") + 0.98 * 50) / (weight(0, j, "good", "bad") + 50), 0.5), 0.999) for j in range(n)]
        new_seen = [
            [
                min(max((weight(i + 1, j, "bad") + (0.9 * 10 if i == j else 0.2 * 5)) / (weight(i + 1, j, "good", "bad") + (10 if i == j else 5)), 0.01), 0.99)
                for j in range(n)
            ]
            for i in range(n)
        ]
        old, new = [*share, *right, *sum(seen, [])], [*new_share, *new_right, *sum(new_seen, [])]
        share, right, seen = new_share, new_right, new_seen
        if max(abs(a - b) for a, b in zip(old, new, strict=True)) < 1e-9:
            return {b: p[0] for b, p in of.items()}


def secrets(text: str) -> list[tuple[str, int, int]]:
    rules = {
        "assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"(AKIA[A-Z0-9]+)", "hex": r"([0-9a-f]+)", "pem": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", "github": r"(gh[pousr]_[A-Za-z0-9]{36,})",
    }
    least = {"assign": 6, "access": 20, "hex": 24, "pem": 0, "github": 0}
    found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(rules.items()) for m in re.finditer(p, text, re.ASCII) if len(m[1]) >= least[kind]]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def redacted(text: str) -> str:
    out, at = "", 0
    for kind, begin, end in secrets(text):
        if begin >= at:
            out += text[at:begin] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]
