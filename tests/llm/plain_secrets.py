"""Plain Python for operator 4: battery, both models of ordinary tokens, and the procedure of Benjamini and Hochberg."""

import collections
import math
import re

from shopfloor.llm import secrets as own

BASE = (
    ("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def base_spans(t):
    return sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(BASE) for m in p.finditer(t or "") if len(m.group(g)) >= n)


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def looks_random(body, letters):
    """The p-value of the battery."""
    v, n, size = [max(letters.find(c), 0) for c in body], len(body), len(letters)
    k = min(16, size, max(2, n // 5))
    bins = collections.Counter(x * k // size for x in v)
    share = [sum(x * k // size == b for x in range(size)) / size for b in range(k)]
    chi = sum((bins[b] - n * share[b]) ** 2 / (n * share[b]) for b in range(k))
    z1 = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = [x * 2 >= size for x in v]
    hi = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    ab = 2 * hi * (n - hi)
    z2 = abs(runs - 1 - ab / n) / math.sqrt(max(ab * (ab - n) / (n * n * (n - 1)), 1e-9))
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    cov = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    z3 = abs(cov) / max(spread, 1e-9) * math.sqrt(n)
    ps = (tail(z1), 2.0 ** (1 - n) if hi in (0, n) else 2 * tail(z2), 1e-12 if spread <= 0 else 2 * tail(z3))
    half = -sum(math.log(max(min(p, 1), 1e-60)) for p in ps)
    return math.exp(-half) * (1 + half + half * half / 2)


def models(texts):
    seen = collections.Counter()
    for t in texts:
        seen.update({w for w in re.split("[^a-z0-9+/_-]+", (t or "").lower()) if 0 < len(w) < own.LEAST})
    pairs = collections.Counter()
    for w, n in seen.items():
        for a, b in zip(f" {w}", f"{w} "):
            pairs[a + b] += n
    return own.step_costs(pairs)


def ratio(body, costs, size):
    width = len(own.SYMBOLS) + 1
    at = [own.SYMBOLS.index(c) + 1 for c in body.lower()]
    words = min(sum(table[a * width + b] for a, b in zip([0, *at], at)) for table in costs)
    case = [1 if c.isupper() else 2 if c.islower() else 0 for c in body]
    near = [(a, b) for a, b in zip(case, case[1:]) if a and b]
    begun = sum(bool(c) and (not i or not case[i - 1]) for i, c in enumerate(case))
    cases = -sum(math.log10(own.TURN if a != b else 1 - own.TURN) for a, b in near) + begun * math.log10(2)
    return words + math.log10(2) + cases - len(body) * math.log10(size)


def spans(rows, fdr=0.05):
    """All spans ``(start, end)`` of each row ``(key, text)``, in order."""
    costs = models(t for _, t in rows)
    found, base = [], {}
    for key, t in rows:
        t = t or ""
        base[key] = base_spans(t)
        masked = list(t)
        for a, _, b, _ in base[key]:
            masked[a:b] = " " * (b - a)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", "".join(masked)):
            body = m.group().rstrip("=")
            letters = next((x for _, p, x in own.ALPHABETS if re.search(p, body)), own.ALPHABETS[-1][2])
            grade = math.floor(max(min(100 * ratio(body, costs, len(letters)), own.DECADES * 100), 0))
            strength = int(min(own.CLASSES - 1, math.floor(math.log2(len(body) / own.LEAST))))
            found.append((strength, grade, looks_random(body, letters) >= own.ALPHA, key, m.start(), m.end()))
    cut = {}
    for strength in {x[0] for x in found}:
        grades = sorted((x[1] for x in found if x[0] == strength), reverse=True)
        passing = [g for g in grades if 10 ** (-g / 100) <= sum(h >= g for h in grades) / len(grades) * fdr]
        cut[strength] = min(passing, default=math.inf)
    out = {key: [(a, i, b) for a, i, b, _ in base[key]] for key, _ in rows}
    for strength, grade, passes, key, a, b in found:
        if passes and grade >= cut[strength]:
            out[key].append((a, len(BASE), b))
    return {key: [(a, b) for a, _, b in sorted(x)] for key, x in out.items()}
