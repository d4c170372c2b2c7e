"""Plain versions of the operators, row by row, for tests."""

import hashlib
import re

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    """(start, kind, end) of the base secrets, in order."""
    return sorted((m.start(), k, m.end()) for k, (_, pattern, counts) in enumerate(BASE) for m in pattern.finditer(text or "") if counts(m))


def base_row(text):
    spans = base_spans(text)
    said = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
    return [sum(k == j for _, k, _ in spans) for j in range(3)] + [hashlib.sha256(said.encode()).hexdigest()]
