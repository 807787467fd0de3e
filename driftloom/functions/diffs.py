"""Text and call comparisons that need Python; applied only where something changed, in Arrow batches.

The marks of lines and words and the sentences on calls are fixed values: readers of the results look for them.
"""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unified(before: str | None, after: str | None) -> str:
    """Unified diff, three lines of context, line ends kept and none added; empty if nothing changed."""
    before, after = before or "", after or ""
    if before == after:
        return ""
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), "before", "after", lineterm=""))


def line_view(before: str | None, after: str | None) -> list[str]:
    """Every line with its mark ("    ", "  - ", "  + "); for single lines, also the words removed and added."""
    sides = [(x or "").splitlines() for x in (before, after)]
    out: list[str] = []

    def marked(mark: str, lines: list[str]) -> None:
        out.extend(mark + (line or "(empty)") for line in lines)

    for tag, i, j, k, m in difflib.SequenceMatcher(None, *sides, autojunk=False).get_opcodes():
        if tag == "equal":
            marked("    ", sides[0][i:j])
        else:
            marked("  - ", sides[0][i:j])
            marked("  + ", sides[1][k:m])
    if max(map(len, sides)) <= 1:
        words = [(x or "").split() for x in (before, after)]
        codes = [c for c in difflib.SequenceMatcher(None, *words, autojunk=False).get_opcodes() if c[0] != "equal"]
        gone = " ".join(w for _, i, j, _, _ in codes for w in words[0][i:j])
        new = " ".join(w for _, _, _, k, m in codes for w in words[1][k:m])
        if gone or new:
            out += ["", "  ── word diff ──", *[f"  - {gone}"] * bool(gone), *[f"  + {new}"] * bool(new)]
    return out


def signature(called: bool | None, arguments: str | None) -> str:
    """A call's pattern: sorted keys; lists by length, objects by a mark, scalars by the start of their JSON."""
    if not called:
        return "__not_called__"
    shown = {list: lambda v: f"[{len(v)} items]", dict: lambda v: "{...}"}
    values = json.loads(arguments) if arguments else {}
    return "|".join(f"{k}={shown.get(type(v), lambda x: json.dumps(x)[:40])(v)}" for k, v in sorted(values.items()))


def compared(before_called: bool | None, before: str | None, after_called: bool | None, after: str | None) -> str:
    """One sentence on how two calls differ."""
    match bool(before_called), bool(after_called):
        case False, False:
            return "Neither agent called the tool."
        case True, False:
            return "BEFORE called the tool; AFTER did not."
        case False, True:
            return "AFTER called the tool; BEFORE did not."
    b, a = (json.loads(x) if x else {} for x in (before, after))
    parts = []
    if only := sorted(b.keys() - a.keys()):
        parts.append(f"BEFORE sent {only}; AFTER omitted them")
    if only := sorted(a.keys() - b.keys()):
        parts.append(f"AFTER sent {only}; BEFORE did not")
    for k in sorted(k for k in b.keys() & a.keys() if b[k] != a[k]):
        parts.append(f"{k}: BEFORE={json.dumps(b[k])[:60]} vs AFTER={json.dumps(a[k])[:60]}")
    return "; ".join(parts) + "." if parts else "No meaningful parameter difference — both agents called identically."


def _over(f, kind):
    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        values = zip(*[c.astype(object).where(c.notna(), None) for c in columns], strict=True)
        return pd.Series([f(*v) for v in values], dtype=object)

    return run


unified_diff = _over(unified, T.StringType())
diff_lines = _over(line_view, T.ArrayType(T.StringType()))
call_signature = _over(signature, T.StringType())
call_comparison = _over(compared, T.StringType())
