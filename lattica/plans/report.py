"""Reports as text and JSON."""

from __future__ import annotations

import json
import sys
from decimal import ROUND_HALF_UP, Decimal


def fixed(x: float) -> str:
    """One decimal, of the exact binary value."""
    return str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))


def relative(path: str, root: str) -> str:
    root = root.replace("\\", "/").rstrip("/")
    path = path.replace("\\", "/")
    return path[len(root) + 1 :] if path.startswith(root + "/") else path


def rows(pairs: list[tuple[str, int]], gutter: int = 4) -> list[str]:
    label, value = max(len(a) for a, _ in pairs), max(3, *(len(str(b)) for _, b in pairs))
    return [a.ljust(label + gutter) + str(b).rjust(value) for a, b in pairs]


def bar(value: float, most: float, width: int = 10) -> str:
    n = min(width, max(0, int(value / most * width + 0.5))) if most > 0 else 0
    return "█" * n + "░" * (width - n)


def paint(text: str, code: str) -> str:
    return f"\x1b[{code}m{text}\x1b[0m" if sys.stdout.isatty() else text


def many(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def summary_text(s: dict) -> str:
    first = [(a, s[b]) for a, b in (("Files", "files"), ("Components", "components"), ("Functions", "functions"), ("Classes", "classes"), ("Imports", "imports"), ("Exports", "exports"))]
    last = [("Circular deps", s["circular_deps"]), ("Orphan files", s["orphan_files"])]
    lines = rows(first + last)
    warned = [paint(x, "33") if n else x for x, (_, n) in zip(lines[len(first) :], last, strict=True)]
    return "\n".join([paint("Code graph", "1"), "", f"Project: {s['project_name']}", "", *lines[: len(first)], "", *warned])


def hotspots_text(h: dict) -> str:
    out = [paint("Architecture", "1"), "", f"Project: {h['project_name']}", "", "Most connected files"]
    top = [(relative(x["path"], h["root"]), x["dependents"]) for x in h["hotspots"]]
    out += [f"  {x} dependents" for x in rows(top)] if top else ["  (none)"]
    out += ["", "Circular dependencies"]
    out += ["  " + " → ".join(relative(p, h["root"]) for p in [*c, c[0]]) for c in h["cycles"]] or ["  (none)"]
    out += ["", "Modules"]
    most = {k: max([1, *(m[k] for m in h["modules"])]) for k in ("coupling", "complexity_average", "dependency_count")}
    for m in h["modules"]:
        out += [f"  Module: {m['module']}", f"    Coupling      {bar(m['coupling'], most['coupling'])} ({m['coupling']})", f"    Complexity    {bar(m['complexity_average'], most['complexity_average'])} ({fixed(m['complexity_average'])})", f"    Dependencies  {bar(m['dependency_count'], most['dependency_count'])} ({m['dependency_count']})", ""]
    return "\n".join(out).rstrip("\n") + "\n"


def _routes(r: dict) -> list[str]:
    return ["", f"Routes among them: {len(r['routes'])}", *("  " + relative(p, r["root"]) for p in r["routes"])]


def impact_text(r: dict) -> str:
    out = [paint("Impact", "1"), "", f"Project: {r['project_name']}", f"Target: {relative(r['target'], r['root'])}", "", f"Reaches {many(len(r['files']), 'file')}"]
    return "\n".join([*out, *(["  " + relative(p, r["root"]) for p in r["files"]] or ["  (nothing leads here)"]), *_routes(r)])


def diff_text(r: dict) -> str:
    out = [paint("Impact of changes", "1"), "", f"Project: {r['project_name']}", ""]
    if not r["changed"]:
        return "\n".join([*out, "Git shows no changes here."])
    out += [f"Changed: {many(len(r['changed']), 'file')}", *(f"  {relative(p, r['root'])} (reaches {n})" for p, n in r["per_file"])]
    out += ["", f"Together they reach {many(len(r['files']), 'file')}", *(["  " + relative(p, r["root"]) for p in r["files"]] or ["  (nothing else leads to them)"])]
    return "\n".join([*out, *_routes(r)])


def as_json(data: object) -> str:
    return json.dumps(data, indent=2, ensure_ascii=False, default=list)
