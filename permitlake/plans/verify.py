"""Holds a written exhibit against its own arithmetic and against expected figures."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def figure(x: Any, path: str) -> Any:
    """A value by its dotted path; a missing one is None."""
    for key in path.split("."):
        x = x.get(key) if isinstance(x, dict) else None
    return x


def check(exhibit: dict[str, Any], expected: dict[str, Any] | None = None) -> list[str]:
    """What is wrong with an exhibit, in words; nothing if all holds."""
    out = []
    counts = exhibit["counts"]
    if counts["consented_subjects"] + counts["hidden_subjects"] != counts["subjects"]:
        out.append("permitted and hidden subjects do not add up")
    for side in ("masking", "exclusion"):
        r = exhibit[side]
        if r["total_leaks"] != len(r["leaks"]) or sum(r["by_vector"].values()) != r["total_leaks"]:
            out.append(f"{side}: the tallies do not add up")
    if exhibit["masking"]["probes_run"] != exhibit["exclusion"]["probes_run"]:
        out.append("the configurations were probed differently")
    if exhibit["exclusion"]["total_leaks"]:
        out.append("the exclusion configuration leaked")
    if not exhibit["masking"]["total_leaks"]:
        out.append("the baseline leaked nothing")
    dark = exhibit["revocation_drill"]
    if not dark["all_dark"] or any(s["visible_after"] or not s["visible_before"] for s in dark["surfaces"]):
        out.append("a surface of the drill is not dark, or never was lit")
    if "LeftSemi" not in exhibit["query_plan"]["exclusion"] or "LeftSemi" in exhibit["query_plan"]["masking"]:
        out.append("the plans do not show the restriction where it belongs")
    out += [f"{path} is {figure(exhibit, path)!r}, not {want!r}" for path, want in (expected or {}).items() if figure(exhibit, path) != want]
    return out


def check_file(path: str, expected: dict[str, Any] | None = None) -> list[str]:
    return check(json.loads(Path(path).read_text(encoding="utf-8")), expected)
