"""What a parse tells of itself: the same sections as Markdown and for a console."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import spatial, summary

#: Names of the layers of summary.layered().
LAYERS = {"t1": "building in city", "t2": "city in state", "t3": "state in country"}


def duration(seconds: float) -> str:
    if seconds < 1:
        return f"{seconds * 1e3:.1f} ms"
    return f"{seconds:.2f} s" if seconds < 60 else f"{int(seconds // 60)}m {int(seconds % 60):02d}s"


def size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def _value(v) -> str:
    if isinstance(v, float):
        return f"{v:,.3f}"
    return f"{v:,}" if isinstance(v, int) else str(v)


class Clock:
    """Runs steps and keeps their seconds."""

    def __init__(self) -> None:
        self.took: dict[str, float] = {}

    def __call__(self, step: str, run: Callable):
        at = time.perf_counter()
        out = run()
        self.took[step] = time.perf_counter() - at
        return out


def measure(points: DataFrame, admins: DataFrame, nodes: DataFrame, polys: DataFrame, attached: DataFrame, clock: Clock) -> dict:
    """The figures of hierarchy, containment, layers and attachment; each is a row or five at most."""
    one = lambda df: df.first().asDict()
    out = {}
    pairs = spatial.intersections(polys)
    out["hierarchy"] = clock("hierarchy statistics", lambda: one(spatial.hierarchy_stats(nodes, pairs)))
    out["tiers"] = clock("tiers", lambda: one(summary.tier_counts(admins)))
    out["first pairs"] = [tuple(r) for r in summary.first_pairs(pairs, polys).collect()] if out["hierarchy"]["pairs"] else []
    out["containment"] = clock("containment", lambda: one(summary.pip_bench(points, nodes)))
    out["layers"] = clock("layers", lambda: one(summary.layered(points, nodes)))
    out["attachment"] = clock("attachment", lambda: one(spatial.attach_stats(attached)))
    out["addresses"] = [(r["id"], r["lat_e7"] / 1e7, r["lon_e7"] / 1e7, r["address"]) for r in summary.address_sample(points, nodes).orderBy("id").collect()]
    return out


def sections(result: dict) -> list[tuple[str, list[tuple[str, str]]]]:
    """(title, rows) for each part of the report that `result` has figures for."""
    took, seen = result.get("steps", {}), result.get("measures", {})
    plain = lambda d: [(k.replace("_", " "), _value(v)) for k, v in d.items()]

    def per(step: str, n: int) -> list[tuple[str, str]]:
        return [("total time", duration(took[step])), ("time a query", f"{took[step] * 1e6 / n:.3f} µs")] if step in took and n else []

    out = [("Extraction", plain(result["stats"]))]
    if "hierarchy" in seen:
        rows = plain(seen["hierarchy"]) + plain(seen.get("tiers", {}))
        rows += [(f"crossing pair of level {level}", f"{a} - {b}") for a, b, level in seen.get("first pairs", ())]
        out.append(("Hierarchy", rows))
    if "containment" in seen:
        out.append(("Points in areas", plain(seen["containment"]) + per("containment", seen["containment"]["queries"])))
    if "layers" in seen:
        x = seen["layers"]
        rows = plain({k: x[k] for k in ("buildings", "skipped")})
        for k, name in LAYERS.items():
            rows += [(f"{k.upper()} {name}: queries", _value(x["buildings"])), (f"{k.upper()} misses", _value(x[f"{k}_misses"])), (f"{k.upper()} hits", _value(x["buildings"] - x[f"{k}_misses"])), (f"{k.upper()} inside", _value(x[f"{k}_hits"]))]
        out.append(("Layers", rows + per("layers", x["buildings"])))
    if "attachment" in seen:
        x = seen["attachment"]
        share = 100 * x["points_with_any"] / x["points"] if x["points"] else 0.0
        out.append(("Attached areas", plain(x) + [("share of points with any", f"{share:.1f} %")]))
    if seen.get("addresses"):
        out.append(("First addresses", [(f"{lat:.7f}, {lon:.7f}", text) for _, lat, lon, text in seen["addresses"]]))
    if took:
        out.append(("Steps", [(k, duration(v)) for k, v in took.items()]))
    return out


def markdown(result: dict, when: datetime.datetime) -> tuple[str, str]:
    """(file name, Markdown)."""
    lines = [f"# Parse report: {result['dataset']}", "", "| | |", "|---|---:|", f"| Source | {result['source']} |", f"| Wall-clock | {duration(result['seconds'])} |", ""]
    for i, (title, rows) in enumerate(sections(result), 1):
        lines += [f"## {i}. {title}", "", "| | |", "|---|---:|", *[f"| {k} | {v} |" for k, v in rows], ""]
    return f"{result['dataset']}_{when:%Y-%m-%d_%H%M%S}.md", "\n".join(lines)


def console(result: dict) -> str:
    """The same figures in aligned columns."""
    parts = sections(result)
    wide = max((len(k) for _, rows in parts for k, _ in rows), default=0)
    lines = [f"{result['dataset']} ({result['source']}), {duration(result['seconds'])}"]
    for title, rows in parts:
        lines += ["", title.upper(), *[f"  {k:<{wide}}  {v:>14}" for k, v in rows]]
    return "\n".join(lines)
