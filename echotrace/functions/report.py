"""Reports of a scan as text, JSON, SARIF 2.1.0, Markdown and CI annotations, from plain dictionaries on the driver.

A report holds totals, `file_stats`, `clones` (each with `instances`) and `dead_functions`; what reaches the driver is the
report of one scan, as any reader of it must hold it. Zero, empty and absent optional fields are left out of JSON.
"""

from __future__ import annotations

import json

from .languages import BY_EXTENSION

#: How much of a report the reading formats show (fixed values).
TOP, SHOWN_INSTANCES, PREVIEW, PREVIEW_MD = 10, 6, 5, 10
TYPES = ("type-1", "type-2", "type-3")


def impact_order(clones: list[dict]) -> list[dict]:
    """The most to gain first: lines times spare copies, then tokens, then hash."""
    return sorted(clones, key=lambda c: (-c["line_count"] * max(len(c["instances"]) - 1, 1), -c.get("token_count", 0), c["hash"]))


def spans_test_and_production(clone: dict) -> bool:
    flags = {bool(i.get("is_test")) for i in clone["instances"]}
    return len(flags) == 2


def sections(report: dict) -> list[tuple[str, list[dict]]]:
    """Clones across test and production code, and the others; suppressed ones in neither."""
    live = [c for c in impact_order(report["clones"]) if not c.get("suppressed")]
    both = [c for c in live if spans_test_and_production(c)]
    return [(t, cs) for t, cs in (("Test and production", both), ("Clones", [c for c in live if c not in both])) if cs]


def as_json(report: dict) -> str:
    """Two-space JSON with <, > and & escaped and whole numbers without a fraction."""

    def clean(v, keep_zero=True):
        if isinstance(v, float) and v.is_integer():
            return int(v)
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if x is not None}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return v

    text = json.dumps(clean(report), indent=2, ensure_ascii=False)
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def function_names(clone: dict) -> list[str]:
    """The functions of a clone's instances, each once, as they come."""
    return list(dict.fromkeys(i["function"] for i in clone["instances"] if i.get("function")))


def notes(report: dict) -> list[str]:
    """What a reader must know of a report's completeness."""
    out = [f"incomplete: {report['partial_reason']}"] if report.get("partial") else []
    if "baseline_known" in report:
        out.append(f"baseline: {report['baseline_known']} known, {report['baseline_new']} new")
    return out


def _hint(path: str) -> str:
    """The name that fenced code of a file goes by."""
    return BY_EXTENSION.get("." + path.rsplit(".", 1)[-1].lower(), "") if "." in path else ""


def _where(i: dict) -> str:
    name = f" ({i['function']})" if i.get("function") else ""
    return f"{i['file']}:{i['start_line']}-{i['end_line']}{name}"


def as_text(report: dict, top: int = TOP) -> str:
    out = [
        f"files scanned: {report['scanned_files']}", f"clones: {report['total_clones']}",
        f"duplicate lines: {report['duplicate_lines']} of {report['total_lines']} ({report['duplication_pct']:.1f}%)", f"lines to save: {report['saved_lines']}",
    ]
    kinds = [f"{t}: {n}" for t in TYPES if (n := sum(c["type"] == t for c in report["clones"]))]
    out += [", ".join(kinds)] if kinds else []
    out += notes(report)
    hot = sorted(report["file_stats"], key=lambda s: (-s["duplication_pct"], s["file"]))[:TOP]
    if hot:
        out += ["", "hotspots:"] + [f"  {s['duplication_pct']:5.1f}%  {s['file']}" for s in hot]
    for title, clones in sections(report):
        shown = clones if top < 0 else clones[:top]
        out += ["", f"{title} ({len(shown)} of {len(clones)}):"]
        for c in shown:
            names = function_names(c)
            told = f", in {', '.join(names)}" if names else ""
            told += f", rule {c['rule']} at {c['rule_min_tokens']} tokens" if c.get("rule") else ""
            told += f", {c['churn']} commits" if "churn" in c else ""
            told += " (suppressed)" if c.get("suppressed") else " (known)" if c.get("baseline") else ""
            out.append(f"[{c['hash']}] {c['type']} {c['line_count']} lines, {len(c['instances'])} places, similarity {c['similarity']:.2f}{told}")
            out += [f"  {_where(i)}" for i in c["instances"][:SHOWN_INSTANCES]]
            if len(c["instances"]) > SHOWN_INSTANCES:
                out.append(f"  ... {len(c['instances']) - SHOWN_INSTANCES} more")
            out += [f"    | {x}" for x in (c["instances"][0].get("lines") or [])[:PREVIEW]]
    if report.get("dead_functions"):
        out += ["", "functions nothing refers to:"] + [f"  {d['file']}:{d['line']} {d['name']} ({d['confidence']})" for d in report["dead_functions"]]
    return "\n".join(out) + "\n"


def as_markdown(report: dict, top: int = TOP) -> str:
    out = ["# Duplication report", "", "| metric | value |", "|---|---|"]
    out += [f"| {k.replace('_', ' ')} | {report[k]} |" for k in ("scanned_files", "total_clones", "total_lines", "duplicate_lines", "duplication_pct", "saved_lines")]
    out += [f"\n> {n}" for n in notes(report)]
    for title, clones in sections(report):
        out += ["", f"## {title}"]
        for c in clones if top < 0 else clones[:top]:
            badge = " `suppressed`" if c.get("suppressed") else " `known`" if c.get("baseline") else " `new`" if "baseline_known" in report else ""
            badge += " `test and production`" if spans_test_and_production(c) else ""
            out += ["", f"<details><summary><code>{c['hash']}</code> {c['type']}, {c['line_count']} lines, {len(c['instances'])} places{badge}</summary>", ""]
            out += [f"- `{_where(i)}`" for i in c["instances"][:SHOWN_INSTANCES]]
            lines = (c["instances"][0].get("lines") or [])[:PREVIEW_MD]
            out += ["", "```" + _hint(c["instances"][0]["file"]), *lines, "```"] if lines else []
            out += ["", "</details>"]
    if report.get("dead_functions"):
        out += ["", "## Functions nothing refers to", "", "| function | place | confidence |", "|---|---|---|"]
        out += [f"| {d['name']} | {d['file']}:{d['line']} | {d['confidence']} |" for d in report["dead_functions"]]
    return "\n".join(out) + "\n"


def _data(s: str) -> str:
    return s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _prop(s: str) -> str:
    return _data(s).replace(":", "%3A").replace(",", "%2C")


def as_annotations(report: dict) -> str:
    """One ::warning line per clone at its first place, and per dead function a ::notice."""
    out = []
    for _, clones in sections(report):
        for c in clones:
            first, rest = c["instances"][0], ", ".join(f"{i['file']}:{i['start_line']}" for i in c["instances"][1:])
            out.append(f"::warning file={_prop(first['file'])},line={first['start_line']},endLine={first['end_line']}::" + _data(f"{c['type']} clone of {c['line_count']} lines, also at {rest}"))
    out += [f"::notice file={_prop(d['file'])},line={d['line']}::" + _data(f"nothing refers to {d['name']}") for d in report.get("dead_functions", [])]
    return "\n".join(out) + ("\n" if out else "")


def as_sarif(report: dict, tool: str = "echotrace") -> str:
    """DUPE001 for clones, DUPE002 for those across test and production code."""
    place = lambda i: {"physicalLocation": {"artifactLocation": {"uri": i["file"]}, "region": {"startLine": i["start_line"], "endLine": i["end_line"]}}}
    results = []
    for c in impact_order(report["clones"]):
        if not c.get("suppressed"):
            results.append(
                {
                    "ruleId": "DUPE002" if spans_test_and_production(c) else "DUPE001", "level": "warning",
                    "message": {"text": f"{c['type']} clone of {c['line_count']} lines in {len(c['instances'])} places"},
                    "locations": [place(c["instances"][0])], "relatedLocations": [{"id": n, **place(i)} for n, i in enumerate(c["instances"][1:], 1)],
                    "partialFingerprints": {"cloneHash/v1": c["hash"]}, **({"baselineState": "unchanged" if c.get("baseline") else "new"} if "baseline_known" in report else {}),
                }
            )
    rules = [{"id": "DUPE001", "shortDescription": {"text": "Duplicated code"}}, {"id": "DUPE002", "shortDescription": {"text": "Code duplicated across test and production"}}]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}
    told = {k: report[k] for k in ("partial", "partial_reason", "baseline_known", "baseline_new") if k in report}
    if told:
        run["properties"] = told
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)


FORMATS = {"text": as_text, "json": as_json, "sarif": as_sarif, "md": as_markdown, "github": as_annotations}


def render(report: dict, fmt: str = "text", top: int = TOP) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}: one of {', '.join(FORMATS)}")
    return FORMATS[fmt](report, top) if fmt in ("text", "md") else FORMATS[fmt](report)
