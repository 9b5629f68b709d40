"""Result rows as text: a grid whose widths are in bytes, lines, or JSON."""

from __future__ import annotations

import json


def grid(headers: list[str], rows: list[list]) -> str:
    cells = [[str(x) for x in headers], *[["" if x is None else str(x) for x in r] + [""] * (len(headers) - len(r)) for r in rows]]
    widths = [max(len(r[i].encode()) for r in cells) for i in range(len(headers))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "| " + " | ".join(x + " " * (w - len(x.encode())) for x, w in zip(r, widths)) + " |"
    return "\n".join([rule, line(cells[0]), rule, *[line(r) for r in cells[1:]], rule])


def as_json(values) -> str:
    return json.dumps(values, indent=2, ensure_ascii=False)


def item(info: dict | None, verbose: bool) -> str:
    """The text form of an item's details."""
    if info is None:
        return "<item not found>"
    out = [f"Item: {info['name']}", f"Id: {info['id']}", f"Kind: {info['kind']}", f"Vis: {info['visibility']}", f"Location: {info['path']}:{info['line_start']}-{info['line_end']}"]
    if verbose and info["code"] is not None:
        out.append(f"\n--- code ---\n{info['code']}\n--- end code ---")
    gap = "\n"
    for title, edges in (("Callers", info["inbound"]), ("Callees", info["outbound"])):
        if not verbose or not edges:
            out.append(f"{gap}{title}: " + (", ".join(e["id"] for e in edges) or "<none>"))
        else:
            out += [f"{gap}{title}:", *[f"- [{e['relation']}] {e['name']} ({e['id']}) @ {e['path']} :: {e['context']}" for e in edges]]
        gap = "\n" if verbose else ""
    return "\n".join(out)
