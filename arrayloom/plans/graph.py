"""The plan of a query as a task graph, and its summary."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def nodes(df: DataFrame) -> list[tuple[int, str]]:
    """(depth, operator) of the physical plan, in order."""
    text = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in text.splitlines():
        if m := re.match(r"([\s:|+\-]*)(?:\*\(\d+\) )?(\w+)", line):
            out.append((len(m[1]), m[2]))
    return out


def dot(df: DataFrame) -> str:
    """The physical plan in the dot language, edges from inputs to outputs."""
    rows, stack, lines = nodes(df), [], ["digraph plan {"]
    for k, (depth, name) in enumerate(rows):
        lines.append(f'  n{k} [label="{name}"];')
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack:
            lines.append(f"  n{k} -> n{stack[-1][1]};")
        stack.append((depth, k))
    return "\n".join([*lines, "}"])


def summary(df: DataFrame) -> dict[str, int]:
    """How many operators, exchanges, broadcasts and scans the plan has."""
    names = [name for _, name in nodes(df)]
    return {
        "operators": len(names),
        "exchanges": sum(n == "Exchange" for n in names),
        "broadcasts": sum(n == "BroadcastExchange" for n in names),
        "scans": sum("Scan" in n for n in names),
    }
