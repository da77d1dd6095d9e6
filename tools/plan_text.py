"""Plan text helpers shared by the plan tests and tools/plan_stats.py."""

import re


def live_plan(plan: str) -> str:
    """Plan text with every persisted product's subtree kept once.

    A materialised ``InMemoryRelation`` prints its cached plan again wherever it
    is read (and inside every product built on it); that work is done once per
    session, so later copies are cut to the relation line. A finished adaptive
    plan also prints its initial plan, which is not run."""
    out, seen, skip_depth = [], set(), None
    for line in plan.split("\n"):
        depth = re.match(r"^[\s:+\-|]*", line).end()
        if skip_depth is not None:
            if depth > skip_depth:
                continue
            skip_depth = None
        body = line[depth:]
        if body.startswith("== Initial Plan =="):   # AQE prints the pre-runtime plan as well;
            skip_depth = depth - 1                  # its root sits at the marker's depth
            continue
        if body.startswith("InMemoryRelation"):
            key = re.sub(r"#\d+", "", body)
            if key in seen:
                skip_depth = depth
            seen.add(key)
        out.append(line)
    return "\n".join(out)
