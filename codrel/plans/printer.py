"""Text form of algebra plans."""

from __future__ import annotations


def render(plan: tuple, depth: int = 0) -> str:
    if not plan:
        return "  " * depth + "data"
    head, detail = plan[0], plan[1] if len(plan) > 1 else None
    children = plan[2:]
    if head == "project":
        said = f"project {', '.join(detail) or '(no columns)'}"
    elif head == "rename":
        said = f"rename {detail[0]} to {detail[1]}"
    elif head == "equijoin":
        said = f"equijoin on {detail[0]} = {detail[1]}"
    else:
        said = head if detail is None else f"{head} {detail}"
    return "\n".join(["  " * depth + said, *(render(c, depth + 1) for c in children)])
