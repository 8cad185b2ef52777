"""Architecture decision texts: six sections in a fixed order, bounded in size."""

from __future__ import annotations

import re

#: The sections, in order, and the most characters of a text.
SECTIONS = ("PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY")
MOST_CHARACTERS = 8000


def parse(text: str) -> dict[str, str]:
    """Section -> content; text before the first heading and unknown headings belong to
    what stands before them."""
    out: dict[str, str] = {}
    now = None
    for line in text.split("\n"):
        m = re.match(r"##\s+(\S+)\s*$", line)
        if m and m[1].upper() in SECTIONS:
            now = m[1].upper()
            out.setdefault(now, "")
        elif now:
            out[now] += line + "\n"
    return {k: v.strip() for k, v in out.items()}


def render(sections: dict[str, str]) -> str:
    """The sections in their order, others after them by name."""
    order = [*(s for s in SECTIONS if s in sections), *sorted(set(sections) - set(SECTIONS))]
    return "\n\n".join(f"## {name}\n{sections[name]}".rstrip() for name in order)


def validate(text: str) -> list[str]:
    """What is wrong with a text; nothing when it may be stored."""
    found = parse(text)
    wrong = [f"section {s} is missing" for s in SECTIONS if s not in found]
    if len(text) > MOST_CHARACTERS:
        wrong.append(f"{len(text)} characters, {MOST_CHARACTERS} at most")
    return wrong


def merge(text: str, changes: dict[str, str]) -> str:
    unknown = sorted(set(changes) - set(SECTIONS))
    if unknown:
        raise ValueError(f"no such section: {', '.join(unknown)}")
    return render(parse(text) | changes)
