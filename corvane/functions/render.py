"""Plain rendering of small results: tables and lists as text, numbers, ages, colours and link fragments."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from urllib.parse import parse_qsl, urlencode


def thousands(n: float) -> str:
    """1234567 -> 1,234,567; fractions keep two digits."""
    return f"{n:,.0f}" if float(n).is_integer() else f"{n:,.2f}"


def ago(days: float | None) -> str:
    """Age in words, by whole days, months of 30 and years of 365; unknown ages have no words."""
    if days is None:
        return "unknown"
    whole = int(max(0, days))
    for size, name in ((365, "year"), (30, "month"), (1, "day")):
        if whole >= size:
            n = whole // size
            return f"{n} {name}{'s' * (n > 1)} ago"
    return "today"


def elapsed(seconds: float) -> str:
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes}m {rest:02}s" if minutes else f"{seconds:.1f}s"


def with_alpha(colour: str, alpha: float) -> str:
    """#rrggbb and an opacity as rgba(...)."""
    r, g, b = (int(colour[i : i + 2], 16) for i in (1, 3, 5))
    return f"rgba({r}, {g}, {b}, {min(1.0, max(0.0, alpha)):g})"


def to_fragment(state: Mapping[str, str | None]) -> str:
    """A view's state as a link fragment; what is null or blank is left out."""
    return "#" + urlencode({k: v for k, v in state.items() if v})


def from_fragment(fragment: str) -> dict[str, str]:
    return dict(parse_qsl(fragment.lstrip("#")))


def _cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, (int, float)):
        return thousands(v)
    if isinstance(v, (list, tuple)):
        return ", ".join(map(_cell, v))
    return str(v).replace("|", "\\|").replace("\n", " ")


def markdown(rows: Iterable[Mapping], title: str | None = None, empty: str = "Nothing found.") -> str:
    """Rows as a markdown table with the columns of the first row."""
    rows = list(rows)
    head = [f"## {title}", ""] if title else []
    if not rows:
        return "\n".join([*head, empty])
    cols = list(rows[0])
    lines = [f"| {' | '.join(cols)} |", f"|{'---|' * len(cols)}"]
    return "\n".join([*head, *lines, *(f"| {' | '.join(_cell(r.get(c)) for c in cols)} |" for r in rows)])
