"""Reading a question: search terms and whether it is about a detail or the whole."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning.
STOP_WORDS = set(
    """a an the is are was were be been being have has had do does did will would could should may might can shall
    i me my we our you your he she it they them their this that these those who what where when why how
    not no nor but or and if then than so as in on at to for of with by from about""".split()
)

# Shapes of questions about a detail, then of questions about the whole; the first that fits decides.
LOCAL_PATTERNS = [
    r"who (knows|owns|maintains|wrote|created|built|works on|is responsible)",
    r"who (has been|is|was) (working|contributing|committing)",
    r"which (people|developers|engineers|contributors|authors)",
    r"find.*(expert|owner|author|maintainer)",
    r"what (does|is) (the|this) .* (module|file|component|service)",
    r"show.*(coupling|dependencies|imports)",
    r"when (did|was|were) .* (added?|created?|introduced?|removed?|changed?)",
    r"where is",
    r"blame",
]
GLOBAL_PATTERNS = [
    r"why did (we|the team|they)",
    r"what('s| is| was| were) the .*(strategy|approach|philosophy|policy|convention)",
    r"what (was|were) the (reason|decision|motivation)",
    r"how did .* (evolve|change|migrate|grow)",
    r"how (does|do|is|are) .* (organized|structured|laid out)",
    r"history of",
    r"overview of",
    r"summarize|summary of|describe the",
    r"tell me about the (architecture|codebase|system|project|repo)",
    r"what are the (main|key|major|primary) ",
    r"what(?:'s| is| are)? (?:the |our )?(technologies|tech|tools|stack|frameworks|languages)",
    r"what patterns",
    r"big picture|bird.?s?.?eye|high.?level",
]
SHORT_TERM = 6


def terms(query: str) -> list[tuple[str, bool]]:
    """(term in lower case, whether it is a prefix): words and the parts of camelCase, without stop words and single letters."""
    out: dict[str, None] = {}
    for word in regex.findall(r"[\p{L}\p{N}]+", query):
        parts = regex.split(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", word)
        for p in ([word, *parts] if len(parts) > 1 else [word]):
            out.setdefault(p)
    kept = dict.fromkeys(t.lower() for t in out if len(t) > 1 and t.lower() not in STOP_WORDS)
    return [(t, len(t) < SHORT_TERM) for t in kept]


def classify(question: str) -> str:
    for kind, patterns in (("local", LOCAL_PATTERNS), ("global", GLOBAL_PATTERNS)):
        if any(re.search(p, question, re.I) for p in patterns):
            return kind
    return "local"


def classify_column(c: Column) -> Column:
    """The same decision as a column, in the JVM."""
    out = None
    for kind, patterns in (("local", LOCAL_PATTERNS), ("global", GLOBAL_PATTERNS)):
        for p in patterns:
            hit = c.rlike("(?i)" + p)
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("local")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
