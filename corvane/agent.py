"""Extraction by an agent outside: units go out one by one, answers come back, and the end builds the index.

A session lives in the driver: it holds the ids of at most ``MAX_UNITS`` units; contents stay in the store's
frames until they are asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import extraction

#: Units of one session; the caller narrows the commits if there are more.
MAX_UNITS = 500
#: Seconds after which a session is over.
TIMEOUT = 30 * 60


class SessionError(RuntimeError):
    pass


@dataclass
class AgentSession:
    """``finish`` gets (text_unit_id, answer) of all accepted answers."""

    units: DataFrame
    finish: Callable[[DataFrame], dict]
    clock: Callable[[], float] = time.time
    ids: list[str] = field(init=False)
    answers: dict[str, str] = field(init=False, default_factory=dict)
    at: int = field(init=False, default=0)

    def __post_init__(self):
        found = self.units.select("id").distinct().orderBy("id").limit(MAX_UNITS + 1).collect()
        if len(found) > MAX_UNITS:
            raise SessionError(f"more than {MAX_UNITS} units; take fewer commits or larger units")
        self.ids = [r["id"] for r in found]
        self._began = self.clock()
        self._warned: int | None = None

    def _open(self) -> None:
        if self.clock() - self._began > TIMEOUT:
            raise SessionError("the session has run out of time")

    def next(self) -> dict:
        self._open()
        if self.at >= len(self.ids):
            return {"done": True, "extracted": len(self.answers), "total": len(self.ids)}
        unit = self.ids[self.at]
        content = self.units.where(F.col("id") == unit).select("content").first()[0]
        return {"done": False, "index": self.at, "total": len(self.ids), "text_unit_id": unit, "content": content}

    def submit(self, answer: str) -> dict:
        """Take an answer to the present unit. An answer that names nothing is asked for once more, then taken as empty."""
        self._open()
        if self.at >= len(self.ids):
            return {"accepted": False, "entities": 0, "relations": 0, "progress": f"{self.at}/{len(self.ids)}"}
        unit = self.ids[self.at]
        row = self.units.sparkSession.createDataFrame([(unit, answer)], "text_unit_id string, answer string")
        entities, relations = extraction.extracted_entities(row).count(), extraction.extracted_relations(row).count()
        out = {"accepted": True, "entities": entities, "relations": relations}
        if not entities and not relations and self._warned != self.at:
            self._warned = self.at
            return out | {"accepted": False, "progress": f"{self.at}/{len(self.ids)}", "warning": "no entity and no relation; send the same again if the unit has none"}
        self.answers[unit] = answer
        self.at += 1
        return out | {"progress": f"{self.at}/{len(self.ids)}"}

    def finalize(self) -> dict:
        self._open()
        if not self.answers:
            raise SessionError("nothing was submitted")
        return self.finish(self.units.sparkSession.createDataFrame(list(self.answers.items()), "text_unit_id string, answer string"))
