"""Read sessions: their states, who may advance them, and what readiness asks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("sweep", "verify", "consolidate", "complete")


class Conflict(ValueError):
    """The session changed since it was read."""


class NotReady(ValueError):
    """A precondition of the next state doesn't hold."""


@dataclass(frozen=True)
class Session:
    session_id: str
    state: str = "sweep"
    version: int = 0
    scope_version: int = 0


def readiness(files: DataFrame) -> dict[str, int]:
    """Counts of required files (requirement, state, waived, acknowledged) that stand in the way, in one pass."""
    required = F.col("requirement").isin("full", "symbol")
    open_ = required & (F.col("state") != "full") & ~F.col("waived")
    row = files.agg(
        F.count_if(required).alias("required"),
        F.count_if(open_ & (F.col("state") == "unserved")).alias("unserved"),
        F.count_if(open_ & (F.col("state") == "partial")).alias("partial"),
        F.count_if(required & (F.col("state") == "full") & ~F.col("acknowledged")).alias("unacknowledged"),
    ).first()
    return row.asDict()


def advance(session: Session, expected_version: int, counts: dict[str, int], observations: int) -> Session:
    """The session one state on; Conflict if its version is another, NotReady with what is missing."""
    if session.version != expected_version:
        raise Conflict(f"version {session.version}, expected {expected_version}")
    if session.state == "complete":
        raise NotReady("complete")
    missing = []
    if session.state == "sweep" and not counts["required"]:
        missing.append("nothing is required")
    if session.state in ("sweep", "verify") and counts["unserved"] + counts["partial"]:
        missing.append(f"{counts['unserved'] + counts['partial']} files not read")
    if session.state in ("verify", "consolidate") and counts["unacknowledged"]:
        missing.append(f"{counts['unacknowledged']} files not acknowledged")
    if session.state == "consolidate" and not observations:
        missing.append("no observation")
    if missing:
        raise NotReady("; ".join(missing))
    return replace(session, state=STATES[STATES.index(session.state) + 1], version=session.version + 1)


def next_item(files: DataFrame) -> DataFrame:
    """The next required file that isn't read whole: by requirement, then path."""
    rank = F.when(F.col("requirement") == "full", 0).when(F.col("requirement") == "symbol", 1).otherwise(2)
    return files.where("state <> 'full' AND NOT waived").orderBy(rank, "path").limit(1)
