"""Event reconstruction: session bars and halts -> facts -> timelines around anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import timeline_id
from ..operators.bars import MINUTE, SESSION, BarClock
from ..operators.detectors import DEFAULTS, DetectorSettings, all_facts
from ..operators.timelines import reconstruct


def reconstruct_sessions(
    anchors: DataFrame, bars: DataFrame, halts: DataFrame | None = None, *,
    pre_bars: int = 30, post_bars: int = 120, anchor_kind: str = "NEWS",
    settings: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE,
) -> DataFrame:
    """Timelines for anchors (symbol, session, anchor_ts).

    Detectors run once per session that has an anchor, over the whole session, before any
    window is cut. An anchor without bars keeps just its own event.
    """
    wanted = bars.join(anchors.select(*SESSION).distinct(), SESSION, "left_semi")
    facts = all_facts(wanted, halts, settings, clock)
    named = anchors.withColumns({
        "timeline_id": timeline_id(F.col("symbol"), F.col("anchor_ts")), "anchor_kind": F.lit(anchor_kind)})
    unit = "minute" if clock.unit_seconds < 86_400 else "day"
    return reconstruct(named, facts, SESSION, pre_seconds=pre_bars * clock.unit_seconds,
                       post_seconds=post_bars * clock.unit_seconds, phase_unit=unit)
