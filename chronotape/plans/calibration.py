"""Triple-barrier calibration: bars -> entries -> touches -> cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import barriers as B
from ..operators.bars import MINUTE, BarClock
from ..session import cut_lineage


@dataclass
class CalibrationRun:
    entries: DataFrame
    touches: DataFrame
    cells: DataFrame
    candidates: DataFrame


def run_grid(bars: DataFrame, grid: B.Grid = B.Grid(), clock: BarClock = MINUTE) -> CalibrationRun:
    """The whole grid. The forward scan is the costly part and feeds several results, so its one
    row per entry is written to the checkpoint folder once."""
    entries = B.entries_with_atr(bars, clock)
    touches = cut_lineage(B.first_touches(entries, bars, grid, clock))
    cells = B.cell_metrics(touches, grid, clock)
    return CalibrationRun(entries, touches, cells, B.usable_cells(cells))
