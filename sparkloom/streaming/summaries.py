"""The rolling summary's trigger on a live stream of turns: state of a bounded size for each conversation.

A conversation is due once it has more than `trigger` turns; then all but its last `keep` turns, of those that were not
handed out before, go to the summary. The state holds the number of distinct turns, the number of the last one that was
handed out, and the turns after it (kept + not yet due), each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "conv_id long, turn long, role string, part long"
_NONE = -(2**63)


class Summaries(StatefulProcessor):
    """Turns (conv_id, turn, role) of one conversation -> the turns that are due, with the number of the summary they
    are for (part).

    A turn that comes again, in the same batch or later, counts once. A turn that comes late, from before the last one
    that was handed out, counts no more: the summary it belongs to is written. A conversation that is silent for
    `idle` milliseconds loses its state.
    """

    def __init__(self, keep: int, trigger: int, idle: int):
        self.keep, self.trigger, self.idle = keep, trigger, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, after long, part long, timer long")
        self.open = handle.getMapState("open", "turn long", "role string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, after, part, timer = self.sums.get() if self.sums.exists() else (0, _NONE, 0, 0)
        for pdf in rows:
            for turn, role in zip(pdf["turn"].tolist(), pdf["role"].tolist()):
                if turn <= after:
                    continue
                n += not self.open.containsKey((turn,))
                self.open.updateValue((turn,), (role,))
        turns = sorted((k[0], v[0]) for k, v in self.open.iterator())
        due = turns[: -self.keep] if self.keep else turns
        if n > self.trigger and due:
            after, part = due[-1][0], part + 1
            for turn, _ in due:
                self.open.removeKey((turn,))
            said = [x for x in due if x[1] in ("user", "assistant")]
            if said:
                yield pd.DataFrame({"conv_id": [key[0]] * len(said), "turn": [t for t, _ in said], "role": [r for _, r in said], "part": [part] * len(said)})
        if timer:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(timer)
        self.sums.update((n, after, part, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def due_turns(turns: DataFrame, keep: int, trigger: int, idle_minutes: int = 24 * 60) -> DataFrame:
    """A stream of turns (conv_id, turn, role) -> the turns that summaries are due for: conv_id, turn, role, part.

    Needs the state store of RocksDB (spark.sql.streaming.stateStore.providerClass); a run over what is there and no more
    (availableNow) also needs spark.sql.streaming.noDataMicroBatches.enabled=false, for timers ask for batches without end. Rows without a conv_id or a turn
    are left out. Once every turn has come in order, the turns that were handed out are those of to_summarise().
    """
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"))
    return rows.groupBy("conv_id").transformWithStateInPandas(Summaries(keep, trigger, idle_minutes * 60_000), _OUT, "append", "processingTime")
