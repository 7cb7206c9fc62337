"""Micro-batch variants: change streams per track with state bounded by the tracks alive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def label_changes(stream: DataFrame, track: str, order: str, label: str, forget_ms: int | None = None) -> DataFrame:
    """Rows whose label differs from their track's last emitted one; state is one label a track.

    With ``forget_ms`` tracks that are silent for so long are forgotten, so state
    stays bounded by the tracks alive, and their next label is emitted again.
    Labels are compared in ``order`` within a micro-batch; a null label is a label.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        fresh, last = not state.exists, state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[label], strict=True):
            v = None if v != v else v
            if fresh or v != last:
                out.append((key[0], o, v))
                fresh, last = False, v
        state.update((last,))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=[track, order, label])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{track} {kinds[track]}, {order} {kinds[order]}, {label} {kinds[label]}"
    return stream.select(track, order, label).groupBy(track).applyInPandasWithState(run, schema, f"last {kinds[label]}", "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")
