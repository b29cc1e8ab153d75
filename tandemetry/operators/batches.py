"""Batches of sorted rows, cut so that no key goes on in the next one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(part: pa.RecordBatch, keys: int = 2) -> np.ndarray:
    """The rows whose first ``keys`` columns aren't those of the row before; nulls are alike."""
    apart = np.zeros(max(0, part.num_rows - 1), bool)
    for c in part.columns[:keys]:
        code = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        apart |= code[1:] != code[:-1]
    return np.flatnonzero(apart) + 1


def whole(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of whole keys: a task holds one batch and one key's rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = not held or any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys))
        cuts = changes(batch, keys)
        cut = int(cuts[-1]) if len(cuts) else 0
        if held and (new or cut):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)
