"""Distributed training of dense weight vectors of fixed size: local passes in tasks, weighted averages between rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Weights that are averaged together; a multiple of every width.
BLOCK = 1 << 16


def train_averaged(examples: DataFrame, start: np.ndarray, local_pass: Callable[[np.ndarray, pa.Table, int], tuple[np.ndarray, np.ndarray]], rounds: int, width: int = BLOCK) -> np.ndarray:
    """Weights after `rounds` rounds: each task improves the round's weights on its rows, and the results are averaged.

    local_pass returns a task's weights and, for every `width` of them, how much it has to say on these: they are
    averaged by that, and keep their value where no task has a say. So what only one task has learned stays whole.
    A task holds its rows as Arrow data, so examples must be dealt over enough tasks. Averages are made block by block
    in the tasks; the driver gets one vector a round. Without rows the start stays.
    """
    weights = start.astype("f4")
    for number in range(rounds):
        shared = examples.sparkSession.sparkContext.broadcast(weights)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            held = [batch for batch in batches if batch.num_rows]
            if held:
                better, say = local_pass(shared.value.copy(), pa.Table.from_batches(held), number)
                for a in range(0, len(better), BLOCK):
                    own = np.minimum(say[a // width : -(-min(a + BLOCK, len(better)) // width)], 6e4).astype("<f2")  # half as much to move
                    if own.any():
                        parts = (pa.array([x], t) for x, t in ((a // BLOCK, pa.int32()), (own.tobytes(), pa.binary()), (np.asarray(better[a : a + BLOCK], "<f4").tobytes(), pa.binary())))
                        yield pa.RecordBatch.from_arrays(list(parts), ["block", "say", "weights"])

        def average(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for block, own, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    own, part = np.frombuffer(own, "<f2").astype("f8"), np.frombuffer(part, "<f4")
                    held = sums.setdefault(block, [0.0, 0.0])
                    held[0] = held[0] + own
                    held[1] = held[1] + np.repeat(own, width)[: len(part)] * part
            for block, (own, total) in sums.items():
                old = shared.value[block * BLOCK : (block + 1) * BLOCK]
                say = np.repeat(own, width)[: len(old)]
                mean = np.where(say > 0, total / np.maximum(say, 1e-30), old).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["block", "weights"])

        trained = examples.mapInArrow(train, "block int, say binary, weights binary")
        spread = trained.repartition(max(1, min(32, -(-len(weights) // BLOCK))), "block")
        weights = weights.copy()
        for r in spread.mapInArrow(average, "block int, weights binary").collect():
            weights[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["weights"], "<f4")
        shared.destroy()  # else each round's weights stay on every disk
    return weights
