"""Continuous training in foreachBatch: a micro-batch is an epoch, its model replaces the one before."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


@dataclass
class LatestModel:
    """The last model and the batch it came from; predictions before the first model wait."""

    model: object = None
    batch_id: int | None = None
    waiting: list[DataFrame] = field(default_factory=list)

    def train(self, fit: Callable[[DataFrame], object]) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, batch_id: int) -> None:
            if not batch.isEmpty():
                self.model, self.batch_id = fit(batch), batch_id

        return run

    def predict(self, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """Batches that come before the first model are kept in order and released by it."""

        def run(batch: DataFrame, batch_id: int) -> None:
            if self.model is None:
                # written out, since a batch's frame is not valid after its call
                from ..plans.lineage import cut_lineage

                self.waiting.append(cut_lineage(batch))
                return
            for held in self.waiting:
                sink(self.model.transform(held), batch_id)
            self.waiting.clear()
            sink(self.model.transform(batch), batch_id)

        return run

    def predict_then_train(self, fit: Callable[[DataFrame], object], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """Each batch is predicted by the model before it, then trains the next: an honest running error."""
        train, predict = self.train(fit), self.predict(sink)

        def run(batch: DataFrame, batch_id: int) -> None:
            kept = batch.persist()
            predict(kept, batch_id)
            train(kept, batch_id)
            kept.unpersist()

        return run


def start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
