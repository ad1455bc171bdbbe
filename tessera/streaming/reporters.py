"""Receivers of events, as sinks of a stream.

An event is a row with ``type`` and what belongs to it.  A ``Reporter`` has a
method per type, all doing nothing; ``Fan`` hands events to several reporters;
``Handler`` passes the public types to one function.  ``sink`` makes a reporter
a sink for ``fan_out``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from ..operators.progress import PUBLIC_TYPES

#: fixed values: the types of event, each a method of a reporter
EVENT_TYPES = (
    "hardware", "initialization", "stage_progress", "crop_result", "encoding_config", "encoding_started", "encoding_progress", "validation_complete",
    "encoding_complete", "warning", "error", "operation_complete", "batch_started", "file_progress", "batch_complete", "verbose",
)


class Reporter:
    """Does nothing with any event; override the methods of interest."""

    def report(self, event: Row) -> None:
        if event["type"] in EVENT_TYPES:
            getattr(self, event["type"])(event)


for _type in EVENT_TYPES:
    setattr(Reporter, _type, lambda self, event: None)


class Fan(Reporter):
    """Hands each event to every reporter, in their order."""

    def __init__(self, *reporters: Reporter):
        self.reporters = reporters

    def report(self, event: Row) -> None:
        for r in self.reporters:
            r.report(event)


class Handler(Reporter):
    """Passes events of the public types on; what the function raises or returns
    is dropped."""

    def __init__(self, function: Callable[[Row], object]):
        self.function = function

    def report(self, event: Row) -> None:
        if event["type"] in PUBLIC_TYPES:
            try:
                self.function(event)
            except Exception:  # noqa: BLE001, S110
                pass


def sink(reporter: Reporter, order: str = "ord") -> Callable[[DataFrame, int], None]:
    """A sink that reports a micro-batch's rows in order, a partition at a time
    in the driver's memory."""

    def run(batch: DataFrame, epoch: int) -> None:
        for event in batch.orderBy(order).toLocalIterator():
            reporter.report(event)

    return run
