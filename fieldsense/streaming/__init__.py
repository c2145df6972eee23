"""Structured Streaming wrappers of the batch operators."""

from .calendar import calendar_stream
from .feed import changed_rows, feed_stream
from .ingest import ingest_stream, read_batches, write_ingest_batch
from .outbox import delivered, live_stream, write_messages
from .rollup import rollup_stream
from .state import latest_versions, live_state_rows, rejected_stream, state_runs_stream
from .sync import (ack_tick, acked_tick, aggregate_stream, aggregate_tick, answer_tick, notify_stream, sync_stream, sync_tick,
                   tick_stream)

__all__ = ["calendar_stream", "changed_rows", "delivered", "feed_stream", "live_stream", "write_messages",
           "ack_tick", "acked_tick", "answer_tick", "aggregate_stream", "aggregate_tick", "ingest_stream", "latest_versions", "live_state_rows", "notify_stream", "read_batches", "rollup_stream",
           "rejected_stream", "state_runs_stream", "sync_stream", "sync_tick", "tick_stream", "write_ingest_batch"]
