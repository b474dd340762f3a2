"""Shapes of messages as DDL."""

from __future__ import annotations

#: A message of the candle stream.
STREAM_MESSAGE = (
    "topic string, data array<struct<start: bigint, open: string, high: string, low: string, close: string, volume: string, turnover: string, confirm: boolean>>"
)
