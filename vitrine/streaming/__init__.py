"""Structured Streaming: event feeds into tables, sessions, rate limits and breakers."""

from .feeds import click_rates, expiring_sessions, latency_sketches, read_events, read_upserts, request_breakers, timed_breakers, too_many_requests, upsert_stream

__all__ = ["click_rates", "expiring_sessions", "latency_sketches", "read_events", "read_upserts", "request_breakers", "timed_breakers", "too_many_requests", "upsert_stream"]
