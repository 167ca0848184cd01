"""The derived input tables themselves, so that any drift between the engines shows up first."""

from __future__ import annotations

from inspect import unwrap

from cliploom import fixtures as fx

QUERIES = {
    f"table_{name}": (unwrap(getattr(fx, name)), fx.with_tables(name) + f"\nSELECT * FROM {name}")
    for name in (
        "words", "scenes", "frames", "media", "segments", "decisions", "plan_responses", "llm_calls", "jobs", "job_events",
    )
}
