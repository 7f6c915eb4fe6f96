"""All registries of the core."""

from __future__ import annotations

from weirflow.plans import budget, detect, diffs, files, ledger, parse_errors, people, queues, streams, views

REGISTRIES = [parse_errors.R, detect.R, views.R, budget.R, diffs.R, files.R, people.R, ledger.R, streams.R, queues.R]
