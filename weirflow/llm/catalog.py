"""All registries of this subpackage."""

from __future__ import annotations

from weirflow.llm import credential_queries, encoding_queries, lookalike_queries, personal_queries, sourcefile_queries, token_queries, truncation_queries

REGISTRIES = [lookalike_queries.R, personal_queries.R, encoding_queries.R, credential_queries.R, sourcefile_queries.R, truncation_queries.R, token_queries.R]
