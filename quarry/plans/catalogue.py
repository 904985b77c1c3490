"""All registered queries and their DuckDB SQL."""

from quarry.plans import chunking, datasets, documents, evaluation, extensions, ingest, retrieval, sampling, text, tree  # noqa: F401
from quarry.plans.register import OPERATORS, ORACLES, QUERIES  # noqa: F401
