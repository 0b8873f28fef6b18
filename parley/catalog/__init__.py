"""All registered queries."""

from parley.catalog import chats, records, sampling, sources, store, streams, texts  # noqa: F401
from parley.catalog.base import ORACLES, QUERIES  # noqa: F401
