"""The corpus pipeline of siftwell.llm.pipeline, where the driver looks for it."""

from siftwell.llm import shared  # noqa: F401
from siftwell.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
