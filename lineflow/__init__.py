"""Numbered text lines on Spark: generate, parse, sort, merge."""

from lineflow.functions import *  # noqa: F403
from lineflow.operators import *  # noqa: F403
from lineflow.plans import *  # noqa: F403
from lineflow.sinks import *  # noqa: F403
from lineflow.sources import *  # noqa: F403
from lineflow.streaming import *  # noqa: F403
from lineflow.workspace import clear_scratch, materialize, release, scratch_path  # noqa: F401
