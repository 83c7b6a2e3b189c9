"""Plans over streams: any `tables` entry of a plan may be a streaming DataFrame.

The plan language has bounded sources only, so nothing here adds windows or
watermarks; run() starts a plan whose operators Structured Streaming supports.
"""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..plans.compiler import Plan


def run(plan: Plan, checkpoint: str, name: str, output: str = "append") -> StreamingQuery:
    """Writes a plan over streaming tables to an in-memory table until the input at hand is done."""
    return plan.df.writeStream.format("memory").queryName(name).outputMode(output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
