"""A registry of tools by name and by the intents they handle (X02), applied to rows of requests."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Handler = Callable[[DataFrame], DataFrame]


class Tool(NamedTuple):
    name: str
    description: str
    handler: Handler
    intents: tuple[str, ...]


class Tools:
    """Tools in the order of their registration; a name that comes again takes the place of the first."""

    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def register(self, name: str, description: str, *intents: str) -> Callable[[Handler], Handler]:
        def add(handler: Handler) -> Handler:
            self.tools[name] = Tool(name, description, handler, intents)
            return handler

        return add

    def for_intent(self, intent: str) -> list[Tool]:
        return [x for x in self.tools.values() if intent in x.intents]

    def name_for(self, intent: Column, wanted: Column | None = None) -> Column:
        """The tool of each row: the wanted one if it handles the intent, else the first that does; null if none does."""
        known = sorted({i for x in self.tools.values() for i in x.intents})
        out = F.lit(None).cast("string")
        for i in known:
            mine = self.for_intent(i)
            chosen = F.when(wanted.isin(*[x.name for x in mine]), wanted).otherwise(mine[0].name) if wanted is not None else F.lit(mine[0].name)
            out = F.when(intent == i, chosen).otherwise(out)
        return out

    def run(self, requests: DataFrame, intent: Column, wanted: Column | None = None) -> DataFrame:
        """`tool` and what the tool's handler makes of the rows that are its own; all handlers must give the same columns. Rows of no tool are left out."""
        routed = requests.withColumn("tool", self.name_for(intent, wanted))
        out = None
        for tool in self.tools.values():
            made = tool.handler(routed.filter(F.col("tool") == tool.name).drop("tool")).withColumn("tool", F.lit(tool.name))
            out = made if out is None else out.unionByName(made)
        if out is None:
            raise ValueError("no tools")
        return out
