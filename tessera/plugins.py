"""Registry of named functions from DataFrame to DataFrame, run in order at named points of a plan."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


class Plugins:
    def __init__(self):
        self._stages: dict[str, list[tuple[str, Stage]]] = defaultdict(list)
        self._off: set[str] = set()

    def register(self, point: str, name: str, stage: Stage) -> None:
        if any(n == name for n, _ in self._stages[point]):
            raise ValueError(f"{name} is registered at {point}")
        self._stages[point].append((name, stage))

    def enable(self, name: str, on: bool = True) -> None:
        (self._off.discard if on else self._off.add)(name)

    def apply(self, point: str, df: DataFrame) -> DataFrame:
        """All enabled stages of the point, each on the result of the one before; one that fails to plan is logged and skipped."""
        for name, stage in self._stages[point]:
            if name not in self._off:
                try:
                    df = df.transform(stage)
                except Exception:  # noqa: BLE001 - a plugin must not end the plan
                    logging.getLogger(__name__).exception("plugin %s at %s", name, point)
        return df
