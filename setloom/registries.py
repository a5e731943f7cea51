"""Open lists of named functions: a metric, a model or a strategy added to one takes part wherever the list is used."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

F = TypeVar("F", bound=Callable)


class Registry(dict[str, Callable]):
    """Functions by name, in the order in which they were added."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def add(self, name: str) -> Callable[[F], F]:
        """A decorator that adds a function under a name that isn't taken."""

        def put(f: F) -> F:
            if name in self:
                raise ValueError(f"{self.kind} {name!r} is there already")
            self[name] = f
            return f

        return put


#: Metrics of a window and set: () -> an aggregate column over its number profiles (see operators/cache.py).
METRICS = Registry("metric")
#: Strategies of the daily run: (strategy inputs) -> picks (see plans/daily.py).
STRATEGY_PICKS = Registry("strategy")
metric, strategy = METRICS.add, STRATEGY_PICKS.add


def add_model(name: str, weights: dict[str, float]) -> None:
    """A scoring model over the seven dimensions; its weights add up to 1."""
    from .model import SEVEN_MODELS

    if name in SEVEN_MODELS:
        raise ValueError(f"model {name!r} is there already")
    if set(weights) != set(SEVEN_MODELS["standard"]) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError(f"model {name!r}: weights of the seven dimensions that add up to 1")
    SEVEN_MODELS[name] = {k: float(weights[k]) for k in SEVEN_MODELS["standard"]}
