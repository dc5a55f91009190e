"""Parameters of a mining run."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

#: Tolerance of all comparisons with a threshold, and the floor of logarithms.
EPSILON, LOG_ZERO = 1e-10, -700.0


class Search(Enum):
    """Order in which itemsets are visited. Results are the same."""

    BREADTH_FIRST = "breadth_first"
    DEPTH_FIRST = "depth_first"
    BEST_FIRST = "best_first"
    ITERATIVE_DEEPENING = "iterative_deepening"


class Join(Enum):
    """How rows of an itemset meet the entries of their transaction."""

    TWO_POINTER = "merge"
    EXPONENTIAL = "shuffle_hash"
    BINARY = "broadcast"


class Collector(Enum):
    """How the best k are kept."""

    BASELINE = "baseline"
    SHARDED = "sharded"
    LAZY = "lazy"


def choice(kind: type[Enum], value: Enum | str) -> Enum:
    """An enum member by member, name or value, in any case."""
    if isinstance(value, kind):
        return value
    for x in kind:
        if str(value).strip().lower().replace("-", "_") in (x.name.lower(), x.value):
            return x
    raise ValueError(f"unknown {kind.__name__.lower()} {value!r}; one of {', '.join(x.name.lower() for x in kind)}")


@dataclass(frozen=True)
class Params:
    """``k`` itemsets of highest expected utility with an existential probability of at least ``min_prob``."""

    k: int
    min_prob: float
    search: Search = Search.BREADTH_FIRST
    join: Join = Join.TWO_POINTER
    collector: Collector = Collector.BASELINE
    debug: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.k, bool) or not isinstance(self.k, int) or self.k <= 0:
            raise ValueError(f"k must be a positive whole number, not {self.k!r}")
        if not 0 <= self.min_prob <= 1:  # False for NaN, too
            raise ValueError(f"min_prob must be between 0 and 1, not {self.min_prob!r}")
        for name, kind in (("search", Search), ("join", Join), ("collector", Collector)):
            object.__setattr__(self, name, choice(kind, getattr(self, name)))
