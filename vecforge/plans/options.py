"""Options of index building and searching, in place of environment variables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BuildOptions:
    """m: links of a node above level 0 (twice as many there); shard: vectors of one graph."""

    metric: str = "l2"
    m: int = 16
    ef_construction: int = 200
    seed: int = 100
    shard: int = 20_000

    def __post_init__(self) -> None:
        if not 1 < self.m <= 10_000 or self.shard < 1:
            raise ValueError("m must be 2 to 10000 and shard positive")

    @property
    def ef(self) -> int:
        return max(self.ef_construction, self.m)


@dataclass(frozen=True)
class SearchOptions:
    """What changes results. mode(): two-stage with codes comes first, then batched rounds, then a beam, then best-first."""

    k: int = 10
    ef: int = 50
    two_stage: bool = False
    has_codes: bool = False
    refine_ef: int = 200
    pq_hybrid: bool = False
    beam_width: int = 1
    batch_io: int = 1
    strict: bool = False
    lockstep: bool = False

    def __post_init__(self) -> None:
        if self.k < 1 or self.ef < 1:
            raise ValueError("k and ef must be positive")

    def mode(self) -> str:
        if self.two_stage and self.has_codes:
            return "two_stage"
        if self.batch_io > 1:
            return "batch"
        return "beam" if self.beam_width > 1 else "best_first"

    @property
    def coarse(self) -> int:
        return max(self.ef, self.refine_ef)

    @property
    def width(self) -> int:
        """Candidates that a round takes against a fixed bound."""
        return self.batch_io if self.mode() == "batch" else self.beam_width
