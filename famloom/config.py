"""Engine parameters."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("original", "promote", "guarded")


@dataclass(frozen=True)
class Config:
    """Thresholds of the pipeline; coordinates are in base pairs."""

    #: Edge repair: none, always, or unless the element is reachable already.
    mode: str = "original"
    #: Stage-1 coverage: "single" (of the shorter interval) or "double" (of the longer).
    method: str = "single"
    #: Stage-1 coverage needed; None: 0.5 for single, 0.9 for double.
    cutoff: float | None = None
    #: Intervals overlap if they share more than this.
    min_overlap: int = 10
    #: Coverage needed when split intervals are clustered again.
    recluster: float = 0.5
    #: Share of an element that a full-length interval covers; one less this is the overlap that consistent intervals may have.
    full_length: float = 0.9
    #: How far a full-length interval's ends may fall short.
    slack: int = 10
    #: Elements of more images than this, with more images a partner than that, are tandem repeats.
    tandem_images: int = 500
    tandem_ratio: int = 5
    #: Vote clusters: width, and step from one vote to the next.
    vote_width: int = 20
    vote_step: int = 10
    #: Votes needed for each image that spans a boundary.
    span_factor: int = 2
    #: Boundaries this close are one; a boundary this close to an end moves the end.
    merge_distance: int = 10
    #: Intervals up to this length are dropped.
    too_short: int = 30
    #: Chains: gap that counts, and shortfall allowed.
    chain_gap: int = 10
    chain_shortfall: int = 30
    #: Primary edges of an element whose length is under this share of its partner's are partial.
    partial_ratio: float = 0.7
    #: Hops from a seed within which elements are redefined.
    clan_depth: int = 3

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.method not in ("single", "double"):
            raise ValueError("method must be single or double")

    @property
    def coverage(self) -> float:
        return self.cutoff if self.cutoff is not None else {"single": 0.5, "double": 0.9}[self.method]
