"""Model and run parameters, with the reference defaults as keyword values."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DPMParams:
    # Model: x | c=k ~ N(phi_k, E*I), phi_k ~ N(0, S*I).
    E: float = 1.0  # variance inside a cluster
    S: float = 100.0  # variance between centres
    # Fixed values of the reference (defaults): K-means iterations, initial
    # concentrations, candidates per point, sweeps per round (local, global), Gamma
    # prior of the concentrations. A summary always has one candidate.
    kmeans_iters: int = 10
    gamma0: float = 1.0
    alpha0: float = 1.0
    local_candidates: int = 3
    local_sweeps: int = 10
    global_sweeps: int = 40
    #: batch merge: end before global_sweeps after so many sweeps without a move (None: never)
    quiet_sweeps: int | None = None
    conc_a: float = 1.0
    conc_b: float = 0.5
    # Choices where the reference is ambiguous or buggy (see README "Decisions").
    assign: str = "argmax"  # or "sample": draw the label from the posterior
    concentration: str = "rate"  # or "scale": the reference's Gamma parametrisation
    seed: int = 0

    def with_(self, **kw) -> "DPMParams":
        return replace(self, **kw)

    def validate(self) -> "DPMParams":
        if not (self.E > 0 and self.S > 0):
            raise ValueError("E and S must be positive")
        if self.assign not in ("argmax", "sample"):
            raise ValueError("assign must be 'argmax' or 'sample'")
        if self.concentration not in ("rate", "scale"):
            raise ValueError("concentration must be 'rate' or 'scale'")
        if self.quiet_sweeps is not None and self.quiet_sweeps < 1:
            raise ValueError("quiet_sweeps must be at least 1, or None")
        if self.local_candidates < 1:
            raise ValueError("need at least one local candidate")
        return self
