"""Settings of the phasing plan. The defaults users of such pipelines expect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Observing:
    min_baseq: int = 13
    min_mapq: int = 20
    default_baseq: int = 0
    eps_floor: float = 1e-4
    eps_ceiling: float = 0.49
    mapq_cap: int = 60
    dedup: bool = True
    scan: str = "read"
    max_depth: int = 8000


@dataclass(frozen=True)
class Risk:
    """Weights of an edge's risk and the distance that counts as far."""

    confidence: float = 0.40
    count: float = 0.15
    conflict: float = 0.15
    distance: float = 0.10
    domination: float = 0.20
    distance_norm: int = 1_000_000


@dataclass(frozen=True)
class Hard:
    """Tests of an edge that may merge sites; ``mode`` is confidence or risk."""

    mode: str = "risk"
    min_support: float = 2.0
    min_count: int = 2
    min_confidence: float = 0.65
    max_risk: float = 0.45
    max_distance: int = 1_000_000


@dataclass(frozen=True)
class Soft:
    """Tests of an edge that may couple blocks; ``mode`` is risk, or none for no soft edges."""

    mode: str = "risk"
    min_support: float = 1.0
    min_count: int = 1
    min_confidence: float = 0.55
    max_risk: float = 0.75
    scale: float = 0.25
    cap: float = 10.0


@dataclass(frozen=True)
class Collapse:
    norm: str = "sqrt_cap"
    cap: float = 10.0
    domination: float = 0.30


@dataclass(frozen=True)
class Solver:
    """``max_nodes`` is a limit of a component's size that is an error when passed; 0 sets none. A task holds
    ``task_values`` couplings by candidates at a time, or one candidate."""

    batch: int = 100
    iterations: int = 1000
    dt: float = 0.1
    seed: int = 23
    scale: float = 0.001
    noise: float = 0.003
    max_nodes: int = 0
    task_values: int = 4_000_000
    exact_blocks: int = 12


@dataclass(frozen=True)
class Contact:
    """Anchors of contact alignments, and edges between phase sets."""

    min_mapq: int = 20
    mapq_cap: int = 60
    keep_secondary: bool = False
    min_sites: int = 1
    min_score: float = 1.0
    alpha: float = 0.1
    min_contacts: int = 20
    min_confidence: float = 0.8
    min_abs_score: float = 0.0


@dataclass(frozen=True)
class Params:
    observing: Observing = Observing()
    risk: Risk = Risk()
    hard: Hard = Hard()
    soft: Soft = Soft()
    collapse: Collapse = Collapse()
    solver: Solver = Solver()
    contact: Contact = Contact()
    weighted: bool = False
