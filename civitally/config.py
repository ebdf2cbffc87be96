"""Tunable parameters. Detector constants are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Skew:
    """How group operators treat hot groups.

    A group with more than ``hot_rows`` rows (and more than one in ``most_hot`` of
    all rows) is never handled by one task: its rows are salted for joins and
    binned by value for ranks. The list of hot groups is the only thing broadcast
    by those operators; it cannot hold more than ``most_hot`` keys. Statistics of
    at most ``sent_rows`` groups are broadcast instead.
    """

    hot_rows: int = 100_000
    most_hot: int = 100_000
    sent_rows: int = 100_000
    bin_bits: int = 16


PEER_KEYS = ("STATE_NAME", "WORK_CATEGORY", "ACTIVITY_NAME")
MIN_PEERS = 10


@dataclass(frozen=True)
class RuleConfig:
    min_peers: int = MIN_PEERS
    peer_ratio: tuple[float, float] = (2.0, 5.0)
    peer_z: tuple[float, float] = (3.0, 5.0)
    payment_count: tuple[int, int] = (5, 10)
    vendor_count: tuple[int, int] = (5, 10)
    per_30_days: tuple[float, float] = (3.0, 6.0)
    in_progress_ratio: float = 0.50
    completeness: float = 0.50
    payment_cap: int = 30
    medium: int = 30
    high: int = 60


@dataclass(frozen=True)
class StatConfig:
    min_peers: int = MIN_PEERS
    peer_ratio: float = 5.0
    upper_tail: tuple[float, float] = (0.99, 0.995)
    fences: tuple[float, float] = (1.5, 3.0)
    low_completeness: float = 0.10
    payment_cap: int = 35
    medium: int = 30
    high: int = 60


@dataclass(frozen=True)
class FusionConfig:
    rule_weight: float = 0.35
    stat_weight: float = 0.35
    ml_weight: float = 0.30
    bonus_three: float = 10.0
    bonus_two: float = 5.0
    tiers: tuple[float, float, float] = (90.4, 56.5, 35.0)
    cap: bool = True
    min_peers: int = MIN_PEERS
    verification_only: bool = False


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 300
    sample: int = 256
    seed: int = 42
    contamination: float | str = "auto"
    max_features: float = 1.0
    min_peers: int = MIN_PEERS
    mask_weak_peers: bool = True


@dataclass(frozen=True)
class Settings:
    skew: Skew = field(default_factory=Skew)
    rules: RuleConfig = field(default_factory=RuleConfig)
    stats: StatConfig = field(default_factory=StatConfig)
    fusion: FusionConfig = field(default_factory=FusionConfig)
    forest: ForestConfig = field(default_factory=ForestConfig)
    peer_keys: tuple[str, ...] = PEER_KEYS
    normalize_activity: bool = False
