"""Settings of a matching run, validated when they are made, and the registry of matchers."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class RuntimeConfig:
    """Event-time settings, in the time unit of the inputs (seconds for telemetry, days for the order tables)."""

    window: int = 360
    grid: int = 5
    tick: int = 5
    bound: int = 10
    margin: int = 120
    min_shared: int = 4
    start_weight: float = 0.10
    bucket: int = 600

    def __post_init__(self) -> None:
        for name in ("window", "grid", "tick", "bucket", "min_shared"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.bound < 0 or self.start_weight < 0:
            raise ValueError("bound and start_weight must not be negative")
        if self.window % self.grid:
            raise ValueError("window must be a multiple of grid")

    @property
    def points(self) -> int:
        return self.window // self.grid + 1


@dataclass(frozen=True)
class CostWeights:
    """Weights and shape of the waveform cost."""

    dtw: float = 1.0
    step: float = 0.40
    mean: float = 0.0
    band: int = 3
    segment: int = 12
    steps: int = 6


@dataclass(frozen=True)
class BayesConfig:
    """Settings of the posterior matcher; stages: (share of the prefix, power of the time prior)."""

    alpha: float = 1.0
    beta: float = 1.0
    eps: float = 1e-9
    mix: float = 0.35
    carry: float = 0.60
    current: float = 0.15
    stages: tuple[tuple[float, float], ...] = ((0.6, 1.0), (1.0, 0.2))

    def __post_init__(self) -> None:
        if not 0 <= self.mix <= 1 or not 0 <= self.current <= 1 or self.eps <= 0:
            raise ValueError("mix and current lie in 0..1, eps above 0")


@dataclass(frozen=True)
class Matcher:
    """One matcher: the cost it ranks by and the assignment it solves."""

    name: str
    cost: str
    assign: str
    weights: CostWeights = field(default_factory=CostWeights)
    bayes: BayesConfig = field(default_factory=BayesConfig)
    corr_weight: float = 1.0
    dtw_weight: float = 1.0
    prefixes: tuple[float, ...] = (1.0,)


_W, _B = CostWeights(), BayesConfig()

MATCHERS = {
    m.name: m
    for m in (
        Matcher("time_only", "time", "optimal"),
        Matcher("single_only", "waveform", "greedy"),
        Matcher("nomura_original_hungarian", "similarity", "optimal"),
        Matcher("bayesian_windowed", "posterior", "optimal"),
        Matcher("two_prefix_greedy", "waveform", "greedy", prefixes=(0.6, 1.0)),
        Matcher("two_prefix_hungarian", "waveform", "optimal", prefixes=(0.6, 1.0)),
        Matcher("single_only_step_off", "waveform", "greedy", weights=replace(_W, step=0.0)),
        Matcher("single_only_dtw_off", "waveform", "greedy", weights=replace(_W, dtw=0.0)),
        Matcher("single_only_all_off", "time", "optimal"),
        Matcher("nomura_original_hungarian_dtw_off", "similarity", "optimal", dtw_weight=0.0),
        Matcher("nomura_original_hungarian_corr_off", "similarity", "optimal", corr_weight=0.0),
        Matcher("nomura_original_hungarian_all_off", "time", "optimal"),
        Matcher("bayesian_windowed_memory_off", "posterior", "optimal", bayes=replace(_B, carry=0.0)),
        Matcher("bayesian_windowed_timeprior_off", "posterior", "optimal", bayes=replace(_B, stages=((0.6, 0.0), (1.0, 0.0)))),
        Matcher("bayesian_windowed_all_off", "posterior", "optimal", bayes=replace(_B, carry=0.0, stages=((0.6, 0.0), (1.0, 0.0)))),
    )
}
ALIASES = {"proposed_full": "single_only"}


def matchers(names: list[str]) -> list[Matcher]:
    """The matchers of these names or aliases, in their order without repeats; unknown names raise ValueError."""
    out: dict[str, Matcher] = {}
    for name in names:
        key = ALIASES.get(name.strip(), name.strip())
        if key not in MATCHERS:
            raise ValueError(f"unknown matcher: {name}")
        out.setdefault(key, MATCHERS[key])
    if not out:
        raise ValueError("no matcher named")
    return list(out.values())
