"""Settings: model parameters and portfolios."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SemanticsOptions:
    """Switches for what the public defaults do in a way that a user may not want; every default is theirs.

    trading_month_end: rebalance on a month's last trading day, not only on months whose
    last calendar day trades. pad_gaps: a missing price counts as the last known one. Without
    it the days of a gap and the day after it have no return. next_day: weights are in force
    from the day after their date, and its sample ends the day before it. peak_from_start:
    the money put in is the first peak, so a loss on the first day is a drawdown.
    alpha_over_rf: alpha is of returns over the risk-free rate. reweight: days on which
    assets lack a return are weighted by the others. relative_thresholds: chances of loss
    and gain are against the money put in.
    """

    trading_month_end: bool = False
    pad_gaps: bool = True
    next_day: bool = False
    peak_from_start: bool = False
    alpha_over_rf: bool = False
    reweight: bool = False
    relative_thresholds: bool = False


@dataclass(frozen=True)
class ModelParams:
    """Scalars that every workflow shares (fixed values of the public defaults)."""

    trading_days: int = 252
    risk_free: float = 0.04
    use_shrinkage: bool = True
    shrinkage: str = "ledoit_wolf"
    use_black_litterman: bool = True
    risk_aversion: float = 2.5
    tau: float = 0.05
    cost_bps: float = 10.0
    slippage_bps: float = 5.0
    apply_tax: bool = True
    short_term_rate: float = 0.35
    long_term_rate: float = 0.15
    long_term_fraction: float = 0.50
    gain_rate: float = 0.20
    implementation_layer: bool = False
    turnover_lambda: float = 0.50
    action_threshold: float = 0.005
    mc_years: int = 10
    mc_sims: int = 10_000
    mc_initial: float = 1.0
    mc_seed: int = 42
    walk_window: int = 252 * 3
    walk_freq: str = "ME"
    rolling_window: int = 252 * 5
    frontier_points: int = 50
    semantics: SemanticsOptions = SemanticsOptions()


@dataclass(frozen=True)
class Portfolio:
    """Universe in display order with starting and market weights, bounds, rules and views."""

    weights: dict[str, float]
    benchmark: str
    market_weights: dict[str, float] = field(default_factory=dict)
    bounds: tuple[float, float] = (0.0, 0.40)
    fixed: dict[str, float] = field(default_factory=dict)
    minimum: dict[str, float] = field(default_factory=dict)
    absolute_views: dict[str, tuple[float, float]] = field(default_factory=dict)
    relative_views: tuple = ()

    @property
    def assets(self) -> list[str]:
        return list(self.weights)

    @property
    def market(self) -> dict[str, float]:
        return self.market_weights or self.weights

    @property
    def universe(self) -> list[str]:
        """Assets, then the benchmark unless it is one of them."""
        return list(dict.fromkeys([*self.weights, self.benchmark]))


#: Portfolio of live quotes (fixed values).
LIVE = Portfolio(
    weights={"QQQ": 0.34, "MSFT": 0.09, "NVDA": 0.09, "AAPL": 0.07, "AVGO": 0.07, "AMZN": 0.07, "PLTR": 0.05, "ARKG": 0.05, "IWM": 0.06, "LMT": 0.06, "BA": 0.05},
    benchmark="SPY",
    fixed={"QQQ": 0.35},
    minimum={"IWM": 0.05, "LMT": 0.05},
    absolute_views={"QQQ": (0.14, 0.70), "MSFT": (0.15, 0.75), "NVDA": (0.18, 0.55), "AVGO": (0.16, 0.60), "AMZN": (0.14, 0.55), "PLTR": (0.17, 0.35), "ARKG": (0.13, 0.25), "IWM": (0.11, 0.45), "LMT": (0.10, 0.70), "BA": (0.12, 0.30)},
    relative_views=(("QQQ", "IWM", 0.03, 0.75), ("QQQ", "LMT", 0.04, 0.70), ("NVDA", "QQQ", 0.03, 0.55)),
)

#: Portfolio over the price panel of part types in the star schema.
PARTS = Portfolio(
    weights={"ECONOMY": 0.30, "LARGE": 0.20, "MEDIUM": 0.15, "PROMO": 0.15, "SMALL": 0.10, "STANDARD": 0.10},
    benchmark="MKT",
    market_weights={"ECONOMY": 0.20, "LARGE": 0.20, "MEDIUM": 0.20, "PROMO": 0.15, "SMALL": 0.15, "STANDARD": 0.10},
    fixed={"ECONOMY": 0.35},
    minimum={"SMALL": 0.05, "STANDARD": 0.05},
    absolute_views={"ECONOMY": (0.14, 0.70), "PROMO": (0.11, 0.45), "LARGE": (0.12, 0.30)},
    relative_views=(("ECONOMY", "SMALL", 0.03, 0.75),),
)

#: A target of PARTS for reports that compare two sets of weights.
PARTS_TARGET = {"ECONOMY": 0.35, "LARGE": 0.20, "MEDIUM": 0.10, "PROMO": 0.15, "SMALL": 0.104, "STANDARD": 0.096}
