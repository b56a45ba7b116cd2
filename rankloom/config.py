"""Settings of a screening run."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Trading observations of each trailing return, and the name each has in exports.
HORIZON_NAMES: dict[int, str] = {
    5: "5 days ret",
    15: "15 Days Returns",
    21: "1M Return",
    42: "2 months Ret.",
    63: "3M Return",
    84: "4 Months Ret.",
    126: "6M Return",
    252: "1Y Return",
    756: "3Y R",
    1260: "5Y Return",
}
HORIZONS: tuple[int, ...] = tuple(HORIZON_NAMES)

#: Default weights by horizon, and the horizons whose return must be positive.
DEFAULT_WEIGHTS: dict[int, float] = {5: 0.15, 15: 0.15, 21: 0.20, 42: 0.20, 63: 0.20, 126: 0.10}
DEFAULT_GATE: tuple[int, ...] = (5, 15, 21)

#: Benchmark labels with the symbols to try in order.
BENCHMARKS: dict[str, tuple[str, ...]] = {
    "Nifty 50": ("^NSEI",),
    "Nifty Midcap": ("^NSEMDCP50", "^CNXMDCP", "NIFTY_MIDCAP_100.NS"),
}

#: The rows of the holding table that belong to each kind of holder.
HOLDER_LABELS: dict[str, tuple[str, ...]] = {
    "FII": ("FIIs", "FII", "Foreign Institutional", "Foreign Portfolio"),
    "DII": ("DIIs", "DII", "Domestic Institutional", "Domestic Institutions"),
}
SALES_LABELS = ("Sales", "Revenue", "Operating Revenue")
PROMOTER_LABELS = ("Promoters", "Promoter")

INITIAL_CAPITAL = 100_000.0
#: Rupees in a crore.
CRORE = 10_000_000.0


#: What interactive settings may be, as (least, most).
RANGES: dict[str, tuple[int, int]] = {"backtest_months": (1, 36), "top_momentum": (10, 500), "final_count": (10, 200)}


@dataclass(frozen=True)
class FundamentalThresholds:
    """Bounds are inclusive; the last is on the absolute change."""

    min_market_cap_cr: float = 1500.0
    min_quarterly_growth_pct: float = 10.0
    min_annual_growth_pct: float = 15.0
    max_promoter_change_pct: float = 5.0


@dataclass(frozen=True)
class ScreeningConfig:
    """All parameters of a run, with the ranges that inputs are checked against."""

    weights: dict[int, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    gate: tuple[int, ...] = DEFAULT_GATE
    thresholds: FundamentalThresholds = field(default_factory=FundamentalThresholds)
    top_momentum: int = 100
    final_count: int = 100
    price_batch_size: int = 80
    backtest_months: int = 6
    initial_capital: float = INITIAL_CAPITAL

    def __post_init__(self) -> None:
        unknown = (set(self.weights) | set(self.gate)) - set(HORIZONS)
        if unknown:
            raise ValueError(f"no such horizons: {sorted(unknown)}")
        for name, low in (("top_momentum", 1), ("final_count", 1), ("price_batch_size", 1), ("backtest_months", 1)):
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be at least {low}")

    @classmethod
    def within_ranges(cls, **settings: object) -> ScreeningConfig:
        """A configuration from interactive settings: numbers outside their range are moved to its end."""
        for name, (least, most) in RANGES.items():
            if name in settings:
                settings[name] = min(max(int(settings[name]), least), most)
        return cls(**settings)
