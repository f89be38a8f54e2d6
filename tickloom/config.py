"""Defaults of the engine, one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Parameters of scans, scoring and the ledger; ``Config()`` has the defaults."""

    #: Bar roles of the ladder: name, minutes of a bar, swing neighbours, least bars.
    roles: tuple[tuple[str, int, int, int], ...] = (("15M", 15, 2, 20), ("1H", 60, 3, 52), ("4H", 240, 3, 52), ("1D", 1440, 5, 52), ("1W", 10080, 5, 52))
    fetch_bars: int = 200
    min_score: int = 45
    trade_expiry_hours: int = 48
    macd: tuple[int, int, int] = (12, 26, 9)
    ema: tuple[int, int] = (20, 50)
    timezone: str = "Europe/Paris"
    atr_stop: float = 1.5
    atr_target: float = 3.0
    block_tolerance: float = 0.005
    gap_least: float = 0.001
    block_lookback: int = 20
    sweep_lookback: int = 20
    gap_age: int = 50
    start_capital: float = 10_000.0
    #: Names one instrument has at brokers, in order of preference.
    symbol_variants: tuple[str, ...] = ("XAUUSDxx", "XAUUSDm", "XAUUSD", "GOLD", "XAUUSDc", "XAUUSD.", "XAU/USD")
    #: Days of US rate statements and of US consumer price releases.
    rate_days: tuple[str, ...] = (
        "2025-01-29", "2025-03-19", "2025-05-07", "2025-06-18", "2025-07-30", "2025-09-17", "2025-10-29", "2025-12-10",
        "2026-01-28", "2026-03-18", "2026-05-06", "2026-06-17", "2026-07-29", "2026-09-16", "2026-10-28", "2026-12-09",
    )
    price_days: tuple[str, ...] = (
        "2025-01-15", "2025-02-12", "2025-03-12", "2025-04-10", "2025-05-13", "2025-06-11", "2025-07-15", "2025-08-12",
        "2025-09-10", "2025-10-15", "2025-11-12", "2025-12-10", "2026-01-14", "2026-02-11", "2026-03-11", "2026-04-08",
        "2026-05-13", "2026-06-10", "2026-07-15", "2026-08-12", "2026-09-09", "2026-10-14", "2026-11-11", "2026-12-09",
    )
    killzones: tuple[tuple[str, int, int], ...] = (("London Open", 6, 10), ("NY AM", 11, 16))
    #: Gates and sizes: losses in percent, trades open at once, minutes after a stop, hours of the day without trades.
    day_loss_cap: float = -3.0
    week_loss_cap: float = -6.0
    max_open: int = 15
    least_reward: float = 2.0
    cooldown_minutes: int = 40
    block_hours: tuple[int, ...] = ()
    base_size: float = 5000.0
    kelly_cap: float = 0.25
    target_shares: tuple[float, ...] = (0.33, 0.67, 1.0)
    size_factors: tuple[float, float, float] = (0.5, 1.0, 1.5)
    weights_filter: tuple[float, float] = (0.4, 0.6)
    weights_composite: tuple[float, float, float] = (0.35, 0.35, 0.30)
    thresholds_filter: dict[str, int] = field(default_factory=lambda: {"peak": 60, "high": 65, "secondary": 75, "closed": 100})
    thresholds_composite: dict[str, int] = field(default_factory=lambda: {"peak": 50, "high": 52, "secondary": 58, "closed": 100})


DEFAULT = Config()


def load(path: str, base: Config = DEFAULT) -> Config:
    """*base* with what a JSON file of strategy parameters sets: composite weights and thresholds, gap age, gates and sizes; a missing file is *base*."""
    import json
    from dataclasses import replace
    from pathlib import Path

    if not Path(path).exists():
        return base
    data = json.loads(Path(path).read_text())
    out = {}
    composite = data.get("composite_decision", {})
    if "fire_thresholds" in composite:
        out["thresholds_composite"] = {k: int(v) for k, v in composite["fire_thresholds"].items()}
    weights = [v for k, v in sorted(composite.items()) if k.endswith("_weight")]
    if {"ml_weight", "smc_weight"} <= composite.keys() and len(weights) == 3:
        analyst = next(v for k, v in composite.items() if k.endswith("_weight") and k not in ("ml_weight", "smc_weight"))
        out["weights_composite"] = (composite["ml_weight"], analyst, composite["smc_weight"])
    gap = data.get("smc_parameters", {}).get("fair_value_gap", {})
    if "max_lookback" in gap:
        out["gap_age"] = int(gap["max_lookback"])
    gates, sizes = data.get("risk_gates", {}), data.get("position_sizing", {})
    names = {"daily_loss_cap_pct": ("day_loss_cap", float), "weekly_loss_cap_pct": ("week_loss_cap", float), "max_open_trades": ("max_open", int), "min_risk_reward_ratio": ("least_reward", float), "sl_cooldown_minutes": ("cooldown_minutes", int)}
    out |= {mine: kind(gates[theirs]) for theirs, (mine, kind) in names.items() if theirs in gates}
    if "block_hours" in gates:
        out["block_hours"] = tuple(sorted({int(h) for hours in gates["block_hours"].values() for h in hours}))
    names = {"base_size_usd": ("base_size", float), "kelly_fraction_cap": ("kelly_cap", float), "split_tp_ratios": ("target_shares", tuple)}
    out |= {mine: kind(sizes[theirs]) for theirs, (mine, kind) in names.items() if theirs in sizes}
    if "win_rate_adjustments" in sizes:
        # from the lowest band of win rates to the highest
        bands = zip(("below", "40", "above"), base.size_factors, strict=True)
        out["size_factors"] = tuple(float(next((v for k, v in sizes["win_rate_adjustments"].items() if k.startswith(p)), known)) for p, known in bands)
    return replace(base, **out)
