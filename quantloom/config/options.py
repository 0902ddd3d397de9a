"""Weights, risk bands and strategy parameters of the options operators."""

from __future__ import annotations

SOURCES = ("rsi", "beta", "momentum", "iv", "forecast")
RISK_LEVELS = ("Conservative", "Moderate", "Aggressive")
STRATEGIES = ("Long Calls", "Bull Call Spread", "Covered Call", "Cash-Secured Put")

# Default indicator weights and the multipliers of the peer signal.
DEFAULT_WEIGHTS = {"rsi": 0.20, "beta": 0.20, "momentum": 0.20, "iv": 0.20, "forecast": 0.20}
SIGNAL_MULTIPLIER = {"confirm": 1.1, "neutral": 1.0, "veto": 0.9}

# Weights per strategy, in the order rsi, beta, momentum, iv, forecast.
STRATEGY_WEIGHTS = {
    "Long Calls": (0.25, 0.15, 0.25, 0.15, 0.20),
    "Long Puts": (0.30, 0.20, 0.20, 0.15, 0.15),
    "Covered Call": (0.15, 0.25, 0.15, 0.30, 0.15),
    "Cash-Secured Put": (0.25, 0.20, 0.15, 0.25, 0.15),
    "Bull Call Spread": (0.20, 0.20, 0.20, 0.20, 0.20),
    "Bear Put Spread": (0.30, 0.15, 0.20, 0.20, 0.15),
    "Bull Put Spread": (0.20, 0.25, 0.15, 0.25, 0.15),
    "Bear Call Spread": (0.25, 0.15, 0.20, 0.25, 0.15),
    "Iron Condor": (0.15, 0.30, 0.10, 0.35, 0.10),
    "Iron Butterfly": (0.15, 0.25, 0.15, 0.35, 0.10),
    "Calendar Spread": (0.15, 0.20, 0.10, 0.40, 0.15),
    "Long Straddle": (0.15, 0.15, 0.20, 0.40, 0.10),
    "Long Strangle": (0.15, 0.15, 0.20, 0.40, 0.10),
    "Short Straddle": (0.20, 0.25, 0.15, 0.30, 0.10),
    "Short Strangle": (0.20, 0.25, 0.15, 0.30, 0.10),
}

# Limits per risk tolerance.
RISK_PROFILES = {
    "Conservative": dict(max_delta=0.30, min_days=60, moneyness_range=0.15, min_volume=50, min_open_interest=100, max_spread=0.05),
    "Moderate": dict(max_delta=0.50, min_days=30, moneyness_range=0.25, min_volume=25, min_open_interest=50, max_spread=0.10),
    "Aggressive": dict(max_delta=0.70, min_days=15, moneyness_range=0.40, min_volume=10, min_open_interest=25, max_spread=0.20),
}

# Strategy parameters; a risk level overrides the base.
STRATEGY_PARAMS = {
    "Long Calls": {
        "base": dict(default_min_days=180, prefer_otm=True, max_delta=0.80, min_volume=10, min_open_interest=25),
        "Conservative": dict(max_delta=0.60, min_volume=50, min_open_interest=100, min_days_adjustment=30),
        "Moderate": dict(max_delta=0.70, min_volume=25, min_open_interest=50, min_days_adjustment=0),
        "Aggressive": dict(max_delta=0.90, min_volume=5, min_open_interest=10, min_days_adjustment=-60),
    },
    "Bull Call Spread": {
        "base": dict(default_min_days=180, spread_width=5.0, min_credit_ratio=0.30, max_long_delta=0.70, min_short_delta=0.30),
        "Conservative": dict(spread_width=2.5, min_credit_ratio=0.40, max_long_delta=0.60, min_short_delta=0.35),
        "Moderate": dict(spread_width=5.0, min_credit_ratio=0.30, max_long_delta=0.70, min_short_delta=0.30),
        "Aggressive": dict(spread_width=10.0, min_credit_ratio=0.20, max_long_delta=0.80, min_short_delta=0.20),
    },
    "Covered Call": {
        "base": dict(default_min_days=30, prefer_otm=True, target_delta=0.30, min_annualized_yield=0.08, max_delta=0.50),
        "Conservative": dict(target_delta=0.20, min_annualized_yield=0.06, max_delta=0.30),
        "Moderate": dict(target_delta=0.30, min_annualized_yield=0.08, max_delta=0.50),
        "Aggressive": dict(target_delta=0.45, min_annualized_yield=0.12, max_delta=0.70),
    },
    "Cash-Secured Put": {
        "base": dict(default_min_days=30, prefer_otm=True, target_delta=0.25, min_annualized_yield=0.08, max_delta=0.45),
        "Conservative": dict(target_delta=0.15, min_annualized_yield=0.06, max_delta=0.25),
        "Moderate": dict(target_delta=0.25, min_annualized_yield=0.08, max_delta=0.45),
        "Aggressive": dict(target_delta=0.40, min_annualized_yield=0.12, max_delta=0.60),
    },
}

# Contract bands per strategy and risk level.
LONG_CALL_BANDS = {
    "Conservative": dict(lo=0.85, hi=1.05, floor_days=120),
    "Moderate": dict(lo=0.95, hi=1.15, floor_days=0),
    "Aggressive": dict(lo=1.0, hi=1.25, floor_days=30),
}
SPREAD_BANDS = {
    "Conservative": dict(max_width=0.10, min_ratio=1.5),
    "Moderate": dict(max_width=0.15, min_ratio=1.2),
    "Aggressive": dict(max_width=0.20, min_ratio=1.0),
}
COVERED_CALL_BANDS = {
    "Conservative": dict(lo=0.05, hi=0.15, min_yield=0.005),
    "Moderate": dict(lo=0.02, hi=0.12, min_yield=0.01),
    "Aggressive": dict(lo=0.0, hi=0.08, min_yield=0.015),
}
CASH_PUT_BANDS = {
    "Conservative": dict(lo=0.08, hi=0.25, min_yield=0.005),
    "Moderate": dict(lo=0.05, hi=0.20, min_yield=0.01),
    "Aggressive": dict(lo=0.02, hi=0.15, min_yield=0.015),
}


def strategy_weights(strategy: str | None = None) -> dict[str, float]:
    """Weights of a strategy, or the default for none or an unknown one."""
    if strategy not in STRATEGY_WEIGHTS:
        return dict(DEFAULT_WEIGHTS)
    return dict(zip(SOURCES, STRATEGY_WEIGHTS[strategy]))


def risk_adjusted_params(strategy: str, risk: str) -> dict:
    table = STRATEGY_PARAMS[strategy]
    return {**table["base"], **table.get(risk, {})}
