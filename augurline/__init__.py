"""Forecast comparison and uncertainty on Spark; the names below load their modules on first use."""

from __future__ import annotations

from importlib import import_module

_PLACES = {
    "operators.splits": ("Rolling", "rolling_splits"),
    "operators.forecasters": ("Naive", "SeasonalNaive", "Drift", "Autoregression", "Differenced", "Windowed"),
    "operators.backtest": ("backtest", "from_predictions", "rolling_ar1", "series_of"),
    "operators.evaluate": ("evaluate", "select_forecaster", "compare_forecasts", "improvements", "accuracy", "mase_scale"),
    "operators.hac": ("panel_of", "checked_panel", "subtract_benchmark", "long_run_variance", "infer_mean", "default_lags", "default_block_length", "tail_variance", "tail_statistics", "known_phi_t", "fit_equicorrelated"),
    "operators.bootstrap": ("audit", "test_returns", "draw_indices", "draws", "mean_variance"),
    "operators.certified": ("reference_test", "multiscale_test"),
    "operators.conformal": ("AdaptiveConformal", "MultiStepConformal", "adaptive_intervals", "conformal_state", "multistep_intervals", "interval_summary"),
    "operators.sequential": ("SequentialModelConfidenceSet", "confidence_sets", "sequential_compare"),
    "operators.simulate": ("simulate", "scenario", "panels", "study", "rejection_rates"),
    "operators.reference": ("ar1_mean_variance", "ar1_hac_moments"),
    "functions.losses": ("forecast_loss", "interval_score"),
    "sources.returns_csv": ("read_returns_csv",),
    "sources.tsf": ("read_tsf", "load_dataset", "available_datasets", "observations"),
    "streaming.online": ("adaptive_stream", "multistep_stream", "confidence_set_stream"),
    "report": ("html_report",),
}
_HOME = {name: place for place, names in _PLACES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)


def __dir__() -> list[str]:
    return __all__
