"""Whole jobs: the two-protocol backtest and experiment grids."""
