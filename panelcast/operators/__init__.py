"""DataFrame operators: grid, quality, features, splits, forecasts, scores."""
