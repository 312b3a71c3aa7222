"""DataFrame operators on keyed time series."""
