"""Analytics over 16-bit image volumes and image time series held as tables."""
