"""Page archives as data: ledgers, settings, image measurements, series, text layers and live streams on Spark."""
