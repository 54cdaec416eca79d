"""Vehicle telemetry, cost reconciliation and training-data operators on Spark."""
