"""fabsight: equipment-telemetry analytics expressed as Spark jobs."""
