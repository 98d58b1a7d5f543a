"""Sources and sinks (S1–S6) and the bindings of the driver's tables."""
