"""Sources and sinks: driver tables, encounter adapter, CSV and table IO."""
