"""Label acquisition and data selection as DataFrame queries."""
