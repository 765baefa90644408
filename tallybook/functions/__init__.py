"""Column rules shared by the reports. Each takes and returns ``Column``s."""
