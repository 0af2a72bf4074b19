"""Column builders: text, numbers, dates and coordinates. No Python UDFs."""
