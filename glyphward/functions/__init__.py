"""Column functions: regular-expression dialect, spans, text measures and severities."""
