"""The row rules on streams of arriving files."""
