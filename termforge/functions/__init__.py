"""Column expressions: text, URLs, codecs."""
