"""Sources: ranges, texts and columns of tables, each row with its place (_src_partition, _src_seq)."""

from millrace.sources.numbers import range_rows, range_settings
from millrace.sources.tables import table_lines, table_values
from millrace.sources.texts import corpora, corpus_text, line_rows, register_corpus

__all__ = ["corpora", "corpus_text", "line_rows", "range_rows", "range_settings", "register_corpus", "table_lines", "table_values"]
