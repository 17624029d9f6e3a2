"""Operators of a training-data pipeline (mixing, decontamination, dedup,
chat formatting, token counts, binary output, WARC, language ID)."""
