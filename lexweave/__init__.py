"""Statute-text analytics on PySpark: ingestion, retrieval, prompts and chat memory as DataFrame plans."""
