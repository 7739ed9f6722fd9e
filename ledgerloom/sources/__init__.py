"""Readers and writers: episode files, haystack records, result tables and run bookkeeping."""
