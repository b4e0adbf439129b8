"""Training-data operators: deduplication, scans, scoring, token counts, mixing and token files.

Nothing outside this subpackage imports it. Each operator takes DataFrames and returns a DataFrame;
`queries` registers one query per operator over the whole `documents` table.
"""
