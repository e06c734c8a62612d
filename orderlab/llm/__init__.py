"""Training-data pipeline operators (language-model scoring, language ID, chat
formatting, quality rules, mixing, secret scans, HTML extraction, near-duplicate
removal, URL filters, decontamination).

Nothing else in the library imports this subpackage; ``queries.py`` holds its
registered queries and their SQL.
"""
