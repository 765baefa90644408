"""Inputs and cases of the correctness check.

``fixtures`` turns the given star-schema tables into the ledger-shaped tables the reports
read; the case modules run every report on them and state the same result in SQL.
"""
