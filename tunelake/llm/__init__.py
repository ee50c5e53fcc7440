"""Operators for preparing large text corpora: filtering, deduplication, decontamination, tokenisation and scoring.

Nothing outside this package imports it.  Queries and their SQL are collected in :mod:`tunelake.llm.registry`.
"""
