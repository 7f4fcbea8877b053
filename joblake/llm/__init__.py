"""Operators for preparing training data: near-duplicate joins, benchmark
decontamination, language identification, license scans, line de-duplication,
quality labelling, chat formatting, nearest neighbours, secret scans, mixing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
