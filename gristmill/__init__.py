"""Retrieval, evidence selection and evaluation over text corpora, as DataFrame operators."""
