"""Importing this module registers every query of the package."""

from winnow.llm import (  # noqa: F401
    exact_dedup, filter_audit, html_extract, license_scan, mixing, neighbours, quality, secret_scan,
    sentencepiece_bpe, sharding, simhash, warc, whitening)
from winnow.llm.registry import ORACLES, QUERIES  # noqa: F401
