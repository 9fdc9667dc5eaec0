"""Brute-force forms that several tests share."""

from test_secrets import brute as brute_secrets
from test_simhash import brute_components, brute_fingerprint

__all__ = ["brute_components", "brute_fingerprint", "brute_secrets"]
