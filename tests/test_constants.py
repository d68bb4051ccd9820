"""The fixed values, pinned: the expected SQL reads them too, so a typo would pass both sides."""

import hashlib

import pytest

from pageframe.functions import constants

# name: number of entries, leading digits of the hash of all of them in order
PINS = {
    "API_PATTERNS": (47, "daca8a1220db"),
    "SECRET_PATTERNS": (23, "a6ac5774c779"),
    "MIME_EXTENSIONS": (42, "a51010a91e3e"),
    "OCTET_STREAM_PATHS": (3, "02124495c0d9"),
    "FRAMEWORK_NAMES": (15, "c59290df638a"),
    "APP_ROOT_IDS": (4, "53433ae95994"),
    "HYDRATION_MARKS": (7, "610e7583f29d"),
    "GENERATOR_NAMES": (5, "0a22a1b953b0"),
    "CHALLENGE_PHRASES": (10, "9f67529a3722"),
    "BROWSER_CHECK_PHRASES": (4, "c025d85b611d"),
    "DYNAMIC_URL_WORDS": (9, "0ac3559d7074"),
    "DYNAMIC_PATTERNS": (18, "ae6bb8bdc833"),
    "BINARY_TYPES": (6, "514a7d6f4c0b"),
    "DOWNLOAD_WORDS": (5, "3721a5df93bb"),
    "RETRYABLE_STATUS": (7, "4b9caa025492"),
    "EXTENSION_CATEGORIES": (13, "01f66059111b"),
    "FALLBACK_ENCODINGS": (34, "8f9b1e71b619"),
}


@pytest.mark.parametrize("name", PINS)
def test_fixed_values_are_as_they_were(name):
    values = getattr(constants, name)
    entries = list(values.items()) if isinstance(values, dict) else list(values)
    assert (len(entries), hashlib.sha256(repr(entries).encode()).hexdigest()[:12]) == PINS[name]
