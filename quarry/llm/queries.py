"""All queries of the subpackage: importing this module registers them."""

from .common import QUERIES, SQL  # noqa: F401
from . import bpe, collocations, conversations, decontaminate, langid, linededup, minhash, mix, substrings, toxicity, urls, vectors, warc  # noqa: F401
