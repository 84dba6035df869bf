import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from conftest_llm import no_docs, odd_docs, odd_rows  # noqa: E402

__all__ = ["no_docs", "odd_docs", "odd_rows"]
