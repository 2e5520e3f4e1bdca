"""SQL answers for every named query, written independently of the DataFrame code."""

from oracle.statements import STATEMENTS

__all__ = ["STATEMENTS"]
