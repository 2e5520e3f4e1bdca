"""loanlens: mortgage-loan cohort analytics as Spark DataFrame plans."""

from loanlens.sources.tables import LoanTables
from loanlens.spec import BalanceSegments, CohortSpec

__all__ = ["BalanceSegments", "CohortSpec", "LoanTables"]
