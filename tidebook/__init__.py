"""Order-book research operators for PySpark: every step is DataFrame in, DataFrame out."""

from tidebook.params import AuctionParams, BookParams, Contract, SessionParams, SplitRange, TradingRule

__all__ = ["AuctionParams", "BookParams", "Contract", "SessionParams", "SplitRange", "TradingRule"]
