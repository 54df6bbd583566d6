"""ledgerloom: a transaction-ledger engine expressed as Spark DataFrame operators."""
