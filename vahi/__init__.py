"""Set-oriented invoice, ledger and tax-statement analytics on PySpark."""
