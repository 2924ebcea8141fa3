"""tallyforge: reconciles invoice documents with a general ledger on Spark."""
