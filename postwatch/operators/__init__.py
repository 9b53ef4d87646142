"""DataFrame operators: versions, search, statistics, ingest, ledgers, admission."""
