"""Tables, ledgers, extracts and their sinks."""
