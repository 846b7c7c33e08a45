"""Streams of events into date returns and running summaries (an extension; the tables of the batch engine are the contract)."""
