"""The ledger transformation graph and the analysis of Catalyst plans."""
