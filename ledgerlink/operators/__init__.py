"""DataFrame operators: dedupe, facts, links, rules, ledger, quality, windows, review."""
