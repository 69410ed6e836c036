"""Where rows go: the rows table, exports, the audit trail."""
