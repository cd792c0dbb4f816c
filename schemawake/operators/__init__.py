"""Set-based operators; the scope columns (source, version, api, kind) partition every one of them."""
