"""Topic logs and schema documents."""
