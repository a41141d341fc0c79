"""Sources: source trees, version control, stored documents."""
