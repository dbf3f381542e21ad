"""Where graphs come from and go to: tables, record files, backups, result streams."""
