"""Where graphs come from and go to: tables, edge lists, JSON documents, random draws."""
