"""DataFrame operators: analysis, matching, covers, headlines, upkeep."""
