"""DataFrame -> DataFrame operators over matches, teams, fixtures and messages."""
