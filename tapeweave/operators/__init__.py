"""DataFrame to DataFrame operators on market-event tables."""
