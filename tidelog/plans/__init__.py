"""The log model over the test tables, the registered queries and their checking SQL."""
