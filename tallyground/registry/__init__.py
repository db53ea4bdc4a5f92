"""Every operator as a query on the test tables, with the same result in plain SQL where SQL can say it."""
